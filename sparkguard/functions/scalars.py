"""Column functions: shapes of digests and names, timestamps, ages, targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOOPBACK = ("localhost", "127.0.0.1", "::1", "[::1]")


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_md5(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{32}$"), F.lit(False))


def compact_timestamp(c: Column) -> Column:
    """20240131T235959Z of a timestamp in UTC."""
    return F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")


def age_days(now: Column, then: Column) -> Column:
    """Days between two timestamps, with their fraction."""
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400_000_000)


def name_schema(c: Column) -> Column:
    """What stands before the first dot of a qualified name; null without one."""
    return F.when(F.locate(".", c) > 0, F.substring_index(c, ".", 1))


def name_table(c: Column) -> Column:
    """What stands behind the first dot of a qualified name; the whole name without one."""
    return F.when(F.locate(".", c) > 0, F.substr(c, F.locate(".", c) + 1)).otherwise(c)


def target_fault(url: Column, database: str, port: int) -> Column:
    """Why a connection URL is no allowed target, null if it is one: a query's host and port win over the authority's."""
    part = lambda *p: F.try_parse_url(url, *[F.lit(x) for x in p])
    host = F.coalesce(part("QUERY", "host"), part("HOST"))
    at = F.coalesce(part("QUERY", "port"), F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1))
    return (
        F.when(host.isNull(), "no host")
        .when(part("QUERY", "hostaddr").isNotNull() | part("QUERY", "service").isNotNull(), "indirect host")
        .when(~F.lower(host).isin(*LOOPBACK), "foreign host")
        .when(at != str(port), "other port")
        .when(F.coalesce(part("PATH"), F.lit("")) != "/" + database, "other database")
    )


def outside(path: Column, workspace: str) -> Column:
    """Absolute, without steps back, and not inside the workspace."""
    return path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & (path != workspace) & ~path.startswith(workspace.rstrip("/") + "/")


def exit_code(verdict: Column, codes: dict[str, int]) -> Column:
    """The exit code of a verdict, 1 for one without a code."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, verdict), F.lit(1))


def job_result(code: Column, report: Column) -> Column:
    """pass, warn or fail of an analyzer's exit code; a verdict without a readable JSON report fails."""
    unreadable = code.isin(0, 10, 20) & F.try_parse_json(report).isNull()
    return F.when(unreadable, "fail").when(code == 0, "pass").when(code == 10, "warn").otherwise("fail")


def safe_message(message: Column, otherwise: Column) -> Column:
    """The first line of an error's message, or of what stands for it."""
    return F.substring_index(F.coalesce(message, otherwise.cast("string")), "\n", 1)


def json_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts hold the same value, whatever the order of their keys; malformed ones equal nothing."""
    x, y = (F.to_json(F.try_parse_json(c)) for c in (a, b))
    return F.coalesce(x == y, F.lit(False))
