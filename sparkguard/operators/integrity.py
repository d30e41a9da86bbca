"""Dataset integrity: orphan rows, row counts, content hashes, positional comparison, text comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def orphan_rows(child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]) -> DataFrame:
    """Child rows whose key is complete and has no parent. Composite keys count as a whole."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in child_keys])
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_keys)])
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(child_keys)])
    return child.where(present).join(keys, match, "left_anti")


def orphan_report(relations: Sequence[tuple[str, DataFrame, Sequence[str], DataFrame, Sequence[str]]]) -> DataFrame:
    """constraint_name, orphan_count of every declared relation; without a relation there is nothing to vouch for."""
    if not relations:
        raise ValueError("no foreign key declared")
    parts = [orphan_rows(child, ck, parent, pk).agg(F.count(F.lit(1)).alias("orphan_count")).select(F.lit(name).alias("constraint_name"), "orphan_count") for name, child, ck, parent, pk in relations]
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count of every table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()])


def compare_counts(expected: DataFrame, actual: DataFrame, both_ways: bool = True) -> DataFrame:
    """table_name, expected_count, actual_count, status: ok, mismatch, missing or (both ways) unexpected."""
    e = expected.select("table_name", F.col("row_count").alias("expected_count"))
    a = actual.select("table_name", F.col("row_count").alias("actual_count"))
    status = (
        F.when(F.col("actual_count").isNull(), "missing").when(F.col("expected_count").isNull(), "unexpected").when(F.col("expected_count").eqNullSafe(F.col("actual_count")), "ok").otherwise("mismatch")
    )
    return e.join(a, "table_name", "full_outer" if both_ways else "left").withColumn("status", status)


def content_hash(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """md5 over the sorted row texts, joined by record separators; an empty table hashes the empty text.

    The rows meet in one task, which the exact text form of this hash requires: use it for tables
    of control size, and scalable_hash for all others.
    """
    line = F.concat_ws("\x1f", *columns)
    rows = df.select(line.alias("line"))
    joined = F.expr("listagg(line, chr(30)) WITHIN GROUP (ORDER BY line)")
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.md5(F.coalesce(joined, F.lit("")).cast("binary")).alias("content_md5"))


def ranged_hash(df: DataFrame, columns: Sequence[Column], digits: int = 2) -> DataFrame:
    """row_count, content_md5: like ``content_hash``, but from the hashes of 16 ** digits ranges that are sorted and hashed in parallel.

    A row belongs to the range of the first ``digits`` hex digits of its own hash. Equal rows are counted before they meet, so a
    row that is repeated often is one row of its range; more digits keep ranges of larger tables small.
    """
    line = F.concat_ws("\x1f", *columns)
    rows = df.select(line.alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    told = rows.select(F.substr(F.md5(F.col("line").cast("binary")), F.lit(1), F.lit(digits)).alias("range"), "n", F.concat_ws("\x1f", "line", F.col("n").cast("string")).alias("line"))
    ranges = told.groupBy("range").agg(F.sum("n").alias("n"), F.md5(F.expr("listagg(line, chr(30)) WITHIN GROUP (ORDER BY line)").cast("binary")).alias("hash"))
    joined = F.expr("listagg(hash, chr(30)) WITHIN GROUP (ORDER BY range)")
    return ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.md5(F.coalesce(joined, F.lit("")).cast("binary")).alias("content_md5"))


def scalable_hash(df: DataFrame, columns: Sequence[Column] | None = None) -> DataFrame:
    """row_count and the order-free sum of row hashes: combined in every task, safe against repeated rows.

    A row's hash is the first 60 bits of the md5 of its values' texts; a null differs from every text. The sum of
    fewer than 10**20 rows is exact, and 0 for an empty table.
    """
    texts = [F.concat(F.lit("v"), c.cast("string")) for c in (columns or [F.col(f"`{c}`") for c in df.columns])]
    line = F.concat_ws("\x1f", *[F.coalesce(t, F.lit("n")) for t in texts])
    each = F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(each), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)").alias("hash_sum"))


def compare_hashes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """table_name, expected_hash, actual_hash, status of every expected table: ok, mismatch or missing.

    An empty expectation vouches for nothing: it is one row with the status nothing-expected.
    """
    e, a = expected.select("table_name", F.col("hash").alias("expected_hash")), actual.select("table_name", F.col("hash").alias("actual_hash"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("expected_hash").eqNullSafe(F.col("actual_hash")), "ok").otherwise("mismatch")
    found = e.join(a, "table_name", "left").select("table_name", "expected_hash", "actual_hash", status.alias("status"))
    none = expected.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return found.unionByName(none.select(F.lit(None).cast("string").alias("table_name"), F.lit(None).cast(found.schema["expected_hash"].dataType).alias("expected_hash"), F.lit(None).cast(found.schema["actual_hash"].dataType).alias("actual_hash"), F.lit("nothing-expected").alias("status")))


def schemas_equal(expected: Column, actual: Column) -> Column:
    """Whether two schema dumps are equal once canonical; an empty side never is."""
    e, a = (F.coalesce(canonical_schema_text(c), F.lit("")) for c in (expected, actual))
    return (e != "") & (e == a)


def collect_manifest(tables: dict[str, DataFrame], core: Sequence[str]) -> DataFrame:
    """table_name, row_count, hash_sum of every table; refused where a core table is missing."""
    lost = sorted(set(core) - set(tables))
    if lost:
        raise ValueError("core tables missing: " + ", ".join(lost))
    return reduce(DataFrame.unionByName, [scalable_hash(df).select(F.lit(name).alias("table_name"), "row_count", "hash_sum") for name, df in tables.items()])


def passed(status: DataFrame) -> DataFrame:
    """status row -> condition by outcome alone, whatever its age: never-ran, failed or passed."""
    return status.withColumn("condition", F.when(F.col("last_run_at").isNull(), "never-ran").when(F.col("outcome").eqNullSafe("PASS"), "passed").otherwise("failed"))


def drill_outcome(checks: DataFrame, run: str) -> DataFrame:
    """run, outcome: PASS where every recorded tier passed, FAIL otherwise; a run without checks has no row to write."""
    return checks.groupBy(run).agg(F.when(F.bool_and(F.coalesce("passed", F.lit(False))), "PASS").otherwise("FAIL").alias("outcome"))


def positional_differences(expected: DataFrame, actual: DataFrame, order: Sequence[str], columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Rows that differ at the same position of both ordered tables, within ``group``."""
    at = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order)

    def placed(df: DataFrame, side: str) -> DataFrame:
        return df.withColumn("position", F.row_number().over(at)).select(*group, "position", F.struct(*columns).alias(side))

    both = placed(expected, "expected").join(placed(actual, "actual"), [*group, "position"], "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def canonical_schema_text(text: Column) -> Column:
    """Schema dump without carriage returns, session markers, comment lines and blank runs, trimmed."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    kept = F.array_join(F.filter(F.split(unix, "\n"), lambda line: ~line.rlike(r"^\\(un)?restrict") & ~line.rlike(r"^--")), "\n")
    return F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def line_difference(left: DataFrame, right: DataFrame, most: int = 5) -> DataFrame:
    """side, position, line: the first ``most`` lines that one side (a column ``text``) has and the other lacks."""

    def lines(df: DataFrame) -> DataFrame:
        return df.select(F.posexplode(F.split("text", "\n")).alias("position", "line"))

    a, b = lines(left), lines(right)

    def only(x: DataFrame, y: DataFrame, side: str) -> DataFrame:
        return x.join(y.select("line").distinct(), "line", "left_anti").orderBy("position").limit(most).select(F.lit(side).alias("side"), "position", "line")

    return only(a, b, "expected").unionByName(only(b, a, "actual"))


def record_tiers(checks: DataFrame, by: str | None = None) -> DataFrame:
    """tier, position, passed -> recorded: a tier counts only while all before it passed (later ones stay null).

    ``by`` names the run of each row; without it all rows are one run.
    """
    before = Window.partitionBy(by if by else F.lit(0)).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    fine = F.coalesce(F.min(F.col("passed").cast("int")).over(before), F.lit(1)) == 1
    return checks.withColumn("recorded", F.when(fine, F.col("passed")))


def freshness(status: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """status row -> condition: never-ran, failed, incomplete, stale or fresh. Ages are fractional and strict."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("last_run_at").cast("timestamp"))) / F.lit(86_400_000_000)
    condition = (
        F.when(F.col("last_run_at").isNull(), "never-ran")
        .when(F.col("outcome").isNull() | (F.col("outcome") != "PASS"), "failed")
        .when(~F.coalesce(F.col("all_tiers"), F.lit(False)), "incomplete")
        .when(age > days, "stale")
        .otherwise("fresh")
    )
    return status.withColumn("condition", condition)


def missing_tables(spark: SparkSession, wanted: Sequence[str], present: DataFrame) -> DataFrame:
    """Wanted table names that ``present`` (table_name) lacks."""
    return spark.createDataFrame([(w,) for w in wanted], "table_name string").join(present, "table_name", "left_anti")
