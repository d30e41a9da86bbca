"""Append-only history, drift and ruleset comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Entries of an append-only comparison in one partition, about.
ENTRIES = 500_000


def name_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """status, path of tab-separated lines; of renames the last path."""
    parts = F.split(line, "\t")
    return lines.where(F.trim(line) != "").select(parts[0].alias("status"), F.element_at(parts, -1).alias("path"))


def append_only_files(changes: DataFrame, prefix: str, exempt: str) -> DataFrame:
    """Changes under ``prefix`` that are no additions, but for the exempt file."""
    return changes.where(F.col("path").startswith(prefix) & (F.col("path") != exempt) & (F.col("status") != "A"))


def append_only_entries(base: DataFrame, head: DataFrame) -> DataFrame:
    """idx, fault: base entries missing or changed in head, and indexes that head repeats. New ones are fine.

    Both sides are dealt by idx once, for the join and the count, to as many partitions as their rows ask for: a task's
    memory does not grow with the tables.
    """
    parts = (base.count() + head.count()) // ENTRIES + 1
    base, head = (df.select("idx", "tag", "when").repartition(parts, "idx") for df in (base, head))
    h = head.hint("merge").select("idx", F.col("tag").alias("head_tag"), F.col("when").alias("head_when"), F.lit(True).alias("there"))
    fault = (
        F.when(F.col("there").isNull(), "missing").when(~F.col("tag").eqNullSafe(F.col("head_tag")), "tag-changed").when(~F.col("when").eqNullSafe(F.col("head_when")), "time-changed")
    )
    changed = base.join(h, "idx", "left").select("idx", fault.alias("fault")).where(F.col("fault").isNotNull())
    repeated = head.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("idx", F.lit("duplicate-index").alias("fault"))
    return changed.unionByName(repeated)


def porcelain_paths(line: Column) -> Column:
    """The path of a porcelain status line: what follows the two flags and a space."""
    return F.regexp_replace(F.substr(line, F.lit(4)), "\r$", "")


def set_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, side: keys that one table has and the other lacks."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, key, "left_anti").withColumn("side", F.lit("unexpected")))


def bypass_fault(actors: Column) -> Column:
    """Fault of a ruleset's bypass list as a variant: absent, null, not a list or not empty; null when it is empty."""
    kind = F.schema_of_variant(actors)
    return F.when(actors.isNull(), "absent").when(F.is_variant_null(actors), "null").when(~kind.startswith("ARRAY"), "not-a-list").when(F.to_json(actors) != "[]", "not-empty")


def ruleset_failures(rulesets: DataFrame, required_types: list[str], required_contexts: list[str]) -> DataFrame:
    """name, failures: every failure of every ruleset, none left out at the first one."""
    missing = F.array_except(F.array(*map(F.lit, required_types)), F.col("rule_types"))
    lost = F.array_except(F.array(*map(F.lit, required_contexts)), F.col("contexts"))
    found = F.array(
        F.when(F.col("enforcement") != "active", F.lit("not active")),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing rules: "), F.array_join(missing, ", "))),
        F.when(F.size(lost) > 0, F.concat(F.lit("missing contexts: "), F.array_join(lost, ", "))),
        F.concat(F.lit("bypass list "), bypass_fault(F.col("bypass_actors"))),
    )
    return rulesets.select("name", F.filter(found, lambda x: x.isNotNull()).alias("failures"))


def targets_branch(include: Column, branch: str = "refs/heads/main") -> Column:
    """Whether an include list names the branch, the default branch or everything; exclusions are not looked at."""
    return F.arrays_overlap(include, F.array(F.lit(branch), F.lit("~DEFAULT_BRANCH"), F.lit("~ALL")))


def expected_contexts(rulesets: DataFrame, name: str) -> list[str]:
    """Contexts that a committed ruleset requires, in order; none is an error, as it would require nothing."""
    found = [r["c"] for r in rulesets.where(F.col("name") == name).select(F.explode("contexts").alias("c")).distinct().orderBy("c").collect()]
    if not found:
        raise ValueError("no expected context")
    return found


def payload_faults(payloads: DataFrame) -> DataFrame:
    """name, faults of ruleset payloads (name, enforcement, contexts, rules, bypass_actors) that must not be sent."""
    found = F.array(
        F.concat(F.lit("bypass list "), bypass_fault(F.col("bypass_actors"))),
        F.when(~F.col("enforcement").eqNullSafe("active"), F.lit("not active")),
        F.when(F.coalesce(F.size("contexts"), F.lit(0)) <= 0, F.lit("no required context")),
        F.when(F.col("name").isNull(), F.lit("no name")),
        F.when(F.col("rules").isNull(), F.lit("no rules")),
    )
    return payloads.select("name", F.filter(found, lambda x: x.isNotNull()).alias("faults"))


def journal_or_empty(journal: DataFrame | None, like: DataFrame) -> DataFrame:
    """The journal of a base commit; a base that had none is an empty journal of the same columns."""
    return like.limit(0) if journal is None else journal


def escaping_imports(files: DataFrame, root: str, path: str = "path", text: str = "text") -> DataFrame:
    """path, specifier of relative imports in files under ``root`` that lead out of it, in order, repeats included.

    Lines that begin a comment or go on in one are left out. Steps back are counted against the file's depth in
    ``root``: an import leaves it when at some point it has gone back further than that.
    """
    pattern = r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)(['"])(\.[^'"]*)\1"""
    code = F.filter(F.split(text, "\n"), lambda x: ~F.ltrim(x).rlike(r"^(//|/\*|\*)"))
    inside = files.where(F.col(path).startswith(root.rstrip("/") + "/"))
    depth = F.size(F.split(F.substr(path, F.lit(len(root.rstrip("/")) + 2)), "/")) - 1
    found = inside.select(path, depth.alias("depth"), F.posexplode(F.regexp_extract_all(F.array_join(code, "\n"), F.lit(pattern), F.lit(2))).alias("position", "specifier"))
    state = F.struct(F.col("depth").cast("int").alias("at"), F.col("depth").cast("int").alias("least"))

    def step(acc, part):
        at = acc["at"] + F.when(part == "..", -1).when(part.isin(".", ""), 0).otherwise(1)
        return F.struct(at.cast("int").alias("at"), F.least(acc["least"], at).cast("int").alias("least"))

    return found.where(F.aggregate(F.split("specifier", "/"), state, step)["least"] < 0).orderBy(path, "position").select(path, "specifier")
