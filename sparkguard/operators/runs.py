"""Runs of pending scripts over many databases at once: what would be applied, in which way, and what stops where.

Gates come in the order in which a runner meets them. Markers left unresolved stop a run before all else; a script
that cannot be read stops it before anything is applied; then scripts are taken in order until one is blocked, or mixes
statements that a transaction may not hold with others. What stands before it stays applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import statements
from .rules import severity
from .runner import RUNNER_EXIT


def plan_runs(scripts: DataFrame, ledger: DataFrame, markers: DataFrame, rules: DataFrame) -> DataFrame:
    """One entry per script: run, idx, tag, when, sql_sha256, state, verdict, statement_count, wrapped, outcome, code.

    scripts: run, idx, when, tag, sql, one row per run and idx; ledger: run, created_at; markers: run, state, wrapped. A script
    is pending if it is later than all that its run's ledger holds; older ones are skipped for good. state is skipped, applied,
    refused (the script that stops the run) or not-run; verdict, statement_count and wrapped are those of scripts that were
    classified. outcome and code are the run's. Runs do not wait for each other, and each run's scripts meet in one task.
    """
    last = ledger.groupBy("run").agg(F.max("created_at").alias("last_at"))
    left = (F.col("state") == "in_flight") | ((F.col("state") == "failed") & ~F.col("wrapped"))
    stale = markers.where(left).select("run").distinct().withColumn("stale", F.lit(True))
    pending = F.col("last_at").isNull() | (F.col("last_at") < F.col("when"))
    base = scripts.join(last, "run", "left").join(stale, "run", "left").withColumns({"pending": pending, "sql_sha256": F.sha2(F.col("sql").cast("binary"), 256)}).drop("last_at")
    asked = base.where("pending AND stale IS NULL").select(F.struct("run", "idx").alias("file"), "sql")
    told = statements.read(asked)
    faulty = told.where("fault IS NOT NULL").select("file.run").distinct().withColumn("unparsed", F.lit(True))
    fine = told.withColumn("run", F.col("file.run")).join(faulty, "run", "left_anti").select("file", "clean")
    classified = statements.findings(fine, rules).groupBy("file").agg(
        F.max_by("verdict", severity(F.col("verdict"))).alias("verdict"),
        F.count_distinct(F.when(F.col("fact.statementKind") != "EmptyInput", F.col("at")[0])).alias("statement_count"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("fact.transactionHostile")).alias("hostile"),
    )
    mixed = (F.col("hostile") > 0) & (F.col("n") > 1)
    refusal = F.when(F.col("verdict") == "BLOCKED", "REFUSED_BLOCKED").when(mixed, "REFUSED_MIXED_FILE")
    rows = base.drop("sql").join(classified.select("file.run", "file.idx", "verdict", "statement_count", "hostile", refusal.alias("refusal")), ["run", "idx"], "left").join(faulty, "run", "left")
    in_run = Window.partitionBy("run").orderBy("idx")
    earlier = F.first("refusal", True).over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("refusal", True).over(in_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    outcome = F.when(F.col("stale"), "REFUSED_STALE_MARKER").when(F.col("unparsed"), "REFUSED_PARSE_FAILURE").otherwise(F.coalesce(first, F.lit("APPLIED")))
    state = F.when(~F.col("pending"), "skipped").when(F.col("stale") | F.col("unparsed") | earlier.isNotNull(), "not-run").when(F.col("refusal").isNotNull(), "refused").otherwise("applied")
    rows = rows.withColumns({"state": state, "outcome": outcome})
    codes = F.create_map(*[F.lit(x) for pair in RUNNER_EXIT.items() for x in pair])
    wrapped = F.when(F.col("state") == "applied", F.col("hostile") == 0).when(F.col("state") == "refused", False)
    reached = F.col("state").isin("applied", "refused")
    return rows.select(
        "run",
        "idx",
        "tag",
        "when",
        "sql_sha256",
        "state",
        *[F.when(reached, F.col(c)).alias(c) for c in ("verdict", "statement_count")],
        wrapped.alias("wrapped"),
        "outcome",
        F.element_at(codes, F.col("outcome")).alias("code"),
    )


def ledger_rows(entries: DataFrame) -> DataFrame:
    """run, hash, created_at to append for what was applied; the time is the script's own, never now."""
    return entries.where("state = 'applied'").select("run", F.col("sql_sha256").alias("hash"), F.col("when").alias("created_at"))


def run_outcomes(entries: DataFrame) -> DataFrame:
    """run, outcome, code, applied, worst_verdict (SAFE where nothing was classified), stopped_at (the refused script's tag)."""
    return entries.groupBy("run").agg(
        F.first("outcome").alias("outcome"),
        F.first("code").alias("code"),
        F.count_if(F.col("state") == "applied").alias("applied"),
        F.coalesce(F.max_by("verdict", severity(F.col("verdict"))), F.lit("SAFE")).alias("worst_verdict"),
        F.max(F.when(F.col("state") == "refused", F.col("tag"))).alias("stopped_at"),
    )
