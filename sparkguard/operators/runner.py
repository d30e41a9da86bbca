"""Ordered change scripts: what is pending, what may run, and the state of every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANALYZER_EXIT = {"SAFE": 0, "REVIEW_REQUIRED": 10, "BLOCKED": 20, "PARSE_ERROR": 30, "RULES_INVALID": 40}
RUNNER_EXIT = {"APPLIED": 0, "REFUSED_BLOCKED": 21, "REFUSED_PARSE_FAILURE": 31, "REFUSED_MIXED_FILE": 41, "REFUSED_STALE_MARKER": 51, "EXECUTION_FAILED": 61, "REFUSED_TIMEOUTS_NOT_IN_EFFECT": 71}
TIMEOUTS = {"lock_timeout": "3000", "statement_timeout": "30000"}


def high_water_mark(ledger: DataFrame, at: str = "created_at") -> DataFrame:
    """One row: the latest recorded time, null for an empty ledger."""
    return ledger.agg(F.max(at).alias("last_at"))


def pending(scripts: DataFrame, ledger: DataFrame, when: str = "when", at: str = "created_at") -> DataFrame:
    """scripts with ``pending``: strictly after the mark, or all while nothing is recorded. Older ones stay skipped."""
    # The mark is an aggregate: one row.
    marked = scripts.join(F.broadcast(high_water_mark(ledger, at)), F.lit(True))
    return marked.withColumn("pending", F.col("last_at").isNull() | (F.col("last_at") < F.col(when))).drop("last_at")


def before_blocked(scripts: DataFrame, order: str, blocked: Column, group: list[str]) -> DataFrame:
    """Scripts with ``state``: applied before the first blocked one, refused there, not-run behind it."""
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.max(blocked.cast("int")).over(upto), F.lit(0)) == 1
    return scripts.withColumn("state", F.when(earlier, "not-run").when(blocked, "refused").otherwise("applied"))


def transaction_policy(statements: DataFrame, script: str, hostile: Column) -> DataFrame:
    """script, statements, hostile, policy: wrap without hostile ones, unwrap a single hostile one, else mixed."""
    found = statements.groupBy(script).agg(F.count(F.lit(1)).alias("statements"), F.count_if(hostile).alias("hostile"))
    policy = F.when(F.col("hostile") == 0, "wrap").when((F.col("statements") == 1) & (F.col("hostile") == 1), "unwrap").otherwise("mixed")
    return found.withColumn("policy", policy)


def latest_state(events: DataFrame, key: str, sequence: str, state: str) -> DataFrame:
    """key, latest_state, latest_sequence of an append-only event table."""
    return events.groupBy(key).agg(F.max_by(state, sequence).alias("latest_state"), F.max(sequence).alias("latest_sequence"))


def unresolved(markers: DataFrame) -> DataFrame:
    """Markers in flight, or failed outside a transaction, in order of id."""
    return markers.where((F.col("state") == "in_flight") | ((F.col("state") == "failed") & ~F.col("wrapped"))).orderBy("id")


def settings_report(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """name, wanted, found, fine: exact text; a setting that is missing is not fine."""
    return expected.join(actual, "name", "left").withColumn("fine", F.col("wanted").eqNullSafe(F.col("found")))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``occurrences`` of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def journal_faults(journal: DataFrame, files: DataFrame) -> DataFrame:
    """fault, subject: duplicate index, duplicate time, entry without file, file without entry."""
    idx = duplicate_keys(journal, ["idx"]).select(F.lit("duplicate-index").alias("fault"), F.col("idx").cast("string").alias("subject"))
    when = duplicate_keys(journal, ["when"]).select(F.lit("duplicate-time").alias("fault"), F.col("when").cast("string").alias("subject"))
    lost = journal.join(files, "tag", "left_anti").select(F.lit("entry-without-file").alias("fault"), F.col("tag").alias("subject"))
    extra = files.join(journal, "tag", "left_anti").select(F.lit("file-without-entry").alias("fault"), F.col("tag").alias("subject"))
    return idx.unionByName(when).unionByName(lost).unionByName(extra)


def run_gates(scripts: DataFrame, run: str, order: str, stale: Column, unparsed: Column, blocked: Column, mixed: Column) -> DataFrame:
    """run, outcome, code, refused_at: what a run of ordered scripts may do before it executes anything.

    Markers left unresolved refuse before all else, then any script that could not be classified, whatever its
    place; then the first blocked or mixed script in order stops the run there (``refused_at``).
    """
    refusal = F.when(blocked, "REFUSED_BLOCKED").when(mixed, "REFUSED_MIXED_FILE")
    first = F.min(F.when(refusal.isNotNull(), F.struct(F.col(order).alias("at"), refusal.alias("outcome"))))
    found = scripts.groupBy(run).agg(F.coalesce(F.bool_or(stale), F.lit(False)).alias("stale"), F.coalesce(F.bool_or(unparsed), F.lit(False)).alias("unparsed"), first.alias("first"))
    gated = F.col("stale") | F.col("unparsed")
    outcome = F.when(F.col("stale"), "REFUSED_STALE_MARKER").when(F.col("unparsed"), "REFUSED_PARSE_FAILURE").otherwise(F.coalesce("first.outcome", F.lit("APPLIED")))
    codes = F.create_map(*[F.lit(x) for pair in RUNNER_EXIT.items() for x in pair])
    return found.select(run, outcome.alias("outcome"), F.element_at(codes, outcome).alias("code"), F.when(~gated, F.col("first.at")).alias("refused_at"))


def stale_markers(markers: DataFrame, run: str, name: str) -> DataFrame:
    """run, message: a refusal that names every unresolved marker, in order of id."""
    rows = markers.where((F.col("state") == "in_flight") | ((F.col("state") == "failed") & ~F.col("wrapped")))
    named = F.array_sort(F.collect_list(F.struct("id", F.concat(F.col(name), F.lit(" ("), F.col("state"), F.lit(")")).alias("text"))))["text"]
    return rows.groupBy(run).agg(F.concat(F.lit("unresolved: "), F.array_join(named, ", ")).alias("message"))


def resolve_events(markers: DataFrame, at: Column) -> DataFrame:
    """Events that resolve every unresolved marker: rows to append, nothing is changed."""
    return unresolved(markers).withColumns({"state": F.lit("resolved"), "finished_at": at})


def recovery_report(markers: DataFrame, invalid: DataFrame) -> DataFrame:
    """kind, subject of what an interrupted run left: unresolved markers and invalid indexes; nothing is repaired."""
    left = unresolved(markers).select(F.lit("marker").alias("kind"), F.col("id").cast("string").alias("subject"))
    return left.unionByName(invalid.select(F.lit("invalid-index").alias("kind"), F.concat_ws(".", "schema_name", "index_name").alias("subject")))


STATES = ("in_flight", "applied", "failed", "refused", "resolved")


def run_entries(log: DataFrame, run_id: str) -> DataFrame:
    """Entries of one run by id; a state that no run can have fails the read."""
    fine = F.when(F.col("state").isin(*STATES), F.col("state")).otherwise(F.raise_error(F.concat(F.lit("unknown state "), F.coalesce("state", F.lit("null")))))
    return log.where(F.col("run_id") == run_id).withColumn("state", fine).orderBy("id")


def run_report(skipped: DataFrame, applied: DataFrame, order: str) -> DataFrame:
    """Skipped and handled scripts together, in order."""
    return skipped.unionByName(applied, allowMissingColumns=True).orderBy(order)


def applied_count_fault(ledger: DataFrame, journal: DataFrame) -> DataFrame:
    """applied, expected of a ledger that holds another number of entries than the journal; no row if it is fine."""
    counted = ledger.agg(F.count(F.lit(1)).alias("applied")).join(F.broadcast(journal.agg(F.count(F.lit(1)).alias("expected"))), F.lit(True))
    return counted.where("applied <> expected")
