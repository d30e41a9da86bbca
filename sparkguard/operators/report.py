"""Reports as text columns: escaping, sections, agreement of two tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import severity


def escape_markdown(text: Column) -> Column:
    """Backslash, backtick, pipe and angle brackets, in this order."""
    for plain, safe in (("\\", "\\\\"), ("`", "\\`"), ("|", "\\|"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def agreement(flagged: Column, verdict: Column) -> Column:
    """agree, disagree or unknown (the other tool failed) of a tool's flag and a verdict."""
    return F.when(flagged.isNull(), "unknown").when(flagged == (verdict != "SAFE"), "agree").otherwise("disagree")


def partition_introduced(files: DataFrame, introduced: DataFrame, key: str) -> DataFrame:
    """Files with ``section``: introduced or pre-existing."""
    paths = introduced.select(key).distinct().withColumn("_new", F.lit(True))
    return files.join(paths, key, "left").withColumn("section", F.when(F.col("_new"), "introduced").otherwise("pre-existing")).drop("_new")


def sections(findings: DataFrame, by: str, order: str) -> DataFrame:
    """by, findings, body: one line per finding in order, never cut short."""
    line = F.concat(F.lit("- "), F.col("verdict"), F.lit(": "), escape_markdown(F.col("message")))
    ordered = F.array_sort(F.collect_list(F.struct(order, line.alias("line"))))
    return findings.groupBy(by).agg(F.count(F.lit(1)).alias("findings"), F.array_join(ordered["line"], "\n").alias("body"))


def totals(findings: DataFrame, by: str) -> DataFrame:
    """One row: files, findings, safe, review, blocked and worst, the header of a report; SAFE where nothing was found."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    worst = F.coalesce(F.max_by("verdict", severity(F.col("verdict"))), F.lit("SAFE")).alias("worst")
    return findings.agg(F.count_distinct(by).alias("files"), F.count("verdict").alias("findings"), count("SAFE").alias("safe"), count("REVIEW_REQUIRED").alias("review"), count("BLOCKED").alias("blocked"), worst)


def findings_json(findings: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """by, report: a JSON array of each file's findings in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return findings.groupBy(by).agg(F.to_json(rows).alias("report"))


def findings_lines(findings: DataFrame, by: str, order: str) -> DataFrame:
    """by, body: a head line with the worst verdict and a line per finding (verdict, rule_ids, rationales) in order."""
    ids = F.when(F.size("rule_ids") > 0, F.array_join("rule_ids", ", ")).otherwise("(no rule matched)")
    line = F.rtrim(F.concat(F.lit("  statement "), F.col(order).cast("string"), F.lit(": "), F.col("verdict"), F.lit(" ["), ids, F.lit("] "), F.array_join("rationales", " ")))
    grouped = findings.groupBy(by).agg(F.max_by("verdict", severity(F.col("verdict"))).alias("worst"), F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("rows"))
    head = F.concat(F.col(by).cast("string"), F.lit(": "), F.col("worst"))
    return grouped.select(by, F.concat_ws("\n", head, F.col("rows.line")).alias("body"))


def failure_comment(marker: str, reason: Column, detail: Column) -> Column:
    """What a report says when there is no verdict; it never reads as one."""
    said = "No verdict could be given. The check fails until the cause is removed."
    return F.concat_ws("\n\n", F.lit(marker), F.lit("## Check could not run"), F.lit(said), F.concat(F.lit("**Reason:** "), escape_markdown(reason)), escape_markdown(detail))


def agreement_counts(rows: DataFrame) -> DataFrame:
    """agreement, n, of agree, disagree and unknown, each with a row."""
    names = rows.sparkSession.createDataFrame([("agree",), ("disagree",), ("unknown",)], "agreement string")
    counted = rows.groupBy("agreement").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(names).join(counted, "agreement", "left").select("agreement", F.coalesce("n", F.lit(0)).alias("n"))
