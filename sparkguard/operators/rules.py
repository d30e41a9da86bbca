"""Verdicts from declarative rules: facts joined to rules, worst verdict first, and pairing of safe forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAFE, REVIEW, BLOCKED = "SAFE", "REVIEW_REQUIRED", "BLOCKED"
NO_RULE = "No rule recognises this operation."

#: Rule id, category, facts that must hold (typed: s: text, b: boolean, n: null), verdict.
RULES: list[tuple[str, str, dict[str, list[str]], str]] = [
    ("drop-table", "irreversible-data-loss", {"statementKind": ["s:DropTable"]}, BLOCKED),
    ("drop-schema", "irreversible-data-loss", {"statementKind": ["s:DropSchema"]}, BLOCKED),
    ("drop-database", "irreversible-data-loss", {"statementKind": ["s:DropDatabase"]}, BLOCKED),
    ("truncate", "irreversible-data-loss", {"statementKind": ["s:Truncate"]}, BLOCKED),
    ("drop-column", "irreversible-data-loss", {"statementKind": ["s:DropColumn"]}, BLOCKED),
    ("delete-without-where", "irreversible-data-loss", {"statementKind": ["s:Delete"], "hasWhereClause": ["b:false"]}, BLOCKED),
    ("update-without-where", "irreversible-data-loss", {"statementKind": ["s:Update"], "hasWhereClause": ["b:false"]}, BLOCKED),
    ("alter-type-drop-value", "irreversible-data-loss", {"statementKind": ["s:AlterTypeDropValue"]}, BLOCKED),
    ("add-column-volatile-default", "lock-hazard", {"statementKind": ["s:AddColumn"], "defaultVolatility": ["s:volatile"]}, REVIEW),
    ("set-not-null", "lock-hazard", {"statementKind": ["s:SetNotNull"]}, REVIEW),
    ("alter-column-type", "lock-hazard", {"statementKind": ["s:AlterColumnType"]}, REVIEW),
    ("add-unique-constraint", "lock-hazard", {"statementKind": ["s:AddUniqueConstraint"], "usingIndexName": ["n:"]}, REVIEW),
    ("create-index-not-concurrently", "lock-hazard", {"statementKind": ["s:CreateIndex"], "concurrently": ["b:false"]}, REVIEW),
    ("drop-index-not-concurrently", "lock-hazard", {"statementKind": ["s:DropIndex"], "concurrently": ["b:false"]}, REVIEW),
    ("add-foreign-key-validated", "lock-hazard", {"statementKind": ["s:AddForeignKey"], "notValid": ["b:false"]}, REVIEW),
    ("rename-column", "compatibility", {"statementKind": ["s:RenameColumn"]}, REVIEW),
    ("rename-table", "compatibility", {"statementKind": ["s:RenameTable"]}, REVIEW),
    ("drop-not-null", "compatibility", {"statementKind": ["s:DropNotNull"]}, REVIEW),
    ("drop-constraint", "compatibility", {"statementKind": ["s:DropConstraint"]}, REVIEW),
    ("create-table", "usually-safe", {"statementKind": ["s:CreateTable"]}, SAFE),
    ("add-column-nullable-no-default", "usually-safe", {"statementKind": ["s:AddColumn"], "defaultVolatility": ["s:none"]}, SAFE),
    ("add-column-nonvolatile-default", "usually-safe", {"statementKind": ["s:AddColumn"], "defaultVolatility": ["s:literal", "s:immutable", "s:stable"]}, SAFE),
    ("create-index-concurrently", "usually-safe", {"statementKind": ["s:CreateIndex"], "concurrently": ["b:true"]}, SAFE),
    ("drop-index-concurrently", "usually-safe", {"statementKind": ["s:DropIndex"], "concurrently": ["b:true"]}, SAFE),
    ("comment-on", "usually-safe", {"statementKind": ["s:CommentOn"]}, SAFE),
    ("add-check-constraint-not-valid", "usually-safe", {"statementKind": ["s:AddCheckConstraint"], "notValid": ["b:true"]}, SAFE),
    ("add-foreign-key-not-valid", "usually-safe", {"statementKind": ["s:AddForeignKey"], "notValid": ["b:true"]}, SAFE),
    ("validate-constraint", "usually-safe", {"statementKind": ["s:ValidateConstraint"]}, SAFE),
    ("do-block-container", "usually-safe", {"statementKind": ["s:DoBlock"], "bodyInspected": ["b:true"]}, SAFE),
    ("create-function-container", "usually-safe", {"statementKind": ["s:CreateFunction"], "bodyInspected": ["b:true"]}, SAFE),
    ("container-body-not-inspected", "analyzer-integrity", {"statementKind": ["s:DoBlock", "s:CreateFunction"], "bodyInspected": ["b:false"]}, REVIEW),
    ("nesting-depth-exceeded", "analyzer-integrity", {"statementKind": ["s:Unrecognized"], "nestingLimitExceeded": ["b:true"]}, BLOCKED),
    ("unresolvable-dynamic-sql", "analyzer-integrity", {"statementKind": ["s:ExecuteDynamic"], "dynamicSqlUnresolved": ["b:true"]}, BLOCKED),
    ("disarms-timeout-guc", "analyzer-integrity", {"disarmsTimeout": ["b:true"]}, BLOCKED),
    ("set-guc-non-timeout", "compatibility", {"statementKind": ["s:SetGuc"], "disarmsTimeout": ["b:false"]}, REVIEW),
    ("vacuum-in-migration", "lock-hazard", {"statementKind": ["s:Vacuum"]}, REVIEW),
    ("create-database-in-migration", "compatibility", {"statementKind": ["s:CreateDatabase"]}, REVIEW),
    ("reindex-in-migration", "lock-hazard", {"statementKind": ["s:Reindex"]}, REVIEW),
    ("empty-input", "analyzer-integrity", {"statementKind": ["s:EmptyInput"]}, REVIEW),
    ("pair-not-valid-validated", "usually-safe", {"statementKind": ["s:ValidateConstraint"], "notValid": ["b:true"]}, SAFE),
    ("pair-concurrent-index-unique", "usually-safe", {"statementKind": ["s:AddUniqueConstraint"], "concurrently": ["b:true"]}, SAFE),
    ("pair-validated-check-set-not-null", "usually-safe", {"statementKind": ["s:SetNotNull"], "checkProvesNotNull": ["b:true"]}, SAFE),
]
CATEGORIES = ("irreversible-data-loss", "lock-hazard", "compatibility", "usually-safe", "analyzer-integrity")


def rule_table(spark: SparkSession) -> DataFrame:
    """rule_id, category, match (fact name to accepted typed values), verdict, rationale: 42 rows."""
    rows = [(i, c, m, v, f"{i.replace('-', ' ')}: {c.replace('-', ' ')}") for i, c, m, v in RULES]
    return spark.createDataFrame(rows, "rule_id string, category string, match map<string,array<string>>, verdict string, rationale string")


def severity(verdict: Column) -> Column:
    return F.when(verdict == SAFE, 0).when(verdict == REVIEW, 1).when(verdict == BLOCKED, 2)


def invalid_rules(rules: DataFrame) -> DataFrame:
    """Rules with an empty match (which would match everything), or an unknown category or verdict, or no rationale."""
    bad = (F.size("match") <= 0) | ~F.col("category").isin(*CATEGORIES) | ~F.col("verdict").isin(SAFE, REVIEW, BLOCKED) | (F.coalesce(F.trim("rationale"), F.lit("")) == "")
    return rules.where(bad)


def typed(value: Column, kind: str) -> Column:
    """The typed text of a fact: null matches null alone, and text never equals a boolean."""
    return F.when(value.isNull(), F.lit("n:")).otherwise(F.concat(F.lit(kind + ":"), value.cast("string")))


def classify(facts: DataFrame, rules: DataFrame, key: str | list[str] = "finding_id") -> DataFrame:
    """key, verdict, rule_ids, rationales: every fact row against every rule; no match needs review.

    ``facts`` has ``facts``, a map of fact name to typed text; ``key`` names what else of it goes on. The catalogue is
    a table of fixed size, so it is broadcast as one row and each fact row is judged where it is, without a shuffle.
    Rules that name other kinds of statement than a row's are left out of its search by an index of the catalogue.
    """
    keys = [key] if isinstance(key, str) else key
    catalogue = rules.agg(F.sort_array(F.collect_list(F.struct("rule_id", "rationale", F.col("verdict").alias("rule_verdict"), F.map_entries("match").alias("wanted")))).alias("catalogue"))
    kinds_of = lambda r: F.filter(r["wanted"], lambda e: e["key"] == "statementKind")
    of_kind = lambda k: F.filter("catalogue", lambda r: F.forall(kinds_of(r), lambda e: F.array_contains(e["value"], k)))
    kinds = F.array_distinct(F.flatten(F.flatten(F.transform("catalogue", lambda r: F.transform(kinds_of(r), lambda e: e["value"])))))
    catalogue = catalogue.select(F.map_from_entries(F.transform(F.filter(kinds, lambda k: k.isNotNull()), lambda k: F.struct(k.alias("kind"), of_kind(k).alias("rules")))).alias("by_kind"), F.filter("catalogue", lambda r: F.size(kinds_of(r)) == 0).alias("others"))
    candidates = F.coalesce(F.try_element_at("by_kind", F.try_element_at("facts", F.lit("statementKind"))), F.col("others"))
    held = lambda r: F.forall(r["wanted"], lambda e: F.map_contains_key("facts", e["key"]) & F.array_contains(e["value"], F.try_element_at("facts", e["key"])))
    # Entries behind an explode are computed once, however often they are read.
    hits = F.explode(F.array(F.filter(candidates, held))).alias("hits")
    found = facts.select(*keys, "facts").join(F.broadcast(catalogue), F.lit(True)).select(*keys, hits)
    verdict = F.array_max(F.transform("hits", lambda r: F.struct(severity(r["rule_verdict"]).alias("severity"), r["rule_verdict"].alias("verdict"))))["verdict"]
    none = F.size("hits") == 0
    return found.select(*keys, F.coalesce(verdict, F.lit(REVIEW)).alias("verdict"), F.col("hits.rule_id").alias("rule_ids"), F.when(none, F.array(F.lit(NO_RULE))).otherwise(F.col("hits.rationale")).alias("rationales"))


def worst_verdict(findings: DataFrame, by: str) -> DataFrame:
    """by, verdict, findings: the most severe verdict of each file; all findings count."""
    return findings.groupBy(by).agg(F.max_by("verdict", severity(F.col("verdict"))).alias("verdict"), F.count(F.lit(1)).alias("findings"))


def first_later(left: DataFrame, right: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Each left row with the first right row of the same keys that stands after it (columns later_<name>).

    One window over both sides instead of a range join: in falling order of position the last right row so far
    is the next one, a running value. A key's rows meet in one task.
    """
    names = [c for c in right.columns if c not in keys]
    a = left.withColumn("_side", F.lit(1)).withColumn("_later", F.lit(None).cast(right.select(F.struct(*names).alias("s")).schema["s"].dataType))
    b = right.select(*keys, position, F.lit(0).alias("_side"), F.struct(*names).alias("_later"))
    both = a.unionByName(b, allowMissingColumns=True)
    behind = Window.partitionBy(*keys).orderBy(F.desc(position), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_next", F.last("_later", ignorenulls=True).over(behind)).where("_side = 1 AND _next IS NOT NULL")
    return found.select(*left.columns, *[F.col(f"_next.{c}").alias(f"later_{c}") for c in names])


def apply_pairings(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Findings of pairs become SAFE and gain the pair's rule; later passes win on the partner.

    findings: file, position, verdict, rule_ids, floor and more; pairs: file, position, partner, pass, rule_id.
    Findings on the floor (data loss) are never lowered. Duplicate rule ids are kept. Where findings have rationales (and
    pairs a rationale) those stay in step with the ids, and what stands for no rule goes. Where pairs have a number, paired_with is it.
    """
    shown = "number" if "number" in pairs.columns else "partner"
    told = "rationales" in findings.columns
    gained = pairs.groupBy("file", "position").agg(F.max_by(shown, F.struct("pass", "partner")).alias("paired_with"), F.collect_list(F.struct("rule_id", *(["rationale"] if told else []))).alias("more"))
    # One row per file, joined by file alone: what is grouped by file next meets no second shuffle.
    gained = gained.groupBy("file").agg(F.collect_list(F.struct("position", "paired_with", "more")).alias("gained"))
    mine = F.get(F.filter("gained", lambda g: g["position"] == F.col("position")), F.lit(0))
    joined = findings.join(gained, "file", "left").withColumn("mine", mine).withColumns({"paired_with": F.col("mine.paired_with"), "more": F.col("mine.more")})
    lowered = F.col("more").isNotNull() & ~F.col("floor")
    own = F.arrays_zip("rule_ids", "rationales") if told else F.arrays_zip("rule_ids")
    own = F.transform(F.filter(own, lambda x: x["rule_ids"].isNotNull()), lambda x: F.struct(x["rule_ids"].alias("rule_id"), *([x["rationales"].alias("rationale")] if told else [])))
    joined = joined.withColumn("together", F.when(lowered, F.array_sort(F.concat(own, "more"))))
    more = [F.coalesce(F.col("together.rationale"), F.col("rationales")).alias("rationales")] if told else []
    return joined.select(
        "file",
        "position",
        F.when(lowered, SAFE).otherwise(F.col("verdict")).alias("verdict"),
        F.coalesce(F.col("together.rule_id"), F.col("rule_ids")).alias("rule_ids"),
        F.when(lowered, F.col("paired_with")).alias("paired_with"),
        *more,
        *[c for c in findings.columns if c not in ("file", "position", "verdict", "rule_ids", "rationales", "floor")],
    )


#: What must stay blocked whatever the catalogue says, and what no rule may decide.
FLOOR_FACTS: list[dict[str, str]] = [
    *[{"statementKind": f"s:{k}"} for k in ("DropTable", "DropSchema", "DropDatabase", "Truncate", "DropColumn")],
    *[{"statementKind": f"s:{k}", "hasWhereClause": "b:false"} for k in ("Delete", "Update")],
    {"statementKind": "s:ExecuteDynamic", "dynamicSqlUnresolved": "b:true"},
    *[{"statementKind": f"s:{k}", "disarmsTimeout": "b:true"} for k in ("SetGuc", "AlterSystem", "AlterDatabaseSet", "AlterRoleSet")],
]
_NEUTRAL = {
    **dict.fromkeys(("schema", "table", "column", "constraintName", "indexName", "usingIndexName"), "n:"),
    **dict.fromkeys(("concurrently", "notValid", "checkProvesNotNull", "hasWhereClause", "dynamicSqlUnresolved", "bodyInspected", "transactionHostile", "nestingLimitExceeded", "disarmsTimeout"), "b:false"),
    **{"defaultVolatility": "s:none", "sourceContext": "s:top-level", "nestingDepth": "i:0"},
}
CANARY_FACTS: list[dict[str, str]] = [
    {"statementKind": "s:Unrecognized"},
    *[{"statementKind": "s:Unrecognized", f: "b:true"} for f in ("concurrently", "notValid", "checkProvesNotNull", "hasWhereClause", "dynamicSqlUnresolved", "bodyInspected", "transactionHostile")],
    *[{"statementKind": "s:Unrecognized", "sourceContext": f"s:{c}"} for c in ("do-block", "function-body")],
    *[{"statementKind": "s:Unrecognized", "defaultVolatility": f"s:{v}"} for v in ("literal", "immutable", "stable", "volatile", "unknown-function")],
    {"statementKind": "s:AddUniqueConstraint", "usingIndexName": "s:some_other_index_name"},
]


def catalogue_faults(rules: DataFrame) -> DataFrame:
    """check, subject, verdict of what makes a catalogue unfit: invalid rules, floor facts not blocked, canaries not sent to review."""
    cases = [("floor", i, {**_NEUTRAL, **f}) for i, f in enumerate(FLOOR_FACTS)] + [("canary", i, {**_NEUTRAL, **f}) for i, f in enumerate(CANARY_FACTS)]
    facts = rules.sparkSession.createDataFrame([(f"{c}-{i}", f) for c, i, f in cases], "case string, facts map<string,string>")
    found = classify(facts, rules, "case")
    bad = found.where(F.when(F.col("case").startswith("floor"), F.col("verdict") != BLOCKED).otherwise(F.col("verdict") != REVIEW))
    cases_bad = bad.select(F.substring_index("case", "-", 1).alias("check"), F.col("case").alias("subject"), "verdict")
    return invalid_rules(rules).select(F.lit("rule").alias("check"), F.col("rule_id").alias("subject"), "verdict").unionByName(cases_bad)


def checked_rules(rules: DataFrame) -> DataFrame:
    """The catalogue, once nothing is wrong with it; otherwise an error that names every fault (there are at most 28 and the rules)."""
    faults = catalogue_faults(rules).collect()
    if faults:
        raise ValueError("unfit rules: " + ", ".join(sorted(f"{r['check']} {r['subject']} {r['verdict']}" for r in faults)))
    return rules
