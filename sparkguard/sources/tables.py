"""Readers with declared schemas; nothing is inferred and malformed records fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL = "version string, dialect string, entries array<struct<idx int, version string, `when` bigint, tag string, breakpoints boolean>>"
LEDGER = "id int, hash string, created_at bigint"
RUN_LOG = (
    "id bigint, run_id string, migration_tag string, migration_idx int, sql_sha256 string, verdict string, findings array<struct<statementIndex int, verdict string, ruleIds array<string>>>, "
    "wrapped boolean, state string, statement_index int, statement_count int, error_message string, started_at timestamp, finished_at timestamp, duration_ms int, rules_version int"
)
MANIFEST = (
    "takenAt string, postgresVersion string, gitCommit string, appliedMigrationCount int, dataDump struct<file string, sha256 string>, globalsDump struct<file string, sha256 string>, "
    "rowCounts map<string,bigint>, contentHashes map<string,string>, spotChecks struct<recipes array<struct<slug string, baseServings int, baseKcal int>>, "
    "ingredients array<struct<name string, quantity string, unit string, position int>>, steps array<struct<position int, timerLabel string>>>, "
    "sequences array<struct<schemaName string, sequenceName string, lastValue bigint>>"
)
DRILL_STATUS = "automated struct<lastRunAt string, outcome string, tiers map<string,boolean>, durationMs map<string,double>>, human struct<lastRunAt string, outcome string, timings map<string,string>>"
HISTORY_STATUS = "lastRunAt string, outcome string, suiteConfig string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, in the declared schema."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def journal_entries(spark: SparkSession, path: str) -> DataFrame:
    """idx, when, tag, breakpoints in order."""
    return json_records(spark, path, JOURNAL).select(F.explode("entries").alias("e")).select("e.*").orderBy("idx")


def change_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """tag, sql, sha256 of every .sql file; the tag is the file's name."""
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.sql").text(folder)
    return texts.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.sql$", 1).alias("tag"), F.col("value").alias("sql"), F.sha2(F.col("value").cast("binary"), 256).alias("sha256"))


def newest_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest whose file name sorts last."""
    read = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*-manifest.json")
    return read.json(folder).withColumn("path", F.input_file_name()).orderBy(F.desc("path")).limit(1)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, sha256 of files up to the 2 GB that one binary value holds."""
    return spark.read.format("binaryFile").load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest_faults(manifest: DataFrame) -> DataFrame:
    """field, value that breaks the manifest's form: digests of 64 or 32 hex digits, counts from 0."""
    digests = manifest.select(F.explode(F.array(F.struct(F.lit("dataDump").alias("field"), F.col("dataDump.sha256").alias("value")), F.struct(F.lit("globalsDump").alias("field"), F.col("globalsDump.sha256").alias("value")))).alias("x")).select("x.*")
    hashes = manifest.select(F.explode("contentHashes").alias("field", "value")).where(~F.col("value").rlike("^[0-9a-f]{32}$"))
    counts = manifest.select(F.explode("rowCounts").alias("field", "n")).where("n < 0").select("field", F.col("n").cast("string").alias("value"))
    return digests.where(F.col("value").isNull() | ~F.col("value").rlike("^[0-9a-f]{64}$")).unionByName(hashes).unionByName(counts)


def append(df: DataFrame, table_name: str) -> None:
    """Rows are only ever added: states are events, and the latest one is a query."""
    df.write.mode("append").saveAsTable(table_name)


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}.parquet")


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


CORPUS = "entries array<struct<file string, `group` string, expectedVerdict string, expectedRuleIds array<string>, why string, pairId string, half string>>"
RULES_FILE = "version int, rules array<struct<id string, category string, match string, verdict string, rationale string>>, notes string"


def corpus_entries(spark: SparkSession, path: str) -> DataFrame:
    """file, group, expectedVerdict, expectedRuleIds, why, pairId, half of a corpus manifest."""
    return json_records(spark, path, CORPUS).select(F.explode("entries").alias("e")).select("e.*")


def rules_file(spark: SparkSession, path: str) -> DataFrame:
    """rule_id, category, match, verdict, rationale of a JSON catalogue; matched values become typed texts.

    A value is one or a list of texts, booleans, numbers or null.
    """
    rows = json_records(spark, path, RULES_FILE).select(F.explode("rules").alias("r")).select("r.*")
    raw = lambda v: F.when(v.isNull() | (v == "null"), "n:").when(v.isin("true", "false"), F.concat(F.lit("b:"), v)).when(v.rlike(r"^-?[0-9]"), F.concat(F.lit("i:"), v)).otherwise(F.concat(F.lit("s:"), F.regexp_replace(v, '^"|"$', "")))
    entries = F.map_from_entries(F.transform(F.json_object_keys("match"), lambda k: F.struct(k, F.to_json(F.variant_get(F.parse_json("match"), F.lit("$"), "map<string,variant>")[k]))))
    values = F.transform_values(entries, lambda k, v: F.when(v.startswith("["), F.transform(F.from_json(v, "array<variant>"), lambda x: raw(F.to_json(x)))).otherwise(F.array(raw(v))))
    return rows.select(F.col("id").alias("rule_id"), "category", values.alias("match"), "verdict", "rationale")


def artifact_faults(artifacts: DataFrame, digests: DataFrame) -> DataFrame:
    """file, expected, found of files (file, sha256) of a manifest that are missing or have another digest."""
    actual = digests.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("sha256").alias("found"))
    return artifacts.select("file", F.col("sha256").alias("expected")).join(actual, "file", "left").where(~F.col("expected").eqNullSafe(F.col("found")))


def restore(spark: SparkSession, folder: str, names: list[str], prefix: str = "") -> dict[str, DataFrame]:
    """Tables of a backup written over those of the session's catalog."""
    out = {}
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").write.mode("overwrite").saveAsTable(prefix + name)
        out[name] = spark.table(prefix + name)
    return out


def ensure_tables(spark: SparkSession, schemas: dict[str, str]) -> None:
    """Empty tables of declared columns, where they are not there yet."""
    for name, columns in schemas.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def with_automated_half(status: DataFrame, automated: DataFrame) -> DataFrame:
    """A drill status whose automated half is replaced by the one row of ``automated``; the human half is carried through."""
    return automated.select(F.struct("*").alias("automated")).join(F.broadcast(status.select("human").limit(1)), F.lit(True), "left")


def session_facts(spark: SparkSession) -> DataFrame:
    """database, version of the session."""
    return spark.range(1).select(F.current_database().alias("database"), F.version().alias("version"))
