"""Registered queries of run gates, reports, manifests and history checks, each over driver tables with computed SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import history, integrity, nested, report, rules, runner, runs, statements
from ..sources.tables import table
from .registry import hash_sql, query

#: Shapes of change scripts by key, and the verdict of each.
_SHAPES = [
    ("COMMENT ON TABLE t{0} IS '-- '; DROP TABLE x{0};", "BLOCKED"),
    ("COMMENT ON TABLE t{0} IS 'DROP TABLE x{0}'; -- DROP TABLE y;", "SAFE"),
    ("UPDATE t SET a = (SELECT b FROM u WHERE u.id = {0});", "BLOCKED"),
    ("UPDATE t SET a = (SELECT max(b) FROM u) WHERE id = {0};", "REVIEW_REQUIRED"),
    ("ALTER TABLE t ADD COLUMN c{0} timestamptz DEFAULT now() + random() * interval '1 day';", "REVIEW_REQUIRED"),
    ("ALTER TABLE t ADD COLUMN c{0} timestamptz DEFAULT now(), ADD COLUMN d int DEFAULT -1;", "SAFE"),
    ("CREATE FUNCTION f{0}() RETURNS void AS 'DROP TABLE t' LANGUAGE sql;", "BLOCKED"),
    ("DO $x$ BEGIN RAISE NOTICE 'DELETE FROM t'; END $x$;", "SAFE"),
    ("CREATE TABLE t{0} (a int, b text DEFAULT '/*'); CREATE INDEX CONCURRENTLY i ON t{0} (a); -- */", "SAFE"),
    ("DO LANGUAGE plperl $$ drop_all({0}) $$;", "REVIEW_REQUIRED"),
    ('ALTER TABLE "a;b" DROP COLUMN c{0};', "BLOCKED"),
]


@query("SELECT o_orderkey, CASE o_orderkey % " + str(len(_SHAPES)) + " ".join(["", *(f"WHEN {i} THEN '{v}'" for i, (_, v) in enumerate(_SHAPES))]) + " END AS verdict FROM orders WHERE o_orderstatus = 'P'")
def generated_script_verdicts(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(t) for t, _ in _SHAPES]), (F.col("o_orderkey") % len(_SHAPES) + 1).cast("int"))
    scripts = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("file"), F.replace(text, F.lit("{0}"), F.col("o_orderkey").cast("string")).alias("sql"))
    return statements.verdicts(scripts, rules.rule_table(spark)).select(F.col("file").alias("o_orderkey"), "verdict")


@query("SELECT CAST(0 AS BIGINT) AS faults, CAST(1 AS BIGINT) AS faults_without_drop_table, CAST(17 AS BIGINT) AS faults_of_a_catch_all, count(*) AS invalid_rules FROM part WHERE p_size % 5 = 0 OR p_partkey % 7 = 1 OR p_partkey % 11 = 2")
def guarded_catalogue(spark, sf_dir):
    """Faults of the catalogue, of weakened ones, and invalid rules among one for each part."""
    fit = rules.rule_table(spark)
    weak = fit.where("rule_id <> 'drop-table'")
    kinds = F.create_map(F.lit("nestingLimitExceeded"), F.array(F.lit("b:false")), F.lit("defaultVolatility"), F.array(*[F.lit(f"s:{v}") for v in ("none", "literal", "immutable", "stable", "volatile", "unknown-function")]))
    wide = fit.unionByName(spark.range(1).select(F.lit("anything").alias("rule_id"), F.lit("usually-safe").alias("category"), kinds.alias("match"), F.lit("BLOCKED").alias("verdict"), F.lit(" ").alias("rationale")))
    key, none = F.col("p_partkey"), F.create_map().cast("map<string,array<string>>")
    one = F.create_map(F.lit("table"), F.array(F.concat(F.lit("s:"), "p_name")))
    made = table(spark, sf_dir, "part").select(key.cast("string").alias("rule_id"), F.lit("compatibility").alias("category"), F.when(F.col("p_size") % 5 == 0, none).otherwise(one).alias("match"), F.when(key % 7 == 1, "MAYBE").otherwise("SAFE").alias("verdict"), F.when(key % 11 == 2, " ").otherwise(F.col("p_type")).alias("rationale"))
    counted = [rules.catalogue_faults(c).agg(F.count(F.lit(1)).alias(n)) for c, n in ((fit, "faults"), (weak, "faults_without_drop_table"), (wide, "faults_of_a_catch_all"))]
    counted.append(rules.invalid_rules(made).agg(F.count(F.lit(1)).alias("invalid_rules")))
    out = counted[0]
    for c in counted[1:]:
        out = out.join(F.broadcast(c), F.lit(True))
    return out


@query(
    """WITH s AS (SELECT *, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 21 WHEN o_orderkey % 5 = 0 THEN 41 END AS refusal FROM orders),
    f AS (SELECT o_custkey, bool_or(o_totalprice > 499000) AS stale, bool_or(o_totalprice < 3000) AS unparsed, min(o_orderkey) FILTER (WHERE refusal IS NOT NULL) AS first_at, arg_min(refusal, o_orderkey) FILTER (WHERE refusal IS NOT NULL) AS refusal FROM s GROUP BY o_custkey)
    SELECT o_custkey, CASE WHEN stale THEN 'REFUSED_STALE_MARKER' WHEN unparsed THEN 'REFUSED_PARSE_FAILURE' WHEN refusal = 21 THEN 'REFUSED_BLOCKED' WHEN refusal = 41 THEN 'REFUSED_MIXED_FILE' ELSE 'APPLIED' END AS outcome,
      CASE WHEN stale THEN 51 WHEN unparsed THEN 31 ELSE coalesce(refusal, 0) END AS code, CASE WHEN NOT stale AND NOT unparsed THEN first_at END AS refused_at FROM f"""
)
def run_gates(spark, sf_dir):
    price = F.col("o_totalprice")
    return runner.run_gates(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", price > 499000, price < 3000, (F.col("o_orderstatus") == "F") & (price > 400000), F.col("o_orderkey") % 5 == 0)


_STATE = "CASE event_type WHEN 'error' THEN 'in_flight' WHEN 'view' THEN 'failed' ELSE 'applied' END"


def _markers(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.expr(_STATE).alias("state"), (F.col("value") >= 50).alias("wrapped"))


@query(
    f"""SELECT user_id, 'unresolved: ' || string_agg(event_type || ' (' || {_STATE} || ')', ', ' ORDER BY event_id) AS message
    FROM events WHERE event_type = 'error' OR (event_type = 'view' AND NOT (value >= 50)) GROUP BY user_id"""
)
def stale_marker_messages(spark, sf_dir):
    return runner.stale_markers(_markers(spark, sf_dir), "user_id", "event_type")


@query("SELECT event_id AS id, 'resolved' AS state, ts AS finished_at FROM events WHERE event_type = 'error' OR (event_type = 'view' AND NOT (value >= 50))")
def resolved_events(spark, sf_dir):
    with_time = _markers(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts"), "id")
    return runner.resolve_events(with_time, F.col("ts")).select("id", "state", "finished_at")


@query(
    """SELECT 'marker' AS kind, CAST(event_id AS VARCHAR) AS subject FROM events WHERE event_type = 'error' OR (event_type = 'view' AND NOT (value >= 50))
    UNION ALL SELECT 'invalid-index', p_brand || '.' || p_name FROM part WHERE p_size > 40"""
)
def recovery_report(spark, sf_dir):
    invalid = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_brand").alias("schema_name"), F.col("p_name").alias("index_name"))
    return runner.recovery_report(_markers(spark, sf_dir), invalid)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'skipped' ELSE 'applied' END AS state, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS duration FROM orders")
def run_report(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    skipped = orders.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("skipped").alias("state"))
    applied = orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.lit("applied").alias("state"), F.col("o_totalprice").alias("duration"))
    return runner.run_report(skipped, applied, "o_orderkey")


_VERDICT = "CASE o_orderstatus WHEN 'O' THEN 'SAFE' WHEN 'P' THEN 'REVIEW_REQUIRED' ELSE 'BLOCKED' END"


def _findings(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr(_VERDICT).alias("verdict"), "o_orderpriority")


@query(
    f"""SELECT count(DISTINCT o_custkey) AS files, count(*) AS findings, count(*) FILTER (WHERE v = 'SAFE') AS safe, count(*) FILTER (WHERE v = 'REVIEW_REQUIRED') AS review, count(*) FILTER (WHERE v = 'BLOCKED') AS blocked,
      CASE WHEN bool_or(v = 'BLOCKED') THEN 'BLOCKED' WHEN bool_or(v = 'REVIEW_REQUIRED') THEN 'REVIEW_REQUIRED' ELSE 'SAFE' END AS worst FROM (SELECT *, {_VERDICT} AS v FROM orders)"""
)
def report_totals(spark, sf_dir):
    return report.totals(_findings(spark, sf_dir), "o_custkey")


@query(f"""SELECT o_custkey, '[' || string_agg('{{"o_orderkey":' || o_orderkey || ',"verdict":"' || {_VERDICT} || '"}}', ',' ORDER BY o_orderkey) || ']' AS report FROM orders GROUP BY o_custkey""")
def findings_json(spark, sf_dir):
    return report.findings_json(_findings(spark, sf_dir), "o_custkey", "o_orderkey", ["verdict"])


@query(
    f"""SELECT o_custkey, o_custkey || ': ' || CASE WHEN bool_or(v = 'BLOCKED') THEN 'BLOCKED' WHEN bool_or(v = 'REVIEW_REQUIRED') THEN 'REVIEW_REQUIRED' ELSE 'SAFE' END || chr(10) ||
      string_agg('  statement ' || o_orderkey || ': ' || v || CASE WHEN v = 'REVIEW_REQUIRED' THEN ' [(no rule matched)]' ELSE ' [' || lower(v) || ', x] ' || o_orderpriority END, chr(10) ORDER BY o_orderkey) AS body
    FROM (SELECT *, {_VERDICT} AS v FROM orders) GROUP BY o_custkey"""
)
def findings_lines(spark, sf_dir):
    review = F.col("verdict") == "REVIEW_REQUIRED"
    none = F.array().cast("array<string>")
    rows = _findings(spark, sf_dir).withColumns({"rule_ids": F.when(review, none).otherwise(F.array(F.lower("verdict"), F.lit("x"))), "rationales": F.when(review, none).otherwise(F.array("o_orderpriority"))})
    return report.findings_lines(rows, "o_custkey", "o_orderkey")


@query(
    """SELECT user_id, '<!-- check -->' || s || '## Check could not run' || s || 'No verdict could be given. The check fails until the cause is removed.' || s || '**Reason:** ' || event_type || s || replace(replace(props, '|', '\\|'), '<', '&lt;') AS body
    FROM (SELECT *, chr(10) || chr(10) AS s FROM events WHERE event_type = 'error')"""
)
def failure_comments(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    return rows.select("user_id", report.failure_comment("<!-- check -->", F.col("event_type"), F.col("props")).alias("body"))


@query(
    """SELECT a.agreement, count(l.doc_id) AS n FROM (VALUES ('agree'), ('disagree'), ('unknown')) a(agreement)
    LEFT JOIN labels l ON a.agreement = CASE WHEN quality IS NULL THEN 'unknown' WHEN (quality = 0) = (toxic <> 0) THEN 'agree' ELSE 'disagree' END GROUP BY a.agreement"""
)
def agreement_counts(spark, sf_dir):
    verdict = F.when(F.col("toxic") == 0, "SAFE").otherwise("BLOCKED")
    return report.agreement_counts(table(spark, sf_dir, "labels").select(report.agreement(F.col("quality") == 0, verdict).alias("agreement")))


_MONEY = "CAST({0} AS DECIMAL(18,2))"
_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", _MONEY.format("c_acctbal"), "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", _MONEY.format("s_acctbal")],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", _MONEY.format("p_retailprice")],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", _MONEY.format("o_totalprice"), "CAST(o_orderdate AS DATE)", "o_orderpriority"],
    "events": ["event_id", "user_id", "event_type", _MONEY.format("value"), "props"],
    "labels": ["doc_id", "quality", "toxic"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "benchmark": ["item_id", "text"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


def _texts(spark, sf_dir, name):
    return table(spark, sf_dir, name).select(*[F.expr(c).alias(f"c{i}") for i, c in enumerate(_COLUMNS[name])])


@query(" UNION ALL ".join(hash_sql(t, c) for t, c in _COLUMNS.items()))
def manifest_collection(spark, sf_dir):
    return integrity.collect_manifest({t: _texts(spark, sf_dir, t) for t in _COLUMNS}, ["orders", "customer"])


@query(
    """WITH e AS (SELECT c_nationkey AS k, sum(c_custkey) AS h FROM customer GROUP BY 1), a AS (SELECT c_nationkey AS k, sum(c_custkey) AS h FROM customer WHERE c_nationkey <> 3 AND c_custkey % 100 <> 7 GROUP BY 1)
    SELECT CAST(e.k AS VARCHAR) AS table_name, CAST(e.h AS BIGINT) AS expected_hash, CAST(a.h AS BIGINT) AS actual_hash, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.h = a.h THEN 'ok' ELSE 'mismatch' END AS status FROM e LEFT JOIN a ON e.k = a.k"""
)
def hash_comparison(spark, sf_dir):
    def sums(df):
        return df.groupBy(F.col("c_nationkey").cast("string").alias("table_name")).agg(F.sum("c_custkey").alias("hash"))

    customers = table(spark, sf_dir, "customer")
    return integrity.compare_hashes(sums(customers), sums(customers.where("c_nationkey <> 3 AND c_custkey % 100 <> 7")))


@query("SELECT user_id, CASE WHEN arg_max(event_type, event_id) = 'purchase' THEN 'passed' ELSE 'failed' END AS condition FROM events GROUP BY user_id")
def passed_check(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_run_at"), F.max_by("event_type", "event_id").alias("type"))
    return integrity.passed(last.withColumn("outcome", F.when(F.col("type") == "purchase", "PASS").otherwise("FAIL"))).select("user_id", "condition")


@query("SELECT o_custkey, CASE WHEN bool_and(o_totalprice > 20000) THEN 'PASS' ELSE 'FAIL' END AS outcome FROM orders GROUP BY o_custkey")
def drill_outcomes(spark, sf_dir):
    return integrity.drill_outcome(table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") > 20000).alias("passed")), "o_custkey")


@query("SELECT doc_id, text IS NOT NULL AND trim(text) <> '' AND doc_id % 3 <> 0 AS equal FROM documents WHERE text NOT LIKE '%--%' AND text NOT LIKE '%' || chr(13) || '%' AND text NOT LIKE '%' || chr(92) || '%'")
def schema_equality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(~(F.col("text").contains("--") | F.col("text").contains("\r") | F.col("text").contains("\\")))
    dumped = F.concat(F.lit("-- dumped\r\n\\restrict x\r\n"), F.col("text"), F.lit("\n\\unrestrict x\n"))
    other = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit(" CREATE"))).otherwise(F.col("text"))
    return docs.select("doc_id", integrity.schemas_equal(F.trim(dumped), other).alias("equal"))


@query("SELECT o_orderkey, o_orderkey % 4 < 2 AS equal FROM orders")
def json_equality(spark, sf_dir):
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    left = F.concat(F.lit('{"a": '), key, F.lit(', "b": ["'), status, F.lit('", null]}'))
    right = F.concat(F.lit('{"b":["'), status, F.when(F.col("o_orderkey") % 4 == 2, '"]').otherwise('",null]'), F.lit(',"a":'), key, F.when(F.col("o_orderkey") % 4 == 3, "").otherwise("}"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.json_equal(left, right).alias("equal"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS step_number, nullif(CASE l_returnflag WHEN 'N' THEN '' ELSE l_returnflag END, '') AS timer, substr(l_linestatus, 1, 1) AS letter FROM lineitem")
def numbered_steps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").alias("at"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("timer"), nested.first_letter(F.col("l_linestatus")).alias("letter"))
    return nested.numbered_steps(rows, "l_orderkey", "at", "timer").drop("at").withColumn("step_number", F.col("step_number").cast("long"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE l_linestatus END AS l_linestatus, CASE WHEN l_quantity = 1 THEN 'Scaled for one' ELSE 'Scaled for ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS label FROM lineitem")
def backfilled_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", nested.servings_label(F.col("l_quantity")).alias("label"))
    return nested.backfilled(rows, "l_linestatus", F.lit("returned"), F.col("l_returnflag") == "R").drop("l_returnflag")


@query("SELECT * FROM (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1) UNION ALL SELECT c_custkey, c_name FROM customer WHERE false")
def find_first(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    found = nested.find_first(customers, "c_mktsegment", "BUILDING", "c_custkey")
    return found.unionByName(nested.find_first(customers, "c_mktsegment", "none such", "c_custkey")).drop("c_mktsegment")


_IMPORTS = ["import x from './a'", "import y from '../b'", "import z from '../../c'", "const w = require(\"./../../../d\")", "// import v from '../../../e'", "export * from \"../packages/../../f\"", "await import('../../../pkg/g')"]


@query(
    """SELECT path, unnest(CASE k WHEN 2 THEN ['../../c'] WHEN 3 THEN ['./../../../d'] WHEN 5 THEN ['../packages/../../f'] WHEN 6 THEN ['../../../pkg/g'] ELSE [] END) AS specifier
    FROM (SELECT 'pkg/src/f' || o_orderkey || '.ts' AS path, o_orderkey % 7 AS k FROM orders WHERE o_orderkey % 2 = 0)"""
)
def escaping_imports(spark, sf_dir):
    line = F.element_at(F.array(*map(F.lit, _IMPORTS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    path = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "pkg/src/f").otherwise("pkg-other/src/f"), F.col("o_orderkey").cast("string"), F.lit(".ts"))
    files = table(spark, sf_dir, "orders").select(path.alias("path"), F.concat(F.lit("// code\n"), line, F.lit(";\nrun();\n")).alias("text"))
    return history.escaping_imports(files, "pkg")


@query(
    """SELECT o_orderkey, concat_ws('; ', CASE o_orderkey % 4 WHEN 0 THEN 'bypass list absent' WHEN 1 THEN 'bypass list not-empty' END, CASE WHEN o_orderstatus = 'F' THEN 'not active' END, CASE WHEN o_orderkey % 3 = 0 THEN 'no required context' END) AS faults FROM orders"""
)
def payload_faults(spark, sf_dir):
    key = F.col("o_orderkey")
    contexts = F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("lint")))
    bypass = F.when(key % 4 == 0, None).when(key % 4 == 1, "[1]").otherwise("[]")
    rows = table(spark, sf_dir, "orders").select(key.cast("string").alias("name"), F.when(F.col("o_orderstatus") == "F", "disabled").otherwise("active").alias("enforcement"), contexts.alias("contexts"), F.array(F.lit("update")).alias("rules"), F.parse_json(bypass).alias("bypass_actors"))
    return history.payload_faults(rows).select(F.col("name").cast("long").alias("o_orderkey"), F.array_join("faults", "; ").alias("faults"))


#: Location, length and fault of the shapes of ``_SPLIT``, whose numbers stand for {0}.
_SPLIT = [
    "-- first\nCREATE TABLE t{0} (a int);\nALTER TABLE t{0} ADD COLUMN c text DEFAULT ';';\n-- a comment; between\nCREATE INDEX CONCURRENTLY i ON t{0} (c)",
    "  ;; /* nothing; */ ;",
    "CREATE FUNCTION f{0}() RETURNS void LANGUAGE sql BEGIN ATOMIC DELETE FROM t; DELETE FROM u; END; DO $x$ BEGIN NULL; END $x$;",
]


@query(
    """WITH s AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, length(CAST(o_orderkey AS VARCHAR)) AS n, o_orderkey % 3 AS m FROM orders),
    p AS (SELECT o_orderkey, 0 AS i, 9 AS l, 'CREATE TABLE t' || k || ' (a int)' AS text FROM s WHERE m = 0
      UNION ALL SELECT o_orderkey, 1, 33 + n, 'ALTER TABLE t' || k || ' ADD COLUMN c text DEFAULT ' || chr(39) || ';' || chr(39) FROM s WHERE m = 0
      UNION ALL SELECT o_orderkey, 2, 100 + 2 * n, 'CREATE INDEX CONCURRENTLY i ON t' || k || ' (c)' FROM s WHERE m = 0
      UNION ALL SELECT o_orderkey, 0, 0, 'CREATE FUNCTION f' || k || '() RETURNS void LANGUAGE sql BEGIN ATOMIC DELETE FROM t; DELETE FROM u; END' FROM s WHERE m = 2
      UNION ALL SELECT o_orderkey, 1, 94 + n, 'DO $x$ BEGIN NULL; END $x$' FROM s WHERE m = 2)
    SELECT o_orderkey AS file, i AS statement_index, CAST(l AS INTEGER) AS location, CAST(length(text) AS INTEGER) AS length, text FROM p"""
)
def statement_spans(spark, sf_dir):
    sql = F.replace(F.element_at(F.array(*map(F.lit, _SPLIT)), (F.col("o_orderkey") % 3 + 1).cast("int")), F.lit("{0}"), F.col("o_orderkey").cast("string"))
    return statements.split_statements(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), sql.alias("sql")))


#: Shapes that cannot be SQL, where and why ({0} is a number of n digits); the last one can.
_FAULTY = [
    ("CREATE TABLE t{0} (a text DEFAULT 'x);", "32 + n", "open quote or comment"),
    ("/* {0} */ CREATE TABLE (((;", "23 + n", "parentheses do not match"),
    ("CREATE TABLE t{0} (a int); SELEC 1;", "25 + n", "no command"),
    ("COMMENT ON TABLE t{0} IS '('; /* open", "28 + n", "open quote or comment"),
    ("ALTER TYPE m{0} DROP VALUE 'sad';", "1", "values of a type cannot be dropped"),
    ("DO $a$ BEGIN NULL; END $a{0}$;", "4", "open quote or comment"),
    ("SELECT '(', $${0} ' ($$;", None, None),
]


@query("SELECT o_orderkey AS file, CAST(at_character AS INTEGER) AS at_character, reason FROM (" + " UNION ALL ".join(f"SELECT o_orderkey, {at} AS at_character, '{why}' AS reason FROM (SELECT o_orderkey, length(CAST(o_orderkey AS VARCHAR)) AS n FROM orders WHERE o_orderkey % {len(_FAULTY)} = {k})" for k, (_, at, why) in enumerate(_FAULTY) if why) + ")")
def script_parse_faults(spark, sf_dir):
    sql = F.replace(F.element_at(F.array(*[F.lit(t) for t, _, _ in _FAULTY]), (F.col("o_orderkey") % len(_FAULTY) + 1).cast("int")), F.lit("{0}"), F.col("o_orderkey").cast("string"))
    return statements.parse_faults(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), sql.alias("sql")))


@query(
    """WITH n AS (SELECT p_partkey, 't' || p_partkey AS t FROM part)
    SELECT p_partkey AS file, 'BLOCKED' AS verdict, CAST(3 AS BIGINT) AS statement_count, '0::AddForeignKey:' || t || '::fk:SAFE:add-foreign-key-not-valid,pair-not-valid-validated:2 1.0::AddColumn:' || t || ':c::SAFE:add-column-nullable-no-default: 1.1::DropColumn:' || t || ':Old Name::BLOCKED:drop-column: 2::ValidateConstraint:' || t || '::fk:SAFE:pair-not-valid-validated,validate-constraint:0' AS findings FROM n WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 'BLOCKED', 1, '0::DoBlock::::SAFE:do-block-container: 0.0:do-block:DropTable:' || t || ':::BLOCKED:drop-table: 0.1:do-block:ExecuteDynamic::::BLOCKED:unresolvable-dynamic-sql:' FROM n WHERE p_partkey % 2 = 1"""
)
def script_analysis(spark, sf_dir):
    """Statement, path, context, kind, names, verdict, rules and partner of every finding of each part's script."""
    shapes = [
        'ALTER TABLE s.t{0} ADD CONSTRAINT fk FOREIGN KEY (a) REFERENCES b (id) NOT VALID; ALTER TABLE s.t{0} ADD COLUMN c int, DROP COLUMN "Old Name"; ALTER TABLE s.t{0} VALIDATE CONSTRAINT fk;',
        "DO $x$ DECLARE n int; BEGIN IF n > 1 THEN DROP TABLE s.t{0}; END IF; EXECUTE 'x' || n; END $x$;",
    ]
    sql = F.replace(F.element_at(F.array(*map(F.lit, shapes)), (F.col("p_partkey") % 2 + 1).cast("int")), F.lit("{0}"), F.col("p_partkey").cast("string"))
    found = statements.analysis(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), sql.alias("sql")), rules.rule_table(spark))
    at = lambda x: F.when(F.size(x["nestedPath"]) > 0, F.array_join(x["nestedPath"].cast("array<string>"), ".")).otherwise(x["statementIndex"].cast("string"))
    context = lambda x: F.when(x["facts"]["sourceContext"] != "top-level", x["facts"]["sourceContext"]).otherwise("")
    names = ("table", "column", "constraintName")
    one = lambda x: F.concat_ws(":", at(x), context(x), x["facts"]["statementKind"], *[F.coalesce(x["facts"][f], F.lit("")) for f in names], x["verdict"], F.array_join(x["ruleIds"], ","), F.coalesce(x["pairedWith"].cast("string"), F.lit("")))
    return found.select("file", "verdict", "statement_count", F.array_join(F.transform("findings", one), " ").alias("findings"))


_RANGED = ("customer", "orders", "events", "documents")


@query(
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count, md5(coalesce(string_agg(hash, chr(30) ORDER BY r), '')) AS content_md5 FROM (
        SELECT r, sum(n) AS n, md5(string_agg(line || chr(31) || n, chr(30) ORDER BY line || chr(31) || n)) AS hash FROM (SELECT line, substr(md5(line), 1, 2) AS r, count(*) AS n FROM (SELECT concat_ws(chr(31), {", ".join(_COLUMNS[t])}) AS line FROM {t}) GROUP BY 1, 2) GROUP BY r)"""
        for t in _RANGED
    )
)
def content_hash_ranged(spark, sf_dir):
    parts = []
    for t in _RANGED:
        texts = _texts(spark, sf_dir, t)
        parts.append(integrity.ranged_hash(texts, [F.col(c) for c in texts.columns]).select(F.lit(t).alias("table_name"), "row_count", "content_md5"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Scripts by the remainder of their key, and verdict and policy of each; all others are the last one.
_RUN_SHAPES = {
    1: ("CREATE INDEX CONCURRENTLY i{0} ON t (a);", "SAFE", "unwrap"),
    2: ("ALTER TABLE t{0} ALTER COLUMN a SET NOT NULL; CREATE TABLE u (a int);", "REVIEW_REQUIRED", "wrap"),
    3: ("CREATE TABLE a (b int); DROP TABLE t{0};", "BLOCKED", "wrap"),
    4: ("CREATE INDEX CONCURRENTLY i{0} ON t (a); CREATE TABLE u{0} (a int);", "SAFE", "mixed"),
    5: ("-- nothing yet {0}", "REVIEW_REQUIRED", "wrap"),
}
_PLAIN_SHAPE = ("CREATE TABLE t{0} (a int);", "SAFE", "wrap")
_RUN_MODULUS, _UNREADABLE = 40, 131
_RUNS_SQL = f"""WITH s AS (SELECT o_custkey AS run, o_orderkey AS idx, 't' || o_orderkey AS tag, epoch_ms(o_orderdate) AS ms, o_orderkey % {_RUN_MODULUS} AS shape, o_orderkey % {_UNREADABLE} = 0 AS unreadable FROM orders),
    l AS (SELECT o_custkey AS run, max(epoch_ms(o_orderdate)) AS last_at FROM orders WHERE o_totalprice > 450000 GROUP BY 1),
    m AS (SELECT DISTINCT user_id AS run FROM events WHERE event_id % 97 = 0 AND (event_type = 'error' OR (event_type = 'view' AND NOT (value >= 50)))),
    p AS (SELECT s.*, coalesce(last_at < ms, true) AS pending, m.run IS NOT NULL AS stale FROM s LEFT JOIN l USING (run) LEFT JOIN m ON m.run = s.run),
    u AS (SELECT *, coalesce(bool_or(unreadable AND pending) OVER (PARTITION BY run), false) AS unparsed FROM p),
    f AS (SELECT *, CASE WHEN pending AND NOT stale AND NOT unparsed THEN CASE shape WHEN 3 THEN 'REFUSED_BLOCKED' WHEN 4 THEN 'REFUSED_MIXED_FILE' END END AS refusal FROM u),
    e AS (SELECT *, arg_min(refusal, idx) FILTER (WHERE refusal IS NOT NULL) OVER (PARTITION BY run) AS stop, min(idx) FILTER (WHERE refusal IS NOT NULL) OVER (PARTITION BY run) AS stop_at FROM f),
    r AS (SELECT *, CASE WHEN NOT pending THEN 'skipped' WHEN stale OR unparsed OR idx > stop_at THEN 'not-run' WHEN idx = stop_at THEN 'refused' ELSE 'applied' END AS state,
      CASE WHEN stale THEN 'REFUSED_STALE_MARKER' WHEN unparsed THEN 'REFUSED_PARSE_FAILURE' ELSE coalesce(stop, 'APPLIED') END AS outcome, CASE shape WHEN 2 THEN 'REVIEW_REQUIRED' WHEN 5 THEN 'REVIEW_REQUIRED' WHEN 3 THEN 'BLOCKED' ELSE 'SAFE' END AS v FROM e)"""


def _planned(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    sql = F.lit(_PLAIN_SHAPE[0])
    for k, (text, _, _) in _RUN_SHAPES.items():
        sql = F.when(key % _RUN_MODULUS == k, text).otherwise(sql)
    sql = F.replace(F.when(key % _UNREADABLE == 0, "CREATE TABLE t{0} (").otherwise(sql), F.lit("{0}"), key.cast("string"))
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    scripts = orders.select(F.col("o_custkey").alias("run"), key.alias("idx"), at.alias("when"), F.concat(F.lit("t"), key.cast("string")).alias("tag"), sql.alias("sql"))
    ledger = orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("run"), at.alias("created_at"))
    markers = _markers(spark, sf_dir).where("id % 97 = 0").withColumnRenamed("user_id", "run")
    return runs.plan_runs(scripts, ledger, markers, rules.rule_table(spark))


@query(
    _RUNS_SQL
    + """ SELECT run, idx, tag, state, CASE WHEN state IN ('applied', 'refused') THEN v END AS verdict, CASE WHEN state IN ('applied', 'refused') THEN CASE shape WHEN 5 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 1 END END AS statement_count,
      CASE state WHEN 'applied' THEN shape <> 1 WHEN 'refused' THEN false END AS wrapped, outcome FROM r"""
)
def planned_runs(spark, sf_dir):
    return _planned(spark, sf_dir).select("run", "idx", "tag", "state", "verdict", "statement_count", "wrapped", "outcome")


@query(
    _RUNS_SQL
    + """ SELECT run, any_value(outcome) AS outcome, CASE any_value(outcome) WHEN 'APPLIED' THEN 0 WHEN 'REFUSED_BLOCKED' THEN 21 WHEN 'REFUSED_PARSE_FAILURE' THEN 31 WHEN 'REFUSED_MIXED_FILE' THEN 41 ELSE 51 END AS code, count(*) FILTER (WHERE state = 'applied') AS applied,
      CASE max(CASE WHEN state IN ('applied', 'refused') THEN CASE v WHEN 'SAFE' THEN 0 WHEN 'REVIEW_REQUIRED' THEN 1 ELSE 2 END ELSE 0 END) WHEN 0 THEN 'SAFE' WHEN 1 THEN 'REVIEW_REQUIRED' ELSE 'BLOCKED' END AS worst_verdict, max(CASE WHEN state = 'refused' THEN tag END) AS stopped_at FROM r GROUP BY run"""
)
def planned_outcomes(spark, sf_dir):
    return runs.run_outcomes(_planned(spark, sf_dir))
