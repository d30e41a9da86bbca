"""Small red and green cases of the library's operators."""

import datetime as dt

from pyspark.sql import functions as F

from sparkguard.operators import audit, history, integrity, nested, report, rules, runner, runs, statements
from sparkguard.sources import tables
from sparkguard.streaming import markers


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_orphans_ignore_incomplete_keys_and_count_composites_whole(spark):
    parent = spark.createDataFrame([(1, 1), (2, 2)], "a int, b int")
    child = spark.createDataFrame([(1, 1), (1, 2), (None, 2), (3, 3)], "x int, y int")
    assert sorted(rows(integrity.orphan_rows(child, ["x", "y"], parent, ["a", "b"]))) == [(1, 2), (3, 3)]


def test_counts_one_way_and_both_ways(spark):
    e = spark.createDataFrame([("a", 1), ("b", 2)], "table_name string, row_count long")
    a = spark.createDataFrame([("a", 1), ("b", 3), ("c", 1)], "table_name string, row_count long")
    assert {r.table_name: r.status for r in integrity.compare_counts(e, a).collect()} == {"a": "ok", "b": "mismatch", "c": "unexpected"}
    assert "c" not in {r.table_name for r in integrity.compare_counts(e, a, both_ways=False).collect()}


def test_hashes_see_repeats_and_empty_text(spark):
    one, two = spark.createDataFrame([("a",)], "t string"), spark.createDataFrame([("a",), ("a",), ("a",)], "t string")
    assert integrity.scalable_hash(one).first() != integrity.scalable_hash(two).first()
    null, empty = spark.createDataFrame([(None,)], "t string"), spark.createDataFrame([("",)], "t string")
    assert integrity.scalable_hash(null).first() != integrity.scalable_hash(empty).first()
    assert integrity.content_hash(one.limit(0), [F.col("t")]).first()["content_md5"] == "d41d8cd98f00b204e9800998ecf8427e"


def test_freshness_is_strict_and_fractional(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    at = lambda s: dt.datetime.fromisoformat(s)
    data = [(at("2024-01-02 00:00:00"), "PASS", True), (at("2024-01-01 23:59:59"), "PASS", True), (None, None, None), (at("2024-01-31"), "FAIL", True), (at("2024-01-31"), "PASS", False)]
    status = spark.createDataFrame(data, "last_run_at timestamp, outcome string, all_tiers boolean")
    assert [r.condition for r in integrity.freshness(status, now).collect()] == ["fresh", "stale", "never-ran", "failed", "incomplete"]


def test_rule_catalogue_is_valid_and_weakened_rules_are_found(spark):
    catalogue = rules.rule_table(spark)
    assert catalogue.count() == 42 and rules.invalid_rules(catalogue).count() == 0
    weak = spark.createDataFrame([("x", "lock-hazard", {}, "SAFE", "r"), ("y", "other", {"a": ["s:b"]}, "SAFE", "r"), ("z", "compatibility", {"a": ["s:b"]}, "SAFE", " ")], catalogue.schema)
    assert rules.invalid_rules(weak).count() == 3


def test_text_true_is_not_boolean_true_and_missing_is_not_null(spark):
    rule = spark.createDataFrame([("r", "compatibility", {"a": ["b:true"], "n": ["n:"]}, "SAFE", "x")], rules.rule_table(spark).schema)
    facts = spark.createDataFrame([(1, {"a": "b:true", "n": "n:"}), (2, {"a": "s:true", "n": "n:"}), (3, {"a": "b:true"})], "finding_id int, facts map<string,string>")
    assert {r.finding_id: r.verdict for r in rules.classify(facts, rule).collect()} == {1: "SAFE", 2: "REVIEW_REQUIRED", 3: "REVIEW_REQUIRED"}


def test_pairing_never_lowers_the_floor(spark):
    f = spark.createDataFrame([("f", 1, "REVIEW_REQUIRED", ["a"], False), ("f", 2, "BLOCKED", ["drop-table"], True), ("f", 3, "SAFE", ["c"], False)], "file string, position int, verdict string, rule_ids array<string>, floor boolean")
    p = spark.createDataFrame([("f", 1, 3, 1, "p"), ("f", 1, 4, 2, "p"), ("f", 2, 3, 1, "p")], "file string, position int, partner int, pass int, rule_id string")
    found = {r.position: r for r in rules.apply_pairings(f, p).collect()}
    assert found[1].verdict == "SAFE" and found[1].rule_ids == ["a", "p", "p"] and found[1].paired_with == 4
    assert found[2].verdict == "BLOCKED" and found[3].rule_ids == ["c"]


def test_first_later_takes_the_next_one_only(spark):
    a = spark.createDataFrame([(1, 10), (1, 20), (1, 50)], "k int, pos int")
    b = spark.createDataFrame([(1, 10), (1, 30), (1, 40)], "k int, pos int")
    assert sorted(rows(rules.first_later(a, b, ["k"], "pos"))) == [(1, 10, 30), (1, 20, 30)]


def test_examples_have_their_verdicts(spark):
    found = {r.file: (r.verdict, r.rule_ids) for r in statements.verdicts(spark.createDataFrame(statements.EXAMPLES, "file string, sql string"), rules.rule_table(spark)).collect()}
    assert found == {f: (v, r) for f, _, v, r in statements._GOLDEN}


def test_unknown_statements_are_never_safe(spark):
    odd = [("a", "CREATE TRIGGER x"), ("b", "DROP TABLE a b c"), ("c", "ALTER TABLE t ENABLE ROW LEVEL SECURITY"), ("d", "GRANT ALL ON t TO x"), ("e", "")]
    found = statements.verdicts(spark.createDataFrame(odd, "file string, sql string"), rules.rule_table(spark))
    assert all(r.verdict != "SAFE" for r in found.collect()) and found.count() == len(odd)


def test_body_statements_and_languages_are_not_taken_for_safe(spark):
    body = "DO $$ DECLARE n int := 1; t text DEFAULT 'x'; BEGIN %s; END $$;"
    review = [body % x for x in ("LOCK TABLE t IN ACCESS EXCLUSIVE MODE", "REFRESH MATERIALIZED VIEW v", "CLUSTER t", "DISCARD ALL", "CALL purge_all()", "IF n > 0 THEN LOCK TABLE t; END IF", "BEGIN CLUSTER t; EXCEPTION WHEN others THEN NULL; END", 'UPDATE t SET "declare" = 1 WHERE a = 2; CLUSTER t; BEGIN NULL; END')]
    other = ["DO LANGUAGE plpython3u $$ import os $$;", "DO $$ import os $$ LANGUAGE 'plpython3u';", "CREATE FUNCTION f() RETURNS int AS $$ return 1 $$ LANGUAGE plperl;"]
    safe = [body % x for x in ("NULL", "n := 2", "IF n > 0 THEN RAISE NOTICE 'LOCK TABLE t'; ELSE NULL; END IF", "FOR i IN 1..2 LOOP CREATE TABLE a (b int); END LOOP", "BEGIN NULL; EXCEPTION WHEN others THEN NULL; END")]
    safe += ["DO LANGUAGE plpgsql $$ BEGIN NULL; END $$;", "CREATE FUNCTION f(language text) RETURNS void AS $$ BEGIN NULL; END $$ LANGUAGE 'plpgsql';"]
    blocked = [body % "EXECUTE 'x'", body % "IF n > 0 THEN DROP TABLE t; END IF"]
    want = {x: v for v, group in (("REVIEW_REQUIRED", review + other), ("SAFE", safe), ("BLOCKED", blocked)) for x in group}
    found = {r.file: r for r in statements.verdicts(spark.createDataFrame([(x, x) for x in want], "file string, sql string"), rules.rule_table(spark)).collect()}
    assert {x: r.verdict for x, r in found.items()} == want
    assert all("container-body-not-inspected" in found[x].rule_ids for x in other)


def test_empty_ledger_leaves_all_pending(spark):
    s = spark.createDataFrame([("a", 1), ("b", 2)], "tag string, `when` long")
    ledger = spark.createDataFrame([], "created_at long")
    assert all(r.pending for r in runner.pending(s, ledger).collect())
    assert [r.pending for r in runner.pending(s, spark.createDataFrame([(1,)], "created_at long")).orderBy("tag").collect()] == [False, True]


def test_transaction_policies(spark):
    s = spark.createDataFrame([("a", False), ("b", True), ("c", True), ("c", False)], "f string, h boolean")
    assert {r.f: r.policy for r in runner.transaction_policy(s, "f", F.col("h")).collect()} == {"a": "wrap", "b": "unwrap", "c": "mixed"}


def test_line_classes_in_order_and_placeholders(spark):
    lines = [("password = hunter2 https://x.y", "CREDENTIAL"), ("token: ${TOKEN}", None), ("see http://db.internal/", "NON_LOOPBACK_HOST"), ("http://localhost:1", None), ("at 8.8.8.8 now", "IP_LITERAL"), ("10.0.0.1 and 300.1.1.1", None), ("ssh me@host", "OPERATIONAL_DETAIL"), ("a" * 20 + "1" * 20, "UNKNOWN_HIGH_ENTROPY"), ("plain", None)]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, x struct<line:string,want:string>").select("i", "x.*")
    assert [(r.got, r.want) for r in df.withColumn("got", audit.line_class(F.col("line"))).orderBy("i").collect()] == [(w, w) for _, w in lines]


def test_line_scan_finds_what_narrow_patterns_miss(spark):
    uri, run = "postgres" + "://", "8f14e45fceea167a5a36dedd4bea2543"
    lines = [
        *[(x, "CREDENTIAL") for x in ("POSTGRES_PASSWORD=hunter2", "DB_SECRET: x", "client_secret=x", "x.apikey = 'k'", uri + "u:pw@localhost/app", '"password": "x"', "-----BEGIN RSA PRIVATE KEY-----", "pwd=x")],
        *[(x + "y", "CREDENTIAL") for x in ("-----BEGIN " + "PRIVATE KEY", "gh" + "p_", "gh" + "o_", "gh" + "s_", "github_" + "pat_", "AK" + "IA")],
        *[(x, None) for x in ("POSTGRES_PASSWORD: ${DB_PW}", "API_TOKEN=my-placeholder", "token=<yours>", "secret=", uri + "u:PLACEHOLDER@localhost:5432/d", "a=token.x", "ssh -v")],
        *[(x, "NON_LOOPBACK_HOST") for x in (uri + "u@db.internal:5432/d", "ssh -i k.pem -p 22 me@box", "SSH me@localhost ssh me@box", "http://example.com/")],
        *[(x, "IP_LITERAL") for x in ("is 8.8.8.8.", "10.0.0.1 8.8.4.4", "10.0.0.1,8.8.4.4", "0.0.0.0")],
        *[(x, None) for x in ("v1.8.8.8.8", "8.8.8.8.8", "130.0.6723.116", "10.1.1.1 172.16.0.1 192.168.1.1 127.0.0.1", "We chose Coolify and Hetzner.")],
        *[(x, "OPERATIONAL_DETAIL") for x in ("coolify at 10.0.0.1", "Hetzner :8080", "coolify in /data/apps", "hetzner box.internal", "scp me@h:/x")],
        *[(x, "UNKNOWN_HIGH_ENTROPY") for x in ("a" * 32, "1" * 32, run, run + "==")],
        ("a" * 31, None),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(lines)], "i int, text string")
    found = {r.i: r["class"] for r in audit.scan_lines(df, "i").collect()}
    assert [(x, found.get(i)) for i, (x, _) in enumerate(lines)] == lines
    assert {r["class"]: r.n for r in audit.class_counts(audit.scan_lines(df, "i")).collect()} == {c: sum(w == c for _, w in lines) for c in audit.CLASSES}
    log = spark.createDataFrame([("commit abc1234\n+++ b/a.env\n+POSTGRES_PASSWORD=hunter2\n-DB_SECRET: x\n",)], "text string").withColumn("log_id", F.lit(1))
    assert rows(audit.scan_log(log)) == [(1, "abc1234", "a.env", 2, "CREDENTIAL")]


def test_name_status_and_porcelain(spark):
    df = spark.createDataFrame([("R100\ta\tb",), ("A\tc",)], "line string")
    assert rows(history.name_status(df)) == [("R100", "b"), ("A", "c")]
    assert spark.range(1).select(history.porcelain_paths(F.lit(" M x/y.sql\r"))).first()[0] == "x/y.sql"


def test_parents_without_children_have_an_empty_array(spark):
    p, c = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "pid int, position int, name string")
    found = {r.id: [x.name for x in r["items"]] for r in nested.with_children(p, c, "id", "pid", "position", ["name"], "items").collect()}
    assert found == {1: ["a", "b"], 2: []}


def test_half_steps_round_up(spark):
    df = spark.createDataFrame([(0.25,), (1.1,), (19.9,), (22.5,), (22.4,)], "n double")
    assert [r[0] for r in df.select(nested.half_step(F.col("n"))).collect()] == [0.5, 1.0, 20.0, 25.0, 20.0]


def test_escape_order(spark):
    assert spark.range(1).select(report.escape_markdown(F.lit("\\`|<>"))).first()[0] == "\\\\\\`\\|&lt;&gt;"


def test_json_sources_fail_on_malformed_records(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"version": "7", "dialect": "x", "entries": [{"idx": 1, "version": "7", "when": 5, "tag": "b", "breakpoints": true}, {"idx": 0, "version": "7", "when": 4, "tag": "a", "breakpoints": true}]}')
    assert [r.tag for r in tables.journal_entries(spark, str(tmp_path / "j.json")).collect()] == ["a", "b"]
    (tmp_path / "one.sql").write_text("SELECT 1;\n")
    assert [r.tag for r in tables.change_scripts(spark, str(tmp_path)).collect()] == ["one"]


def test_streamed_states_equal_the_batch(spark, tmp_path):
    data = spark.createDataFrame([(1, 1, "in_flight"), (1, 2, "applied"), (2, 1, "failed")], "k int, seq int, state string")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    markers.keep_table(markers.latest_states(stream, "k", "seq", "state"), "states", str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(rows(spark.table("states"))) == sorted(rows(runner.latest_state(data, "k", "seq", "state")))


def test_long_strings_and_comments_are_read_whole(spark):
    odd = [
        ("long-string", "COMMENT ON TABLE t IS '" + "it''s; DROP TABLE x; -- " * 20_000 + "'; DROP TABLE y;", "BLOCKED"),
        ("long-comment", "/* " + "*** a / b ** DROP TABLE x; '\n" * 20_000 + " ***/ CREATE TABLE t (a int);", "SAFE"),
        ("long-list", "DROP TABLE " + ", ".join(f"t{k}" for k in range(3000)) + ";", "BLOCKED"),
        ("deep", "CREATE TABLE t (a int CHECK (" + "(" * 30 + "1" + ")" * 30 + " > 0));", "REVIEW_REQUIRED"),
        ("many", "CREATE TABLE t (a int);\n" * 2000, "SAFE"),
        ("null", None, "REVIEW_REQUIRED"),
    ]
    found = statements.verdicts(spark.createDataFrame([r[:2] for r in odd], "file string, sql string"), rules.rule_table(spark))
    assert {r.file: r.verdict for r in found.collect()} == {f: v for f, _, v in odd}


def test_rules_from_json_are_those_of_the_catalogue(spark, tmp_path):
    import json

    import pytest

    def plain(v):
        kind, _, text = v.partition(":")
        return {"n": None, "b": text == "true"}.get(kind, text)

    def shown(values):
        found = [plain(v) for v in values]
        return found if len(found) > 1 else found[0]

    made = [{"id": i, "category": c, "match": {k: shown(v) for k, v in m.items()}, "verdict": v, "rationale": "why"} for i, c, m, v in rules.RULES]
    (tmp_path / "rules.json").write_text(json.dumps({"version": 2, "rules": made}))
    read = rules.checked_rules(tables.rules_file(spark, str(tmp_path / "rules.json")))
    assert {r.rule_id: (r.category, r.match, r.verdict) for r in read.collect()} == {i: (c, m, v) for i, c, m, v in rules.RULES}
    with pytest.raises(ValueError, match="floor floor-3"):
        rules.checked_rules(read.where("rule_id <> 'truncate'"))


def test_backup_restore_and_digests(spark, tmp_path):
    a, b = spark.createDataFrame([(1, None), (2, "")], "id int, t string"), spark.createDataFrame([], "x long")
    tables.backup({"a": a, "b": b}, str(tmp_path / "dump"))
    back = tables.restore(spark, str(tmp_path / "dump"), ["a", "b"], "restored_")
    assert sorted(map(str, rows(back["a"]))) == sorted(map(str, rows(a))) and back["b"].count() == 0
    tables.restore(spark, str(tmp_path / "dump"), ["a"], "restored_")
    assert spark.table("restored_a").count() == 2
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.dump").write_text("one")
    good = tables.file_digests(spark, str(tmp_path / "files"))
    wanted = spark.createDataFrame([("x.dump", good.first().sha256), ("y.dump", "0" * 64)], "file string, sha256 string")
    assert [r.file for r in tables.artifact_faults(wanted, good).collect()] == ["y.dump"]
    tables.ensure_tables(spark, {"run_log": "id long, state string"})
    tables.ensure_tables(spark, {"run_log": "id long, state string"})
    tables.append(spark.createDataFrame([(1, "applied")], "id long, state string"), "run_log")
    assert spark.table("run_log").count() == 1


def test_status_keeps_its_human_half(spark):
    old = spark.createDataFrame([(("2024", "PASS"), ("2023", "by hand"))], "automated struct<at string, outcome string>, human struct<at string, note string>")
    new = tables.with_automated_half(old, spark.createDataFrame([("2025", "FAIL")], "at string, outcome string")).first()
    assert tuple(new.automated) == ("2025", "FAIL") and tuple(new.human) == ("2023", "by hand")
    first = tables.with_automated_half(old.limit(0), spark.createDataFrame([("2025", "PASS")], "at string, outcome string")).first()
    assert first.human is None and first.automated.outcome == "PASS"


def test_run_entries_and_counts(spark):
    import pytest

    log = spark.createDataFrame([(2, "r", "resolved"), (1, "r", "applied"), (3, "s", "odd")], "id long, run_id string, state string")
    assert [r.id for r in runner.run_entries(log, "r").collect()] == [1, 2]
    with pytest.raises(Exception, match="unknown state odd"):
        runner.run_entries(log, "s").collect()
    assert rows(runner.applied_count_fault(log, log)) == [] and rows(runner.applied_count_fault(log, log.limit(1))) == [(3, 1)]
    assert rows(integrity.compare_hashes(log.limit(0).selectExpr("state table_name", "id hash"), log.selectExpr("state table_name", "id hash"))) == [(None, None, None, "nothing-expected")]
    with pytest.raises(ValueError, match="core tables"):
        integrity.collect_manifest({"a": log}, ["a", "b"])


def test_ruleset_contexts_and_payloads(spark):
    import pytest

    kept = spark.createDataFrame([("main", ["lint", "test"]), ("other", [])], "name string, contexts array<string>")
    assert history.expected_contexts(kept, "main") == ["lint", "test"]
    with pytest.raises(ValueError, match="no expected context"):
        history.expected_contexts(kept, "other")
    assert history.journal_or_empty(None, kept).count() == 0 and history.journal_or_empty(kept, kept).count() == 2


def test_bodies_are_examined_eight_levels_deep(spark):
    scripts = spark.createDataFrame([(k, statements.nested(k)) for k in (1, 8, 9)], "file int, sql string")
    found = {r.file: r for r in statements.analysis(scripts, rules.rule_table(spark)).collect()}
    assert {k: r.verdict for k, r in found.items()} == {1: "SAFE", 8: "SAFE", 9: "BLOCKED"}
    last = found[9].findings[-1]
    assert (last.facts.nestingLimitExceeded, last.facts.nestingDepth, last.nestedPath) == (True, 8, [0] * 9)
    assert [f.facts.nestingDepth for f in found[8].findings] == list(range(8))


def test_statements_are_split_where_they_stand(spark):
    sql = 'CREATE TABLE t (id int);\nALTER TABLE t ADD COLUMN c text;\n-- between two; and three\nCREATE INDEX CONCURRENTLY "i;x" ON t (c) ;;  '
    rows_ = [("a", sql), ("b", "-- nothing;\n"), ("c", None), ("d", "é ü;SELECT 'ä;';"), ("e", "CREATE PROCEDURE p() BEGIN ATOMIC SELECT 1; SELECT 2; END; SELECT 3")]
    found = statements.split_statements(spark.createDataFrame(rows_, "file string, sql string")).collect()
    texts = {}
    for r in sorted(found, key=lambda r: (r.file, r.statement_index)):
        texts.setdefault(r.file, []).append(r.text)
        assert dict(rows_)[r.file][r.location : r.location + r.length] == r.text
    assert texts == {
        "a": ["CREATE TABLE t (id int)", "ALTER TABLE t ADD COLUMN c text", 'CREATE INDEX CONCURRENTLY "i;x" ON t (c)'],
        "d": ["é ü", "SELECT 'ä;'"],
        "e": ["CREATE PROCEDURE p() BEGIN ATOMIC SELECT 1; SELECT 2; END", "SELECT 3"],
    }


def test_parse_faults_are_told_from_what_only_looks_like_them(spark):
    fine = ["SELECT $1, '$$', $a$'$a$", "/* ' */ SELECT 1", "(SELECT 1)", "WITH a AS (SELECT ')') SELECT 1;", "", ";", "-- '"]
    bad = {"SELECT '": "open quote or comment", 'SELECT "a': "open quote or comment", "/* SELECT 1": "open quote or comment", "SELECT (1;": "parentheses do not match", "SELECT 1; )": "no command", "DORP TABLE t": "no command"}
    scripts = spark.createDataFrame([(x, x) for x in [*fine, *bad]], "file string, sql string")
    assert {r.file: r.reason for r in statements.parse_faults(scripts).collect()} == bad
    found = {r.file: r for r in statements.analysis(scripts, rules.rule_table(spark)).collect()}
    assert all(found[x].verdict is None and found[x].findings is None and bad[x] in found[x].parse_error for x in bad)
    assert all(found[x].verdict is not None and found[x].parse_error is None for x in fine)


def test_facts_name_what_statements_work_on(spark):
    cases = {
        'DROP TABLE s."Odd ""Name", t': [("DropTable", "s", 'Odd "Name', None, None, None), ("DropTable", None, "t", None, None, None)],
        "DROP SCHEMA s CASCADE": [("DropSchema", "s", None, None, None, None)],
        "DROP INDEX CONCURRENTLY s.i": [("DropIndex", "s", None, None, None, "i")],
        "CREATE UNIQUE INDEX IF NOT EXISTS i ON ONLY s.t (a)": [("CreateIndex", "s", "t", None, None, "i")],
        "ALTER TABLE a.b.t RENAME COLUMN x TO y": [("RenameColumn", "b", "t", "x", None, None)],
        "ALTER TABLE t ADD CONSTRAINT c CHECK (x IS NOT NULL)": [("AddCheckConstraint", None, "t", "x", "c", None)],
        "ALTER TABLE t DROP CONSTRAINT IF EXISTS c": [("DropConstraint", None, "t", None, "c", None)],
        "TRUNCATE s.a, b": [("Truncate", "s", "a", None, None, None)],
        "COMMENT ON COLUMN t.c IS 'x'": [("CommentOn", "t", "c", None, None, None)],
        "DROP DATABASE d": [("DropDatabase", None, "d", None, None, None)],
        "VACUUM FULL s.t": [("Vacuum", None, "t", None, None, None)],
        "UPDATE ONLY s.t SET a = 1": [("Update", "s", "t", None, None, None)],
    }
    found = statements.analysis(spark.createDataFrame([(x, x) for x in cases], "file string, sql string"), rules.rule_table(spark)).collect()
    shown = {r.file: [(f.facts.statementKind, f.facts.schema, f.facts.table, f.facts.column, f.facts.constraintName, f.facts.indexName) for f in r.findings] for r in found}
    assert shown == cases
    assert all(len(f.ruleIds) == len(f.rationales) or f.rationales == [rules.NO_RULE] for r in found for f in r.findings)


def test_ranged_hash_sees_changes_and_repeats(spark):
    one = spark.createDataFrame([(i, str(i % 7)) for i in range(500)], "a int, b string")
    hashed = lambda df: tuple(integrity.ranged_hash(df, [F.col("a"), F.col("b")]).first())
    assert hashed(one) == hashed(one.repartition(7)) != hashed(one.union(one.limit(1)))
    assert hashed(one) != hashed(one.withColumn("b", F.when(F.col("a") == 9, "x").otherwise(F.col("b"))))
    assert hashed(one.limit(0)) == (0, "d41d8cd98f00b204e9800998ecf8427e")


def test_runs_are_planned_gate_by_gate(spark):
    ok, index, drop = "CREATE TABLE t (a int)", "CREATE INDEX CONCURRENTLY i ON t (a)", "DROP TABLE t"
    scripts = [
        *[("plain", k, 10 * k, f"p{k}", x) for k, x in enumerate([ok, index, "", "UPDATE t SET a = 1 WHERE b"])],
        *[("stopped", k, 10 * k, f"s{k}", x) for k, x in enumerate([ok, drop, ok])],
        *[("mixed", k, 10 * k, f"m{k}", x) for k, x in enumerate([ok, f"{index}; {ok}", drop])],
        *[("unread", k, 10 * k, f"u{k}", x) for k, x in enumerate([ok, "SELECT 'open"])],
        *[("stale", k, 10 * k, f"z{k}", x) for k, x in enumerate([ok, ok])],
        *[("late", k, w, f"l{k}", x) for k, (w, x) in enumerate([(5, ok), (30, drop), (31, ok)])],
    ]
    ledger = spark.createDataFrame([("late", 30), ("late", 7), ("other", 99)], "run string, created_at long")
    markers = spark.createDataFrame([("stale", "failed", False), ("plain", "failed", True), ("plain", "resolved", False)], "run string, state string, wrapped boolean")
    entries = runs.plan_runs(spark.createDataFrame(scripts, "run string, idx int, `when` long, tag string, sql string"), ledger, markers, rules.rule_table(spark)).cache()
    assert {r.tag: (r.state, r.verdict, r.statement_count, r.wrapped) for r in entries.collect()} == {
        "p0": ("applied", "SAFE", 1, True),
        "p1": ("applied", "SAFE", 1, False),
        "p2": ("applied", "REVIEW_REQUIRED", 0, True),
        "p3": ("applied", "REVIEW_REQUIRED", 1, True),
        "s0": ("applied", "SAFE", 1, True),
        "s1": ("refused", "BLOCKED", 1, False),
        "s2": ("not-run", None, None, None),
        "m0": ("applied", "SAFE", 1, True),
        "m1": ("refused", "SAFE", 2, False),
        "m2": ("not-run", None, None, None),
        **dict.fromkeys(("u0", "u1", "z0", "z1"), ("not-run", None, None, None)),
        **dict.fromkeys(("l0", "l1"), ("skipped", None, None, None)),
        "l2": ("applied", "SAFE", 1, True),
    }
    found = {r.run: (r.outcome, r.code, r.applied, r.worst_verdict, r.stopped_at) for r in runs.run_outcomes(entries).collect()}
    assert found == {
        "plain": ("APPLIED", 0, 4, "REVIEW_REQUIRED", None),
        "stopped": ("REFUSED_BLOCKED", 21, 1, "BLOCKED", "s1"),
        "mixed": ("REFUSED_MIXED_FILE", 41, 1, "SAFE", "m1"),
        "unread": ("REFUSED_PARSE_FAILURE", 31, 0, "SAFE", None),
        "stale": ("REFUSED_STALE_MARKER", 51, 0, "SAFE", None),
        "late": ("APPLIED", 0, 1, "SAFE", None),
    }
    assert sorted(r.created_at for r in runs.ledger_rows(entries).collect()) == [0, 0, 0, 10, 20, 30, 31]
    entries.unpersist()


def test_entries_are_dealt_to_partitions_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(history, "ENTRIES", 100)
    base = spark.range(1000).select(F.col("id").alias("idx"), F.lit("t").alias("tag"), F.lit(1).alias("when"))
    head = base.where("idx <> 7").withColumn("tag", F.when(F.col("idx") == 8, "u").otherwise(F.col("tag"))).unionByName(base.where("idx = 9"))
    found = history.append_only_entries(base, head)
    assert sorted(rows(found)) == [(7, "missing"), (8, "tag-changed"), (9, "duplicate-index")]
    assert found.rdd.getNumPartitions() >= 21


def test_scripts_of_one_file_are_read_by_all_cores_and_once(spark):
    scripts = spark.range(500).coalesce(1).select(F.col("id").alias("file"), F.lit("DROP /* x */ TABLE t; -- y").alias("sql"))
    told = statements.read(scripts)
    assert len(told.inputFiles()) >= 16 and told.count() == 500
    assert told.select("clean").distinct().first()["clean"] == "drop table t;"


def test_tokens_join_plain_words_and_keep_quotes_apart(spark):
    cases = [("a b-c / d", 1), ("x e'it\\'s' y", 3), ("note'x'", 2), ("a--b\nc", 3), ("a/*b*/c", 3), ("a$b $x$ y $x$", 2), ("(E'q')", 3), ("a - - b", 1)]
    df = spark.createDataFrame(cases, "sql string, n int")
    found = df.select("sql", "n", statements.tokens(F.col("sql")).alias("t")).collect()
    assert [len(r["t"]) for r in found] == [n for _, n in cases] and all("".join(r["t"]) == r["sql"] for r in found)


def test_rules_of_other_kinds_are_searched_where_none_is_named(spark):
    rule = spark.createDataFrame([("any", "compatibility", {"x": ["b:true"]}, "BLOCKED", "r"), ("k", "compatibility", {"statementKind": ["s:A", "s:B"]}, "SAFE", "r"), ("kx", "compatibility", {"statementKind": ["s:B"], "x": ["b:true"]}, "SAFE", "r")], rules.rule_table(spark).schema)
    facts = spark.createDataFrame([(1, {"statementKind": "s:A", "x": "b:false"}), (2, {"statementKind": "s:B", "x": "b:true"}), (3, {"x": "b:true"}), (4, {"statementKind": "s:C", "x": "b:true"}), (5, {"statementKind": "s:C"})], "finding_id int, facts map<string,string>")
    assert {r.finding_id: (r.verdict, r.rule_ids) for r in rules.classify(facts, rule).collect()} == {1: ("SAFE", ["k"]), 2: ("BLOCKED", ["any", "k", "kx"]), 3: ("BLOCKED", ["any"]), 4: ("BLOCKED", ["any"]), 5: ("REVIEW_REQUIRED", [])}


def test_script_code_is_short_enough_to_be_compiled(spark, monkeypatch):
    """The JVM interprets methods of more than 8000 bytes for good, which made each further script dear."""
    sizes, real = [], statements.written

    def measured(df, name, write=True):
        found = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan()).iterator()
        while found.hasNext():
            sizes.append(found.next()._3().maxMethodCodeSize())
        return real(df, name) if write else df

    monkeypatch.setattr(statements, "written", measured)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scripts = spark.createDataFrame([(1, "DROP TABLE a;")], "file long, sql string")
        measured(statements.findings(scripts, rules.rule_table(spark)), "findings", False)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < max(sizes) <= 8000
