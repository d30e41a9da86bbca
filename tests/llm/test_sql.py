"""SQL of the operators on word sets and sequences against them, over awkward rows (test_models holds all SQL against its query)."""

import duckdb
import pytest

from sparkguard.llm import minhash, ngram_join, periodic_runs, sql

from .helpers import BASE, EXTRA


def rows(columns, found):
    order = sorted(columns)
    return sorted(tuple(str(r[columns.index(c)]) for c in order) for r in found)


LINE = "one two three four five six seven eight nine ten eleven twelve "
AWKWARD = [r for r in BASE if r[0] is not None] + [
    (11, LINE * 4),
    (12, (LINE * 4).upper()),
    (13, LINE * 3 + "thirteen"),
    (14, "a a b " * 12 + "c " + "a a b " * 9),
    (15, "xyz\t" * 40 + " wide space\u000bend"),
    (16, " ".join(f"w{i}" for i in range(50)) + " last"),
    (17, " ".join(f"w{i}" for i in range(50))),
    (18, "word"),
    (19, "WORD again"),
]


@pytest.mark.parametrize(
    ("statement", "query"),
    [
        (sql.similar_sets(5, 80), ngram_join.similar_documents),
        (sql.similar_sets(3, 85, kept=True), minhash.near_duplicates),
        (sql.PERIODIC_RUNS, lambda docs: periodic_runs.run_digests(periodic_runs.planted(docs))),
    ],
    ids=["ngram_join", "minhash", "periodic_runs"],
)
@pytest.mark.parametrize("data", [AWKWARD, []], ids=["awkward", "empty"])
def test_awkward_rows_equal_sql(spark, statement, query, data):
    docs = spark.createDataFrame([(i, t, "en", "s", None, 0.5, True, 1, "b", "g", "r") for i, t in data], EXTRA)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if data:
        con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    want = con.execute(statement)
    columns = [d[0] for d in want.description]
    found = query(docs)
    assert rows(found.columns, found.collect()) == rows(columns, want.fetchall())
