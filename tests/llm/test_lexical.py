"""Ranked lexical search against plain scoring and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from sparkguard.llm import lexical
from sparkguard.llm.queries import op12_lexical_search

from .helpers import BASE, awkward

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_terms(text):
    return re.findall(lexical.TERM, (text or "").translate(LOWER))


def plain_search(items, docs, k=10):
    held = [(i, Counter(plain_terms(t)), len(plain_terms(t))) for i, t in docs]
    big_n, big_l = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for i, counts, n in held:
            score = 0
            for t in set(plain_terms(text)):
                if t in counts:
                    m = 10 + 90 * n * big_n // big_l
                    score += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1000000000 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item_id, r + 1, None if last else i, -s) for r, (s, last, i) in enumerate(sorted(scored)[:k])]
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_terms():
    texts = ["Don't STOP-me 12é3\x00x", "", None, " \t--", "ÀB ÇD e_f", "Ünï cödé"]
    for cut in (pa.array(texts), pa.array(["skipped One", *texts]).slice(1)):
        assert lexical.terms(cut).to_pylist() == [plain_terms(t) for t in texts]


def test_awkward_rows(spark):
    rows = [*BASE, (12, "the cat"), (12, "the cat"), (None, "the cat"), (20, "cat"), (21, "dog dog dog")]
    items = [(1, "The cat sat: cat!"), (1, "dog"), (None, "xyz word"), (3, None), (4, " ,"), (5, "absent"), (6, "Ünïcödé é 123"), (7, "a text without an id")]
    asked = spark.createDataFrame([(i, t, "d", 1.5) for i, t in items], "item_id long, text string, doc_id string, score double")
    assert found(lexical.search(asked, awkward(spark, rows))) == plain_search(items, rows)
    assert found(lexical.search(asked, awkward(spark, rows), k=2)) == plain_search(items, rows, 2)
    for a, d in ((asked.limit(0), awkward(spark)), (asked, awkward(spark).limit(0)), (asked.where("item_id = 3"), awkward(spark))):
        none = lexical.search(a, d)
        assert none.columns == ["item_id", "rank", "doc_id", "score"]
        assert none.count() == 0


def test_many_blocks_of_items_and_documents(spark, monkeypatch):
    random.seed(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(random.choices(words, weights=range(1, 61), k=random.randrange(1, 40)))) for i in range(300)] + [(1000 + i, "w3 w4") for i in range(40)]
    items = [(i, " ".join(random.sample(words, 6))) for i in range(25)]
    monkeypatch.setattr(lexical, "ITEM_ENTRIES", 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert found(lexical.search(spark.createDataFrame(items, "item_id long, text string"), docs)) == plain_search(items, rows)


def test_best_over_blocks_keeps_ties_by_id():
    best = lexical._Best(2, 2)
    put = lambda *rows: best.add(*(np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.int64, np.int64, bool, np.int64), strict=True)))
    put((0, 5, False, 9), (0, 5, False, 7), (1, 1, True, 0))
    put((0, 5, False, 8), (1, 1, False, 30), (0, 4, False, 1))
    assert list(zip(best.item.tolist(), best.score.tolist(), best.doc.tolist(), strict=True)) == [(0, 5, 7), (0, 5, 8), (1, 1, 30), (1, 1, 0)]
    assert best.floor.tolist() == [5, 1]


def test_long_documents_of_large_corpora():
    lengths = np.array([0, 3, 10**8], np.int64)
    assert lexical.length_norms(lengths, 10**11, 10**14).tolist() == [10 + 90 * n * 10**11 // 10**14 for n in lengths.tolist()]


def test_query_over_the_whole_table(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = op12_lexical_search(spark, SF)
    assert found(got) == sorted(map(repr, con.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical.ORACLE})").fetchall()))
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    assert found(got) == plain_search([tuple(r) for r in items.select("item_id", "text").collect()], [tuple(r) for r in docs.select("doc_id", "text").collect()])
