"""Exact and near duplicates against brute force."""

import hashlib
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from sparkguard.llm import exact_dedup, ngram_join
from sparkguard.llm.components import _star, components

from .helpers import BASE, awkward


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((str(i), str(keep), len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def test_exact_duplicates(spark):
    rows = [*BASE, (11, "xyz " * 3000), (12, "xyz " * 2999 + "xyz!"), (13, ""), (13, ""), (None, "only nulls"), (None, "only nulls")]
    for size in (4096, 7):
        got = exact_dedup.exact_duplicates(awkward(spark, rows), block_bytes=size).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == exact(rows)
    kept = exact_dedup.drop_exact_duplicates(awkward(spark, rows))
    assert kept.columns == awkward(spark).columns
    assert len({(r.text or "") for r in kept.collect()}) == kept.count() == len({t or "" for _, t in rows})
    assert exact_dedup.exact_duplicates(awkward(spark).limit(0)).count() == 0


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(3)))
    random.seed(3)
    rows = [(i, "".join(random.choice("ab") for _ in range(random.randrange(9)))) for i in range(120)]
    got = exact_dedup.exact_duplicates(awkward(spark, rows), block_bytes=2).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == exact(rows)


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min((x for x in (least.get(root(k)), i) if x is not None), default=None)
    return in_order((rows[k][0], len(sets[k]), least[root(k)]) for k in range(len(rows)))


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def corpus(seed=1, families=12):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(40)]
    out = []
    for _ in range(families):
        base = [word() for _ in range(random.choice([1, 4, 5, 6, 9, 30, 120, 400]))]
        if random.random() < 0.4:
            base += shared
        for _ in range(random.randrange(1, 9)):
            text = list(base)
            for _ in range(random.randrange(0, 1 + len(text) // 25)):
                text[random.randrange(len(text))] = word()
            out.append(" ".join(text).upper() if random.random() < 0.2 else " \n".join(text))
    return list(enumerate(out))


def test_similar_documents_equal_brute_force(spark):
    rows = [*BASE, *((100 + i, t) for i, t in corpus())]
    # Rows without an id, ids that stand for several texts, and rows repeated whole link like others.
    family = corpus(7, 14)
    rows += [(None if k % 3 == 0 else 300 + k // 2, t) for k, (_, t) in enumerate(family)] + [(None, family[0][1])] * 9 + [(301, family[2][1])] * 2
    docs = awkward(spark, rows)
    assert in_order(ngram_join.similar_documents(docs).collect()) == near(rows)
    kept = ngram_join.drop_similar(docs)
    assert kept.columns == docs.columns
    # One row of each component stays, and every row without words.
    numbered = near([(k, t) for k, (_, t) in enumerate(rows)])
    assert kept.count() == sum(n == 0 for _, n, _ in numbered) + len({c for _, n, c in numbered if n})
    assert ngram_join.similar_documents(awkward(spark).limit(0)).count() == 0


def test_large_groups_are_checked_in_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_ELEMENTS", 300)
    monkeypatch.setattr(ngram_join, "FEW", 3)
    rows = [(i, t) for i, t in corpus(4, 10)]
    assert in_order(ngram_join.similar_documents(awkward(spark, rows)).collect()) == near(rows)


def test_a_row_without_an_id_bridges_two_others(spark):
    words = [f"w{k}" for k in range(60)]
    other = lambda *at: " ".join("x" + w if k in at else w for k, w in enumerate(words))
    rows = [(1, other(5)), (None, other()), (3, other(50))]
    a, b = (shingles(rows[k][1]) for k in (0, 2))
    assert 100 * len(a & b) < 80 * len(a | b)
    assert in_order(ngram_join.similar_documents(awkward(spark, rows)).collect()) == near(rows)
    assert {r.component_id for r in ngram_join.similar_documents(awkward(spark, rows)).collect()} == {1}


def test_a_shared_passage_makes_no_large_group(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefghijklm") for _ in range(6))
    passage = [word() for _ in range(70)]
    rows = [(k, " ".join([word() for _ in range(150)] + passage + [word() for _ in range(150)])) for k in range(250)]
    base = [word() for _ in range(200)]
    for k in range(30):  # a family of near copies, all of whose signatures are heavy
        text = list(base)
        text[random.randrange(200)] = word()
        rows.append((1000 + k, " ".join(text)))
    docs = spark.createDataFrame(rows, "rid long, text string")
    found = docs.select("text").mapInArrow(ngram_join._signed(5, 3), "key int, kind int, data binary").groupBy("key").applyInArrow(ngram_join._range_ties, ngram_join._RANGE)
    assert found.where(f"kind = {ngram_join._HEAVY}").select("u").distinct().count() > 200
    sizes = sorted(r["n"] for r in components(ngram_join._candidate_edges(found)).groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect())
    assert sizes == [30]


def test_signatures_meet_for_all_similar_sizes():
    rng = np.random.default_rng(2)
    signer = ngram_join.Signer()
    for size in [1, 2, 3, 4, 5, 8, 9, 10, 11, 25, 60, 200, 501]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            drop = int(rng.integers(0, size // 5 + 1))
            add = int(rng.integers(0, max(0, (len(a) - drop) * 5 // 4 - len(a)) + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = signer.signatures(a), signer.signatures(b)
                assert any(len(np.intersect1d(s, t)) >= max(m, n) >= 1 for s, m in x for t, n in y)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    random.seed(1)
    random.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_round_of_components_is_one_small_plan(spark):
    random.seed(11)
    edges = {(max(p), min(p)) for _ in range(300) if len(set(p := random.sample(range(200), 2))) == 2}
    table = spark.createDataFrame([*edges], "u long, v long")
    near = {x: {b if a == x else a for a, b in edges if x in (a, b)} for x in range(200)}
    large = {(y, min(near[x] | {x})) for x in near for y in near[x] if y > x}
    assert {tuple(r) for r in _star(table, True).collect()} == large
    least = {u: min(v for a, v in edges if a == u) for u, _ in edges}
    small = {(v, least[u]) for u, v in edges if v != least[u]} | set(least.items())
    assert {tuple(r) for r in _star(table, False).collect()} == small
    # What a round reads is written out in its plan again and again; the driver holds that plan and its tasks.
    plan = _star(_star(table, True), False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 4
