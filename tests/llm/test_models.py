"""Classifiers, search and chat formatting."""

import json
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkguard.llm import chat_format, language_id, topk_search, toxicity
from sparkguard.llm.common import materialize
from sparkguard.llm.queries import ORACLE_SQL, QUERIES

from .helpers import BASE, awkward

SF = "/root/testdata/sf0.01"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_language_of_held_out_texts(spark):
    words = {"en": ["the", "house", "with", "this", "thing"], "de": ["der", "schön", "nicht", "ungefähr", "zwischen"], "fr": ["être", "avec", "où", "voilà", "ceux"]}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i, lang in enumerate(np.resize(list(words), 240).tolist())]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 !?", "en"), (None, "the house", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.held_out_predictions(docs).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]) > 0.95
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_anything_to_learn(spark):
    docs = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.held_out_predictions(docs).collect()} == {"und"}
    assert language_id.held_out_predictions(docs.limit(0)).count() == 0
    model = language_id.train(awkward(spark))
    assert language_id.predict(awkward(spark), model).columns == [c for c in awkward(spark).columns if c != "score"] + ["lang_pred", "score"]


def test_toxicity_of_held_out_texts(spark):
    rng = np.random.default_rng(2)
    plain = ["stone", "river", "window", "green", "quiet", "paper", "tree", "cloud"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join([*rng.choice(plain, 15), *(["nastyword"] if bad else [])])))
        labels.append((i, int(bad), int(bad)))
    labels += [(None, 1, 1), (5, None, None)]
    docs, marks = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.held_out_scores(docs, marks).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400))
    assert got[900].score == got[901].score and 0 <= got[900].score < 0.5
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))


def test_toxicity_of_long_texts_with_one_word(spark):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("aeioulnrst"), rng.integers(3, 9))) for _ in range(2000)]
    rows = []
    for i in range(500):
        words = list(rng.choice(plain, 40 if i % 2 else 700))
        rows.append((i, " ".join([*words[:20], *(["nastyword"] if i % 5 == 0 else []), *words[20:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(500)], "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.held_out_scores(docs, marks).collect() if r.held_out]
    assert np.mean([r.predicted for r in held if r.doc_id % 5 == 0]) > 0.9
    assert np.mean([r.predicted for r in held if r.doc_id % 5]) < 0.05


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.held_out_scores(awkward(spark), none).collect()
    assert len(got) == len(BASE) and {r.predicted for r in got} == {0}
    assert toxicity.held_out_scores(awkward(spark).limit(0), none).count() == 0


@there
def test_models_on_held_out_rows_of_the_table(spark):
    docs, marks = spark.read.parquet(SF + "/documents.parquet"), spark.read.parquet(SF + "/labels.parquet")
    lang = {r.doc_id: r.lang for r in docs.where("lang IS NOT NULL").collect()}
    found = [r for r in language_id.held_out_predictions(docs).collect() if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert len(found) > 100 and np.mean([r.lang_pred == lang[r.doc_id] for r in found]) > 0.97
    toxic = {r.doc_id: r.toxic for r in marks.where("toxic IS NOT NULL").collect()}
    rows = [(r.score, toxic[r.doc_id]) for r in toxicity.held_out_scores(docs, marks).collect() if r.held_out and r.doc_id in toxic]
    bad, good = [s for s, t in rows if t], [s for s, t in rows if not t]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.9


def test_draws_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 70, f"words {i} of {'dies' if i % 3 else 'this'} text " * (1 + i % 4), "de" if i % 3 else "en") for i in range(400)]
    docs = spark.createDataFrame([*rows, *rows[:50]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(70)], "doc_id long, toxic int")
    other = docs.repartition(7, "text").sortWithinPartitions(F.desc("text"))
    a, b = language_id.train(docs, training=60), language_id.train(other, training=60)
    assert a.languages == b.languages and np.array_equal(a.values, b.values)
    a, b = toxicity.train(docs, labels, (9, 15)), toxicity.train(other, labels, (9, 15))
    assert a.bias == b.bias and np.array_equal(a.weight, b.weight)


def test_every_language_is_learned(spark):
    rows = [(i, chr(0x100 + i % 450) * 8, f"l{i % 450}") for i in range(900)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) > 420


def test_language_model_equals_plain_kernels():
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdefgh" if k % 2 else "efghijkl"), 30)) for k in range(40)]
    import pyarrow as pa

    from sparkguard.llm.grams import presence

    slots = list(presence(pa.array(texts), language_id.ORDERS, language_id.BITS, pad=True))
    langs = ["x" if k % 2 else "y" for k in range(30)]
    model = language_id.fit([s.astype("<i4") for s in slots[:30]], langs, 100)
    sets = [set(s.tolist()) for s in slots]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets[:30]] for a in sets])
    values, vectors = np.linalg.eigh(kernel[:30])
    good = values > 1e-6 * values[-1]
    z = kernel @ (vectors[:, good] / np.sqrt(values[good]))
    goal = np.array([[1.0 if n == m else -1.0 for m in ("x", "y")] for n in langs])  # both languages weigh the same
    centre, middle = z[:30].mean(axis=0), goal.mean(axis=0)
    coef = np.linalg.solve((z[:30] - centre).T @ (z[:30] - centre) + language_id.RIDGE * np.eye(z.shape[1]), (z[:30] - centre).T @ (goal - middle))
    plain = (z[30:] - centre) @ coef + middle
    held = np.zeros((10, language_id.SIZE), np.float32)
    for k, s in enumerate(slots[30:]):
        held[k, s] = 1
    assert np.allclose((held @ model.values) / np.sqrt(held.sum(axis=1, keepdims=True)) + model.bias, plain, atol=1e-3)
    best, _ = model.predict(pa.array(texts[30:]))
    assert [model.languages[b] for b in best] == ["x" if k % 2 else "y" for k in range(30, 40)]


def test_toxicity_ratios_equal_plain_counts(monkeypatch):
    monkeypatch.setattr(toxicity, "CONFIDENT", 0)  # six documents make no ratio certain
    docs = [[0, 1, 2], [0, 1], [0, 1, 3], [2, 3], [2, 3, 0], [3, 2, 4]]
    toxic = np.array([1, 1, 1, 0, 0, 0])
    model = toxicity.fit([np.array(d) for d in docs], toxic, 6)
    p, q = ([1 + sum(s in d for d, t in zip(docs, toxic, strict=True) if t == c) for s in range(6)] for c in (1, 0))
    for s in range(6):
        ratio = math.log((p[s] / sum(p)) / (q[s] / sum(q)))
        seen = p[s] + q[s] - 2 >= toxicity.MIN_DOCUMENTS
        assert math.isclose(model.square[s], ratio**2 if seen else 0, rel_tol=1e-5)
        assert model.weight[s] * ratio >= 0  # each slot speaks for the class that its ratio names
    scores = [model.score(np.array(d)) for d in docs]
    assert min(scores[:3]) > 0.5 > max(scores[3:])


def test_toxicity_leaves_out_slots_of_uncertain_ratio():
    docs = [[0, 1, 2], [0, 1], [0, 1, 3], [2, 3], [2, 3, 0], [3, 2, 4]] * 6
    toxic = np.array([1, 1, 1, 0, 0, 0] * 6)
    model = toxicity.fit([np.array(d) for d in docs], toxic, 6)
    p, q = ([1 + sum(s in d for d, t in zip(docs, toxic, strict=True) if t == c) for s in range(6)] for c in (1, 0))
    for s in range(6):
        ratio = math.log((p[s] / sum(p)) / (q[s] / sum(q)))
        certain = abs(ratio) >= toxicity.CONFIDENT * math.sqrt(1 / p[s] + 1 / q[s])
        assert certain == (s < 4)  # slot 4 is within two standard errors of 0, slot 5 in no document
        assert math.isclose(model.square[s], ratio**2 if certain else 0, rel_tol=1e-5)


def brute_top_k(rows, k, every):
    """Exact integers; a product beyond a long counts as the nearest long."""
    whole = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows]
    out = []
    for a, (i, q) in enumerate(whole):
        if i % every == 0:
            score = lambda v: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, v, strict=True))))  # noqa: B023, E731
            best = sorted((-score(v), j) for b, (j, v) in enumerate(whole) if b != a and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 40)).astype(np.float32) * rng.gamma(1.0, size=(900, 1)).astype(np.float32)
    vectors[100:160] = vectors[7]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2200, [1.0])]
    bad = [(2000, None), (2050, [float("nan")] * 40), (2100, [None] * 40), (2150, [float("inf")] * 40), (2250, []), (None, vectors[0].tolist())]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>").withColumn("block", F.lit("x")).withColumn("score", F.lit(1))
    assert sorted(tuple(r) for r in topk_search.top_k(df).collect()) == brute_top_k(rows, 5, 50)
    few = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [1.0, 2.0])]
    assert sorted(tuple(r) for r in topk_search.top_k(spark.createDataFrame(few, df.select("vec_id", "embedding").schema)).collect()) == brute_top_k(few, 5, 50)
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_top_k_with_repeated_ids_lengths_and_huge_components(spark):
    rng = np.random.default_rng(5)
    sizes = rng.choice([1, 3, 1e3, 1e6, 1e12, 1e15, 1e300], size=300)
    rows = [(int(i) % 220, (rng.normal(size=12) * s).tolist()) for i, s in enumerate(sizes)]
    rows += [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (1, [3.0, 5.0]), (2, [1.0, 0.0]), (50, [1.0, 1.0, 1.0]), (100, [0.0] * 12), (100, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk_search.top_k(df).collect()) == brute_top_k(rows, 5, 50)


@there
def test_bounds_prune_most_products(spark):
    products, computed = topk_search.pruning(spark.read.parquet(SF + "/embeddings.parquet"))
    assert 0 < computed < 0.2 * products
    # Lengths that differ leave whole stripes out before they are shuffled.
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=16) * (100 if i % 50 == 7 else 0.01)).tolist()) for i in range(4000)]
    products, computed = topk_search.pruning(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert products < 0.5 * 80 * 4000 and computed < 0.2 * products


def test_pruned_blocks_give_the_same():
    rng = np.random.default_rng(4)
    basis = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    decay = np.exp(-np.arange(48) / 5)
    make = lambda n: np.floor(256 * (rng.normal(size=(n, 48)) * decay) @ basis.T)
    q, blocks = make(60), [(np.arange(500) + 1000 * b, np.arange(500) + 1000 * b, np.floor(make(500) / (1 + b))) for b in range(4)]
    turned, tally = np.linalg.eigh(sum(v.T @ v for _, _, v in blocks))[1][:, ::-1], [0, 0]
    _, ids, scores = topk_search.block_top_k(q, np.arange(60), np.full(60, -np.inf), blocks, turned, 5, tally)
    assert tally[0] == 60 * 2000 and tally[1] < 0.6 * tally[0]
    every, all_v = np.concatenate([i for _, i, _ in blocks]), np.concatenate([v for _, _, v in blocks])
    for r in range(60):
        s = all_v @ q[r]
        s[every == r] = -np.inf
        order = np.lexsort((every, -s))[:5]
        assert ids[r].tolist() == every[order].tolist() and scores[r].tolist() == s[order].tolist()


def test_preferences(spark):
    turns = [(1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 2, "user", "oh"), (2, "chosen", 0, None, None), (None, "chosen", 0, "user", "x"), (3, "other", 0, "user", "x")]
    df = spark.createDataFrame([(*t, "extra", "p") for t in turns], "pair_id long, side string, turn int, role string, text string, n string, prompt string")
    got = {r.pair_id: r for r in chat_format.format_preferences(df).collect()}
    assert set(got) == {1, 2}
    one = got[1]
    assert one.n_prompt_turns == 1 and one.prompt == "<|user|>\nhi<|end|>\n" and one.chosen == "<|assistant|>\ngood<|end|>\n"
    assert [one.chosen[a:b] for a, b in one.chosen_spans] == ["good<|end|>"] and [one.rejected[a:b] for a, b in one.rejected_spans] == ["bad<|end|>"]
    assert got[2].prompt == "" and got[2].rejected == "" and got[2].chosen == "<||>\n<|end|>\n"
    assert chat_format.format_preferences(df.limit(0)).count() == 0


def test_pairs_of_large_and_negative_ids_and_repeated_turns(spark):
    ids = [2**53, 2**53 + 1, 2**53 + 2, 2**62, 2**62 + 1, -4, -3, -2, -1, 0, 1, None]
    turns = [(i, 0, "user", "hi") for i in ids] + [(i, 1, "assistant", f"a{i}") for i in ids] + [(0, 1, "assistant", "a0")] * 2 + [(1, None, "system", "s")]
    pairs = chat_format.neighbouring_pairs(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("pair_id", F.lit("x")))
    got = {r.pair_id: r for r in chat_format.format_preferences(pairs).collect()}
    assert set(got) == {i // 2 for i in ids if i is not None}
    assert got[-2].chosen.startswith("<|assistant|>\na-4") and got[-2].rejected.startswith("<|assistant|>\na-3") and got[2**52].n_prompt_turns == 1
    assert got[0].n_prompt_turns == 0 and got[0].chosen.count("a0<|end|>") == 3 and got[0].rejected.startswith("<|system|>")


@there
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    import duckdb

    found = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    theirs = sorted(json.dumps({c: str(v) for c, v in zip(columns, r, strict=True)}, sort_keys=True) for r in want.fetchall())
    assert sorted(json.dumps({c: str(v) for c, v in r.asDict().items()}, sort_keys=True) for r in found.collect()) == theirs


def plain_exact(rows):
    last = {}
    for i, text in rows:
        last[text or ""] = max(i, last.get(text or "", i))
    return set(last.values())


def plain_near(rows):
    """Smallest ids of the components of 5-word Jaccard >= 0.8, by counting over an inverted index."""
    sets, held, parent = {}, defaultdict(list), {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        common = Counter(j for e in sets[i] for j in held[e])
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for e in sets[i]:
            held[e].append(i)
    return {i for i in sets if root(i) == i}


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    docs = spark.read.parquet(SF + "/documents.parquet")
    extra = spark.createDataFrame([(100001, None, "en", "s", 0), (100002, "123 456", "en", "s", 7)], docs.schema)
    plain = {
        "language_id": lambda rows: {i for i, t in rows if t and any(c.isalpha() for c in t)},
        "exact_dedup": plain_exact,
        "near_dedup": plain_near,
    }
    before = docs.unionByName(extra)
    for name, stage in pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, SF), "test-stage")
        assert after.columns == docs.columns
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        kept = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(set(kept)) == len(kept)
        if name in plain:
            assert set(kept) == plain[name](rows)
        else:
            toxic = {r.doc_id for r in spark.read.parquet(SF + "/labels.parquet").where("toxic = 1").collect()}
            gone = {i for i, _ in rows} - set(kept)
            assert len(gone & toxic) > 0.8 * len(toxic & {i for i, _ in rows}) and len(gone) < 0.2 * len(rows)
        before = after
    packed = pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096
    assert packed.select("doc_id").distinct().count() == before.count()
