"""SuperMinHash signatures against the plain algorithm, near duplicates against brute force."""

import random

import numpy as np
import pytest

from sparkguard.llm import minhash
from sparkguard.llm.queries import op13_minhash_dedup

from .helpers import BASE, awkward

SF = "/root/testdata/sf0.01"


def plain_signature(elements, slots):
    """One element after the other with its permutation written out, all places."""
    out = [1 << 64] * slots
    for e in elements.tolist():
        order = list(range(slots))
        for j in range(slots):
            fraction, k = (int(x[0]) for x in minhash._draws(np.array([e], np.uint64), j, slots))
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], j << 32 | fraction)
    return out


def test_signatures_equal_the_plain_algorithm():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 3, 7, 40, 400)]
    for slots in (5, 16, 192):
        got = minhash.super_minhash(sets, slots)
        assert got.tolist() == [plain_signature(s, slots) for s in sets]
    assert minhash.super_minhash([], 16).shape == (0, 16)


@pytest.mark.parametrize("size", [20, 300])
def test_estimates_are_unbiased_and_vary_less_than_independent_hashes(size):
    rng, slots, errors = np.random.default_rng(size), 64, []
    for _ in range(300):
        union = rng.integers(0, 1 << 63, size).astype(np.uint64)
        shared = int(size * 0.85)
        extra = (size - shared) // 2
        a, b = minhash.super_minhash([union[: shared + extra], np.concatenate([union[:shared], union[shared + extra :]])], slots)
        errors.append((a == b).mean() - shared / size)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.85 * 0.15 / slots * (0.8 if size == 20 else 1.2)


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 3]) for k in range(len(words) - 2)) if len(words) >= 3 else frozenset([tuple(words)] if words else [])


def near(rows):
    sets = [shingles(t) for _, t in rows]
    holders, parent = {}, list(range(len(rows)))
    for k, s in enumerate(sets):
        for e in s:
            holders.setdefault(e, []).append(k)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, s in enumerate(sets):
        common = {}
        for e in s:
            for b in holders[e]:
                if b > a:
                    common[b] = common.get(b, 0) + 1
        for b, n in common.items():
            if 100 * n >= 85 * (len(s) + len(sets[b]) - n):
                parent[root(b)] = root(a)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(k)
    out = []
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        first = min(ids, default=None)
        for k in members:
            i = rows[k][0]
            out.append((i, len(sets[k]), first, i == first if i is not None and first is not None else first is None and k == members[0]))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_awkward_rows_and_families(spark):
    random.seed(4)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = [*BASE, (40, "One two"), (41, "one TWO"), (None, "one two"), (50, "lone null"), (None, "no id here"), (None, "no id here")]
    at = 100
    for size in (12, 60):
        base = random.choices(vocabulary, k=size * 4)
        for step in range(14):  # a chain of texts, each near the one before
            rows.append((at, " ".join(base)))
            base = list(base)
            base[random.randrange(len(base))] = random.choice(vocabulary)
            at += 1
    passage = random.choices(vocabulary, k=30)
    for _ in range(40):  # a passage that many texts share ties none of them
        rows.append((at, " ".join(random.choices(vocabulary, k=40) + passage)))
        at += 1
    random.shuffle(rows)
    docs = awkward(spark, rows)
    assert found(minhash.near_duplicates(docs)) == near(rows)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    blank = [i for i, t in rows if not (t or "").split() and i is not None]
    firsts = {eval(r)[2] for r in near(rows)} - {None}
    assert ids == sorted(firsts | set(blank))
    assert minhash.near_duplicates(awkward(spark).limit(0)).count() == 0


def test_query_over_the_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_minhash_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(got) == near(docs)
