"""Periodic runs against plain search: every period, every stretch."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sparkguard.llm import periodic_runs
from sparkguard.llm.queries import op11_periodic_runs

from .helpers import BASE, awkward

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=24, times=3):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and not any(words[i : i + length - d] == words[i + d : i + length] for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_words(doc_id, text, plant=True):
    words = re.findall(periodic_runs.WORD, text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or not plant or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def collapsed(words, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def plain_digests(doc_id, text):
    words = plain_words(doc_id, text)
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, runs))]
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *sha)


def shown(rows):
    return sorted(map(repr, rows))


def test_texts_of_few_words():
    random.seed(5)
    for _ in range(300):
        docs = []
        for _ in range(random.randrange(1, 6)):
            k, n = random.choice([1, 2, 2, 3, 4, 8]), random.randrange(120)
            w = [random.randrange(k) for _ in range(n)]
            if n > 5 and random.random() < 0.5:
                a = random.randrange(n)
                p = 1 + (n - a) // random.choice([2, 3, 4, 5, 8])
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
                w = w + w[: random.randrange(n)] + w if random.random() < 0.5 else w
            docs.append(w)
        least, times = random.choice([(24, 3), (2, 2), (5, 2), (4, 3), (1, 4), (12, 2)])
        got = periodic_runs.text_runs(np.array([c for d in docs for c in d], np.int64), np.cumsum([len(d) for d in docs]), least, times)
        assert [tuple(map(int, r)) for r in got] == [(t, *r) for t, d in enumerate(docs) for r in plain_runs(d, least, times)]


def test_rotations_are_found_by_walking():
    # The square's rotations lie in places of their own, apart from its first occurrence.
    words = list("abcabc") + ["x"] + list("bcabca") + ["y"] + list("cabcab") + ["z"] + list("bcabcabc")
    codes = np.unique(words, return_inverse=True)[1].astype(np.int64)
    s = periodic_runs.Suffixes(codes, np.array([len(codes)]))
    start, period = periodic_runs.covering_squares(s, 2)
    assert (period == 3).sum() >= 1
    got = periodic_runs.text_runs(codes, np.array([len(codes)]), 2, 2)
    assert [tuple(r[1:].tolist()) for r in got] == plain_runs(words, 2, 2)


def test_overlap_is_the_least_of_any_run():
    assert periodic_runs.overlap(24, 3) == 16
    assert periodic_runs.overlap(2, 2) == 1


def test_awkward_rows(spark):
    rows = [*BASE, (12, ("a b\tc\x0b" * 30).strip()), (12, ("a b c " * 30) + "end"), (None, "x " * 50), (13, "one " * 23), (14, "one " * 24), (15, "ä ö " * 20)]
    got = periodic_runs.find_runs(awkward(spark, rows)).collect()
    want = []
    for i, t in rows:
        words = plain_words(i, t, plant=False)
        runs = plain_runs(words)
        want.append((i, runs, collapsed(words, runs)))
    assert shown((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got) == shown(want)
    digests = periodic_runs.run_digests(periodic_runs.planted(awkward(spark, rows))).collect()
    assert shown(tuple(r) for r in digests) == shown(plain_digests(i, t) for i, t in rows)
    assert periodic_runs.run_digests(periodic_runs.planted(awkward(spark).limit(0))).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(awkward(spark), times=1)


def test_query_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = op11_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = got.collect()
    assert sum(r.n_runs for r in rows) > 10
    assert shown(tuple(r) for r in rows) == shown(plain_digests(r.doc_id, r.text) for r in docs)
