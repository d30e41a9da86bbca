"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

A tandem repeat (square) is a stretch of words directly followed by its copy; a run of a period holds a square at each of its
words but the last ones. The method has three steps, done here in numpy for all texts of a block at once:

1. Each text is cut into Lempel-Ziv blocks (the longest stretches that occur before). The right half of a square's first
   occurrence touches at most two of them, so common extensions around block borders give a set of squares that
   covers the first occurrences of all.
2. The suffix tree is a suffix array with intervals as its nodes. From each covering square the rotations that follow
   it in its text are taken; where the text breaks off, the walk goes over the suffix link to the node of the square
   without its first word and on by the child that starts with that word, if there is one. So all kinds of squares
   in the text become known.
3. The leaves below each square's place in the tree are its occurrences. Neighbouring ones of one period merge into runs.

Only squares with primitive halves are walked from: others repeat the runs of their shorter periods. Texts in which no
stretch occurs twice that is as long as a run's overlap with itself at least are passed over.

Suffixes are sorted by doubled prefixes. Their ranks at every doubling are kept and answer how far two places agree,
forward and backward, exactly. Memory is about 4 bytes a word times the doublings, which are as many as it takes
to tell all suffixes apart (14 for repeats of 10,000 words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .encoding import slices
from .ngram_join import _A, _mix

#: A run has at least this many words and this many periods.
LEAST, TIMES = 24, 3
#: Bytes of text of a block.
BLOCK_BYTES = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"


def overlap(least: int, times: int) -> int:
    """Words that any run has in common with itself shifted by its period, at least."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


class Suffixes:
    """Sorted suffixes of texts put one after another, each closed by an end mark of its own; nothing agrees across texts."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        """``codes``: numbers of words of text after text; ``ends``: where each text ends in them."""
        texts, n = len(ends), len(codes) + len(ends)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.first = starts + np.arange(texts)  # of each text, in the joined sequence
        self.last = ends + np.arange(texts)  # its end mark
        self.text = np.repeat(np.arange(texts), np.diff(np.concatenate([[0], ends])) + 1)
        key = np.zeros(n, np.int64)
        words = np.ones(n, bool)
        words[self.last] = False
        key[words] = codes + 1
        key += self.text * (int(codes.max(initial=0)) + 2)
        order = np.argsort(key, kind="stable")
        self.levels = [self._ranked(key[order], order, np.zeros(n, np.int64), n)]
        while (shared := self._shared(self.levels[-1])).size:
            now, step = self.levels[-1], 1 << (len(self.levels) - 1)
            pair = now[shared].astype(np.int64) * n + now[shared + step]
            order = np.argsort(pair, kind="stable")
            self.levels.append(self._ranked(pair[order], shared[order], now[shared[order]].astype(np.int64), n, now))
        self.rank = self.levels[-1]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)
        self.table = np.stack(self.levels)

    @staticmethod
    def _ranked(key: np.ndarray, place: np.ndarray, bucket: np.ndarray, n: int, before: np.ndarray | None = None) -> np.ndarray:
        """Ranks of places that are sorted by key: the start of each key's stretch within its bucket's."""
        out = np.zeros(n, np.int32) if before is None else before.copy()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        fresh = np.ones(len(key), bool)
        fresh[1:] = bucket[1:] != bucket[:-1]
        at = np.arange(len(key))
        lead = np.maximum.accumulate(np.where(fresh, at, 0))
        out[place] = bucket + np.maximum.accumulate(np.where(new, at, 0)) - lead
        return out

    @staticmethod
    def _shared(ranks: np.ndarray) -> np.ndarray:
        """Places whose rank others have too, in order."""
        return np.flatnonzero(np.bincount(ranks, minlength=len(ranks))[ranks] > 1)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and b on agree (a and b differ)."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][a] == self.levels[k][b]).astype(np.int64) << k
            a += step
            b += step
        return a - start

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and b agree."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a - (1 << k), b - (1 << k)
            inside = (x >= 0) & (y >= 0)
            step = (inside & (self.levels[k][np.maximum(x, 0)] == self.levels[k][np.maximum(y, 0)])).astype(np.int64) << k
            a -= step
            b -= step
        return start - a

    def agree(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from a and b on agree: two windows of a power of two cover them."""
        k = np.frexp(length.astype(np.float64))[1].astype(np.int64) - 1
        known = k < len(self.levels)  # no two places agree any further than the last level
        k = np.minimum(k, len(self.levels) - 1)
        rest = np.where(known, length - (np.int64(1) << k), 0)
        return (a == b) | known & (self.table[k, a] == self.table[k, b]) & (self.table[k, np.minimum(a + rest, len(self.text) - 1)] == self.table[k, np.minimum(b + rest, len(self.text) - 1)])

    def interval(self, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that agree with ``place`` in ``length`` words."""
        low, high = self.rank[place].astype(np.int64), self.rank[place].astype(np.int64)
        n = len(self.order)
        for k in range(n.bit_length() - 1, -1, -1):
            to = low - (1 << k)
            low = np.where((to >= 0) & self.agree(self.order[np.maximum(to, 0)], place, length), to, low)
            to = high + (1 << k)
            high = np.where((to < n) & self.agree(self.order[np.minimum(to, n - 1)], place, length), to, high)
        return low, high

    def child(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, word: np.ndarray) -> np.ndarray:
        """First rank in [low, high] of suffixes with ``word`` (a rank of the first level) after ``depth`` words, or -1."""
        a, b = low.copy(), high + 1
        for _ in range(int(len(self.order)).bit_length()):
            middle = (a + b) >> 1
            below = (a < b) & (self._word(middle, depth) < word)
            b = np.where((a < b) & ~below, middle, b)
            a = np.where(below, middle + 1, a)
        return np.where((a <= high) & (self._word(a, depth) == word), a, -1)

    def _word(self, rank: np.ndarray, depth: np.ndarray) -> np.ndarray:
        n = len(self.order)
        return self.levels[0][np.minimum(self.order[np.minimum(rank, n - 1)] + depth, n - 1)]


def block_starts(s: Suffixes) -> np.ndarray:
    """Where Lempel-Ziv blocks start: each is the longest stretch that also starts earlier in its text, or a single word.

    The last place is taken out of the sorted suffixes first, so of the neighbours of each place those are left that come before it.
    """
    n = len(s.order)
    common = np.zeros(n + 1, np.int64)
    common[1:n] = s.ahead(s.order[:-1], s.order[1:])
    low, rank = common.tolist(), s.rank.tolist()
    before, after, length = list(range(-1, n)), list(range(1, n + 2)), [0] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        x, y = after[r], before[r]
        a, b = low[r], low[x]
        length[i] = a if a > b else b
        if a < b:
            low[x] = a
        before[x] = y
        if y >= 0:
            after[y] = x
    out = []
    for first, last in zip(s.first.tolist(), s.last.tolist(), strict=True):
        i = first
        while i < last:
            out.append(i)
            i += length[i] or 1
    return np.array(out, np.int64)


def covering_squares(s: Suffixes, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares that cover the first occurrence of every square whose period fits ``times`` into its text."""
    at = block_starts(s)
    text = s.text[at]
    end = np.append(at[1:], 0)
    same = np.append(text[1:] == text[:-1], False)
    end = np.where(same, end, s.last[text])
    size = end - at
    both = size + np.where(same, np.append(size[1:], 0), 0)
    most = (s.last[text] - s.first[text]) // times
    starts, periods = [], []
    for inner in (True, False):
        counts = np.minimum(size if inner else both, most)
        block = np.repeat(np.arange(len(at)), counts)
        k = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        # Left half inside the block and right half over its end; or left half over the block's start.
        a, b = (end[block] - k, end[block]) if inner else (at[block], at[block] + k)
        b = np.minimum(b, s.last[text[block]])
        fits = np.flatnonzero((b - a == k) & (s.levels[0][a] == s.levels[0][b]))
        block, k, a, b = block[fits], k[fits], a[fits], b[fits]
        forward, backward = s.ahead(a, b), s.behind(a, b)
        start = np.maximum(a - backward, a - k + 1)
        good = forward + backward >= k
        if not inner:
            good &= start + k <= end[block]
        starts.append(start[good])
        periods.append(k[good])
    start, period = np.concatenate(starts), np.concatenate(periods)
    found = np.unique(np.stack([start, period], axis=1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
    return primitive(s, found[:, 0], found[:, 1])


def primitive(s: Suffixes, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The squares whose halves are no repeats of something shorter."""
    keep, left = np.ones(len(start), bool), period.copy()
    factor = np.full(len(start), 2, np.int64)
    while (open_ := np.flatnonzero(keep & (left > 1))).size:
        factor[open_] = np.where(factor[open_] * factor[open_] > left[open_], left[open_], factor[open_])
        fits = open_[left[open_] % factor[open_] == 0]
        other = period[fits] // factor[fits]
        keep[fits] &= ~s.agree(start[fits], start[fits] + other, 2 * period[fits] - other)
        left[fits] //= factor[fits]
        rest = np.setdiff1d(open_, fits, assume_unique=True)
        factor[rest] += 1
    return start[keep], period[keep]


def vocabulary(s: Suffixes, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rank, last rank, period) of every square that rotations lead to from the given ones."""
    known = np.zeros(0, np.int64)
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n = len(s.order)
    head = s.interval(start, 2 * period)[0]
    while len(start):
        name, one = np.unique(head * n + period, return_index=True)
        fresh = ~np.isin(name, known)
        known = np.union1d(known, name)
        start, period = start[one[fresh]], period[one[fresh]]
        squares = s.ahead(start, start + period) - period + 1  # that follow one another here
        here = np.minimum(squares, period)
        step = np.arange(int(here.sum())) - np.repeat(np.cumsum(here) - here, here)
        places.append(np.repeat(start, here) + step)
        periods.append(np.repeat(period, here))
        on = squares < period
        last, period = start[on] + squares[on] - 1, period[on]
        low, high = s.interval(last + 1, 2 * period - 1)
        head = s.child(low, high, 2 * period - 1, s.levels[0][last])
        there = head >= 0
        head, period = head[there], period[there]
        start = s.order[head]
    place, period = np.concatenate(places), np.concatenate(periods)
    low, high = s.interval(place, 2 * period)
    found = np.unique(np.stack([low, high, period], axis=1), axis=0) if len(low) else np.zeros((0, 3), np.int64)
    return found[:, 0], found[:, 1], found[:, 2]


def merged_runs(s: Suffixes, low: np.ndarray, high: np.ndarray, period: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (text, start, length, period) of runs, sorted, from the occurrences of squares."""
    count = high - low + 1
    rank = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start, period = s.order[rank], np.repeat(period, count)
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    first, q = start[at], period[at]
    length = np.diff(np.append(at, len(start))) - 1 + 2 * q
    good = length >= np.maximum(least, times * q)
    text = s.text[first[good]]
    rows = np.stack([text, first[good] - s.first[text], length[good], q[good]], axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def text_runs(codes: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of the maximal runs of texts given by numbers of their words."""
    chosen = repeating(codes, ends, overlap(least, times))
    if not len(chosen):
        return np.zeros((0, 4), np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = (ends - starts)[chosen]
    at = np.repeat(starts[chosen], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    s = Suffixes(codes[at], np.cumsum(sizes))
    found = merged_runs(s, *vocabulary(s, *covering_squares(s, times)), least, times)
    found[:, 0] = chosen[found[:, 0]]
    return found


def repeating(codes: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Texts that hold some stretch of ``length`` words twice (by its hash: a few others may be among them)."""
    sizes = np.diff(np.concatenate([[0], ends]))
    if len(codes) < length:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(ends)), sizes)
    mixed = _mix(codes.astype(np.uint64) + _A)
    rolled = mixed[: len(codes) - length + 1].copy()
    for k in range(1, length):
        rolled = rolled * _A + mixed[k : len(codes) - length + 1 + k]
    inside = text[: len(rolled)] == text[length - 1 :]
    owner = text[: len(rolled)][inside]
    key = _mix(rolled[inside]) ^ _mix(owner.astype(np.uint64) + _A)
    order = np.argsort(key)
    twice = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    return np.unique(owner[order[twice]])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("text"), BLOCK_BYTES):
                words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
                ends = words.offsets.to_numpy().astype(np.int64)[1:]
                flat = words.flatten()
                runs = text_runs(flat.dictionary_encode().indices.to_numpy().astype(np.int64), ends, least, times)
                starts = ends - np.diff(np.concatenate([[0], ends]))
                # A word is dropped where more drops begin than have ended.
                change = np.zeros(len(flat) + 1, np.int64)
                begin = starts[runs[:, 0]] + runs[:, 1]
                np.add.at(change, begin + runs[:, 3], 1)
                np.add.at(change, begin + runs[:, 2], -1)
                kept = np.cumsum(change[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
                lists = pa.LargeListArray.from_arrays(pa.array(left), flat.filter(pa.array(kept)))
                texts_left = pc.binary_join(lists, pa.scalar(" ", flat.type)).cast(pa.string())
                cuts = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
                structs = pa.StructArray.from_arrays([pa.array(runs[:, c].copy()) for c in (1, 2, 3)], ["start", "length", "period"])
                found = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), structs).cast(_RUNS)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), found, texts_left], ["doc_id", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (start, length, period by start, then period), collapsed of every row.

    A run is a stretch of words, at least ``least`` and ``times`` periods long, that repeats with its smallest period and
    that no neighbouring word extends; ``times`` is 2 at least. collapsed is the text's words that no run holds
    after its first period, joined by a space. A null or blank text has no words, no runs and an empty collapsed text.
    Rows are taken each for itself, repeated ids and missing ones too; other columns are ignored.
    """
    if times < 2:
        raise ValueError("a run holds two periods at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_found(least, times), "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents (by crc32 of the id) is made periodic from some word on; rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all(text_or_empty(), F.lit(f"({WORD})"), F.lit(1))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.col("g") % F.when(F.col("n") > 0, F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    moved = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at("words", (F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1).cast("int")))
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def _ahead(x: Column, y: Column) -> Column:
    """Order of runs by falling length / period, compared exactly, then start, then period."""
    more, other = x["length"] * y["period"], y["length"] * x["period"]
    later = F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)
    return F.when(more > other, -1).when(more < other, 1).otherwise(later)


def run_digests(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    found = find_runs(docs, least, times).withColumn("best", F.get(F.array_sort("runs", _ahead), F.lit(0)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
