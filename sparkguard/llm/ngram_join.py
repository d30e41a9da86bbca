"""Documents whose sets of word n-grams are similar: an exact Jaccard join by PartEnum signatures.

Sizes are cut into bands so that similar sets fall into one band or two neighbouring ones; a set carries the
tags of its band and the next. Within a tag two similar sets differ in at most k elements. The domain of
n-grams is partitioned by hash into n > k parts; the two sets then agree on at least n - k of their n
projections, and a signature is a projection's digest with its part and tag. A set leaves out its u
projections that hold nothing as long as u < n - k: n - k - u agreed ones are still left, which is what the
set *needs*. Otherwise it carries all and needs 1.

Sets of one band meet under their own tag, so two sets that both carry a tag as their next one need not.

A signature of more than FEW sets is *heavy*. Sets with fewer heavy signatures of a tag than they need do
without them: what they need, less their heavy ones, must be met by light signatures, and a light one counts
for each pair of its few sets. So a passage that many documents share ties none of them. Only sets whose every
needed signature may be heavy (members of large families of copies, mostly) are tied through heavy ones,
each to one set of the signature and of its block. The connected components of what is left are the
candidate groups, and every group is checked exactly by counting common elements, in cells of two blocks where
it holds more than ``CELL_ELEMENTS``. Exact links give the result's components.

Sets are one where 128 bits of their digests agree. Candidates go by 64 of them, which at worst puts a set
into a group that it has no link in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize, partitions, released
from .components import components
from .encoding import slices

#: Words of a shingle; similarity as a fraction.
WORDS, SIMILAR = 5, (80, 100)
#: Signature entries that a reducing task takes, about, and bytes of text whose signatures are merged before the shuffle.
RANGE_SIGNATURES, BLOCK_BYTES = 1_000_000, 8 << 20
#: Elements of a block of a candidate group.
CELL_ELEMENTS = 200_000

#: Sets of a signature whose pairs are counted; with more it is heavy.
FEW = 8
#: Upper 32 and next 8 bits of a signature, set, what it needs under this tag, whether the tag is its next one, whether more sets share it.
_ENTRY = np.dtype([("high", "<u4"), ("low", "u1"), ("set", "<i8"), ("need", "u1"), ("slot", "u1"), ("heavy", "u1")])
#: How many heavy signatures a set has under one of its tags.
_COUNT = np.dtype([("set", "<i8"), ("slot", "u1"), ("need", "u1"), ("n", "<u4")])
#: Kinds of rows: pairs of light signatures; ties to a set, or of a block's set to another's; numbers of heavy signatures.
_PAIR, _TIE, _HUB, _HEAVY = range(4)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text: words of A-Z lower-cased, split at ASCII white space."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    offsets = words.offsets.to_numpy().astype(np.int64)
    flat = words.flatten().dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    blank = np.array([not w for w in flat.dictionary.to_pylist()], bool)
    codes = flat.indices.to_numpy(zero_copy_only=False)
    h = known[codes] if len(codes) else np.zeros(0, np.uint64)
    offsets = offsets - offsets[0]
    rolled = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        rolled = rolled * _A + h[k : len(h) - n + 1 + k]
    rolled = _mix(rolled)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(rolled[a : b - n + 1])
        elif b - a == 0 or b - a == 1 and blank[codes[a]]:
            yield np.zeros(0, np.uint64)
        else:
            one = np.array([b - a], np.uint64)
            for i in range(a, b):
                one = one * _A + h[i]
            yield _mix(one)


def set_digest(elements: np.ndarray) -> tuple[int, int]:
    """128 bits as two signed numbers; the first alone names a set among candidates."""
    both = xxhash.xxh3_128_intdigest(elements.tobytes())
    return (both & ((1 << 64) - 1)) - (1 << 63), (both >> 64) - (1 << 63)


def tag_bounds(size: int, similar: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """(tag, largest size of its band) of a set's own band and the next one."""
    num, den = similar
    tag, low = 0, 1
    while (high := low * den // num) < size:
        tag, low = tag + 1, high + 1
    return [(tag, high), (tag + 1, (high + 1) * den // num)]


class Signer:
    def __init__(self, similar: tuple[int, int] = SIMILAR):
        self.similar, self.tags = similar, {}

    def signatures(self, elements: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(signatures, how many of them a similar set of the same tag shares at least) under both tags."""
        size = len(elements)
        if size not in self.tags:
            self.tags[size] = tag_bounds(size, self.similar)
        mixed, high = _mix(elements + _A), (elements >> np.uint64(32)).astype(np.int64)
        out = []
        num, den = self.similar
        for tag, most in self.tags[size]:
            k = 2 * most * (den - num) // (den + num)
            n = k + 1 + (k + 6) // 3
            part = (high * n) >> 32
            order = np.argsort(part.astype(np.uint16) if n <= 1 << 16 else part, kind="stable")
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[order])])
            held = np.bincount(part, minlength=n)
            digest = np.diff(sums[np.concatenate([[0], np.cumsum(held)])])
            key = _mix(digest + np.arange(n, dtype=np.uint64) * _B + _mix(np.array([tag], np.uint64)))
            left_out = n - np.count_nonzero(held)
            fewer = left_out < n - k
            out.append((key[held > 0] if fewer else key, n - k - left_out if fewer else 1))
        return out

    def of(self, sets: list[np.ndarray]) -> list[list[tuple[np.ndarray, int]]]:
        return [self.signatures(s) for s in sets]


def _documents(n: int):
    """rid, doc_id, n_shingles and the two halves of the set's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("text"), BLOCK_BYTES):
                sets = list(shingle_sets(texts, n))
                names = [set_digest(s) for s in sets]
                kept = [batch.column(c).slice(at, len(texts)) for c in ("rid", "doc_id")]
                found = [[len(s) for s in sets], [a for a, _ in names], [b for _, b in names]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64()) for x in found)], ["rid", "doc_id", "n_shingles", "set", "second"])

    return run


def _ranks(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within runs of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Sizes of the runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.diff(np.append(np.flatnonzero(new), len(new)))


def _counted(entry: np.ndarray) -> np.ndarray:
    """Entries of heavy signatures as numbers per set and tag."""
    entry = entry[np.lexsort((entry["slot"], entry["set"]))]
    sizes = _runs(entry["set"], entry["slot"])
    out = np.zeros(len(sizes), _COUNT)
    at = np.cumsum(sizes) - sizes
    for name in ("set", "slot", "need"):
        out[name] = entry[name][at]
    out["n"] = sizes
    return out


def _unique_ties(u: np.ndarray, v: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([u, v, slot.astype(np.int64)], axis=1), axis=0) if len(u) else np.zeros((0, 3), np.int64)


class _Merger:
    """Merges the entries of a task's blocks: of the sets of a heavy signature one goes on, the others are tied to it."""

    def __init__(self):
        self.known, self.heads = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def block(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entries that go on, by signature; ties; numbers of heavy signatures)."""
        entry = entry[np.lexsort((entry["set"], entry["low"], entry["high"]))]
        name = entry["high"].astype(np.uint64) << np.uint64(8) | entry["low"]
        at = np.minimum(np.searchsorted(self.known, name), max(0, len(self.known) - 1))
        before = self.known[at] == name if len(self.known) else np.zeros(len(name), bool)
        sizes = _runs(name)
        many, rank = np.repeat(sizes > FEW, sizes), _ranks(sizes)
        head = entry["set"][np.repeat(np.cumsum(sizes) - sizes, sizes)]
        head[before] = self.heads[at[before]] if before.any() else 0
        tied = before | (many & (rank > 0))
        apart = tied & (head != entry["set"])
        ties, counts = _unique_ties(head[apart], entry["set"][apart], entry["slot"][apart]), _counted(entry[tied])
        new = many & (rank == 0) & ~before
        entry["heavy"][new] = 1
        known, heads = np.concatenate([self.known, name[new]]), np.concatenate([self.heads, entry["set"][new]])
        order = np.argsort(known, kind="stable")
        self.known, self.heads = known[order], heads[order]
        return entry[~tied], ties, counts


def _range_rows(entry: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of a range's entries: (u, v, shared, what each needs, both slots) of light pairs, (u, v, slot, hub) of ties, heavy numbers."""
    entry = entry[np.lexsort((entry["heavy"], entry["set"], entry["low"], entry["high"]))]
    last = np.cumsum(_runs(entry["high"], entry["low"], entry["set"])) - 1  # of equal sets one, heavy if any is
    entry = entry[last]
    sizes = _runs(entry["high"], entry["low"])
    at = np.cumsum(sizes) - sizes
    of = lambda f, name: f.reduceat(entry[name], at) > 0 if len(at) else np.zeros(0, bool)
    heavy = of(np.maximum, "heavy")
    fine = np.repeat(heavy | ~of(np.minimum, "slot"), sizes)  # else all have this tag as their next one
    many, rank, bucket = np.repeat((sizes > FEW) | heavy, sizes), _ranks(sizes), np.repeat(np.arange(len(sizes)), sizes)
    tied = np.flatnonzero(many & fine & (rank > 0))
    ties = [entry["set"][at[bucket[tied]]], entry["set"][tied], entry["slot"][tied], entry["heavy"][tied]]
    a, b = [tied[:0]], [tied[:0]]
    for step in range(1, FEW):
        if len(bucket) > step:
            i = np.flatnonzero((bucket[step:] == bucket[:-step]) & ~many[step:] & ~((entry["slot"][step:] > 0) & (entry["slot"][:-step] > 0)))
            a.append(i)
            b.append(i + step)
    a, b = np.concatenate(a), np.concatenate(b)
    slots = entry["slot"][a] * 2 + entry["slot"][b]
    order = np.lexsort((slots, entry["set"][b], entry["set"][a]))
    a, b, slots = a[order], b[order], slots[order]
    starts = np.cumsum(runs := _runs(entry["set"][a], entry["set"][b], slots)) - runs
    a, b = a[starts], b[starts]
    pairs = [entry["set"][a], entry["set"][b], runs, *(entry[c][x].astype(np.int64) for c in ("need", "slot") for x in (a, b))]
    return pairs, ties, _counted(entry[many & fine])


def _signed(n: int, ranges: int, make_signer: Callable[[], Signer] = Signer):
    """Rows (key, kind, data): entries of a range of signatures, ties and numbers of heavy signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, merger = make_signer(), _Merger()
        for batch in batches:
            for _, texts in slices(batch.column("text"), BLOCK_BYTES):
                held, sets = [], {}
                for s in shingle_sets(texts, n):
                    if len(s):
                        sets.setdefault(set_digest(s)[0], s)
                for name, signed in zip(sets, signer.of(list(sets.values())), strict=True):
                    for slot, (sig, need) in enumerate(signed):
                        mine = np.zeros(len(sig), _ENTRY)
                        mine["high"], mine["low"] = sig >> np.uint64(32), (sig >> np.uint64(24)) & np.uint64(255)
                        mine["set"], mine["slot"], mine["need"] = name, slot, min(need, 255)
                        held.append(mine)
                if not held:
                    continue
                entry, ties, counts = merger.block(np.concatenate(held))
                where = (entry["high"].astype(np.uint64) * np.uint64(ranges)) >> np.uint64(32)
                cuts = np.searchsorted(where, np.arange(ranges + 1))  # entries are sorted by signature
                rows = []
                raw = entry.tobytes()
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    rows.append((r, _PAIR, raw[cuts[r] * _ENTRY.itemsize : cuts[r + 1] * _ENTRY.itemsize]))
                for kind, data in ((_TIE, ties.astype("<i8")), (_HEAVY, counts)):
                    for at in range(0, len(data), 10_000):
                        first = data["set"][at] if kind == _HEAVY else data[at, 1]
                        rows.append((int(first % ranges), kind, data[at : at + 10_000].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["key", "kind", "data"])

    return run


_RANGE = "kind int, u long, v long, n long, need_u long, need_v long, slot_u long, slot_v long"


def _range_ties(rows: pa.Table) -> pa.Table:
    kinds, data = rows.column("kind").to_pylist(), rows.column("data").to_pylist()
    joined = lambda kind: b"".join(d for k, d in zip(kinds, data, strict=True) if k == kind)
    pairs, (u, v, slot, hub), heavy = _range_rows(np.frombuffer(joined(_PAIR), _ENTRY))
    before = np.frombuffer(joined(_TIE), "<i8").reshape(-1, 3)
    heavy = np.concatenate([heavy, np.frombuffer(joined(_HEAVY), _COUNT)])
    parts = [(np.full(len(pairs[0]), _PAIR), *pairs)]
    for kind, ties in ((_TIE, np.concatenate([before, _unique_ties(u[hub == 0], v[hub == 0], slot[hub == 0])])), (_HUB, _unique_ties(u[hub > 0], v[hub > 0], slot[hub > 0]))):
        zero = np.zeros(len(ties), np.int64)
        parts.append((zero + kind, ties[:, 0], ties[:, 1], zero, zero, zero, zero, ties[:, 2]))
    zero = np.zeros(len(heavy), np.int64)
    parts.append((zero + _HEAVY, heavy["set"], zero, heavy["n"], heavy["need"], zero, heavy["slot"], zero))
    columns = [np.concatenate([x.astype(np.int64) for x in c]) for c in zip(*parts, strict=True)]
    return pa.table([pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])], [c.split()[0] for c in _RANGE.split(", ")])


def _candidate_edges(rows: DataFrame) -> DataFrame:
    """u, v: sets that may be similar, from what the ranges found (see the module)."""
    heavy = rows.where(F.col("kind") == _HEAVY).groupBy("u", "slot_u").agg((F.min("need_u") - F.sum("n")).alias("spare"))
    of = lambda side: heavy.select(F.col("u").alias(side), F.col("slot_u").alias(f"slot_{side}"), F.col("spare").alias(f"spare_{side}"))
    light = rows.where(F.col("kind") == _PAIR).groupBy("u", "v", "slot_u", "slot_v").agg(F.sum("n").alias("n"), F.min("need_u").alias("need_u"), F.min("need_v").alias("need_v"))
    light = light.join(of("u"), ["u", "slot_u"], "left").join(of("v"), ["v", "slot_v"], "left")
    # A set without heavy signatures has no spare, and least passes over nulls.
    met = F.col("n") >= F.greatest(F.least("need_u", "spare_u"), F.least("need_v", "spare_v"), F.lit(1))
    keepers = of("v").where("spare_v <= 0").select("v", "slot_v")
    ties = rows.where(F.col("kind") == _TIE).select("u", "v", "slot_v").join(keepers, ["v", "slot_v"], "left_semi").select("u", "v")
    # A block's set ties its block to another's where it is such a set itself or one of its block is tied to it.
    asked = keepers.select("v").unionByName(ties.select(F.col("u").alias("v"))).distinct()
    hubs = rows.where(F.col("kind") == _HUB).select("u", "v").join(asked, "v", "left_semi").select("u", "v")
    return light.where(met).select("u", "v").unionByName(ties).unionByName(hubs)


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("text"), BLOCK_BYTES):
                sets = list(shingle_sets(texts, n))
                kept = [batch.column(c).slice(at, len(texts)) for c in ("set", "group")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set", "group", "n", "elements"])

    return run


def _forest(pairs_of: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """The pairs that join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    out = []
    for us, vs in pairs_of:
        for u, v in zip(us.tolist(), vs.tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[a] = b
                out.append((u, v))
    return out


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], similar: tuple[int, int] = SIMILAR, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with Jaccard of left[i] and right[j] at least ``similar``, by counting common elements."""
    size_l, size_r = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    flat = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), size_r)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    num, den = similar
    for i in range(len(left)):
        low = np.searchsorted(flat, left[i], "left")
        held = np.searchsorted(flat, left[i], "right") - low
        common = np.zeros(len(right), np.int64)
        ends = np.cumsum(held)
        a = 0
        while a < len(held):  # at most about ``most`` occurrences at a time
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            h = held[a:b]
            stop = np.cumsum(h)
            at = np.arange(int(stop[-1])) + np.repeat(low[a:b] - (stop - h), h)
            common += np.bincount(owner[at], minlength=len(right))
            a = b
        j = np.flatnonzero(den * common >= num * (size_l[i] + size_r - common))
        yield np.full(len(j), i), j


def _check_cell(similar: tuple[int, int]):
    """Links of a cell: two blocks of a group, or one with itself; a forest of them is enough."""

    def run(rows: pa.Table) -> pa.Table:
        ids, block = rows.column("set").to_numpy(), rows.column("block").to_numpy()
        sets = [np.frombuffer(d, np.uint64) for d in rows.column("elements").to_pylist()]
        names = np.unique(block)
        parts = [np.flatnonzero(block == b) for b in names]
        left, right = parts[0], parts[-1]
        links = _forest((ids[left[i]], ids[right[j]]) for i, j in similar_pairs([sets[x] for x in left], [sets[x] for x in right], similar))
        u, v = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"u": pa.array(u.copy()), "v": pa.array(v.copy())})

    return run


def _cells(members: DataFrame, pairs: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Links of the given cells (group, a, b): each names two blocks of a group."""
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("a", "b"))))
    placed = members.join(sides, ["group", "block"])
    return placed.groupBy("group", "a", "b").applyInArrow(_check_cell(similar), "u long, v long")


def _group_links(members: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Exact links of candidate groups (set, group, n, elements), enough of them for the components.

    A group up to CELL_ELEMENTS is one cell. A larger one is cut into blocks; each block is checked with
    itself and with the first; then blocks are cut anew by the components so far, and every two blocks
    are checked that do not lie in one component.
    """
    sized = members.groupBy("group").agg(F.sum("n").alias("all"))
    total = members.select("n").agg(F.sum("n")).first()[0] or 0
    sized = sized.withColumn("blocks", F.ceil(F.col("all") / CELL_ELEMENTS))
    small = join_hot(members, sized.where("blocks = 1"), ["group"], "all", total).withColumn("block", F.lit(0).cast("long"))
    links = materialize(small.withColumn("a", F.lit(0)).groupBy("group").applyInArrow(_check_cell(similar), "u long, v long"), "join-links")
    large = materialize(join_hot(members, sized.where("blocks > 1"), ["group"], "all", total), "join-large")
    if large.isEmpty():
        discard(large)
        return links
    by_hash = large.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")))
    blocks = by_hash.select("group", F.col("block").alias("a")).distinct()
    star = blocks.select("group", "a", F.col("a").alias("b")).union(blocks.where("a > 0").select("group", F.lit(0).cast("long").alias("a"), F.col("a").alias("b")))
    first = materialize(_cells(by_hash.drop("all", "blocks"), star, similar), "join-links")
    found = components(first)
    labelled = large.join(found.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    # Blocks of one component each where it is large, of many small ones otherwise.
    weight = labelled.groupBy("group", "component").agg(F.sum("n").alias("w"))
    spread = F.when(F.col("w") > CELL_ELEMENTS // 2, F.pmod(F.xxhash64("set"), F.ceil(F.col("w") / CELL_ELEMENTS))).otherwise(F.lit(0))
    own = F.when(F.col("w") > CELL_ELEMENTS // 2, F.xxhash64("component")).otherwise(F.pmod(F.xxhash64("component", F.lit(1)), F.col("blocks")))
    again = materialize(labelled.join(weight, ["group", "component"]).withColumn("block", F.xxhash64(own, spread)).withColumn("whole", F.when(F.col("w") > CELL_ELEMENTS // 2, F.col("component"))), "join-large")
    sides = again.groupBy("group", "block").agg(F.max("whole").alias("whole"))
    pairs = sides.alias("x").join(sides.alias("y"), (F.col("x.group") == F.col("y.group")) & (F.col("x.block") <= F.col("y.block")) & ~F.coalesce(F.col("x.whole") == F.col("y.whole"), F.lit(False)))
    pairs = pairs.select(F.col("x.group").alias("group"), F.col("x.block").alias("a"), F.col("y.block").alias("b"))
    rest = _cells(again.select("set", "group", "n", "elements", "block"), pairs, similar)
    out = links.union(first).union(materialize(rest, "join-links"))
    discard(large)
    discard(again)
    return out


def similar_rows(base: DataFrame, words: int = WORDS, make_signer: Callable[[], Signer] = Signer, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, kept of rows (rid, doc_id, text) of a materialized table; rid is a key.

    ``make_signer`` gives what signs the sets of a block so that sets as similar as ``similar`` share what they need.

    Of each component one row is kept: the one with the smallest doc_id (null last), then rid. Rows without
    words are all kept.
    """
    spark = base.sparkSession
    rows = materialize(base.select("rid", "doc_id", "text").mapInArrow(released(_documents(words)), "rid long, doc_id long, n_shingles long, set long, second long"), "join-docs")
    some = rows.where("n_shingles > 0")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("lead")
    classes = materialize(some.groupBy("set", "second").agg(lead, F.count(F.lit(1)).alias("size")).withColumn("cid", F.monotonically_increasing_id()), "join-classes")
    total, elements = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    ranges = max(2 * partitions(spark), elements * 2 // (3 * RANGE_SIGNATURES))
    signed = base.select("text").mapInArrow(released(_signed(words, ranges, make_signer)), "key int, kind int, data binary")
    found = materialize(signed.groupBy("key").applyInArrow(_range_ties, _RANGE), "join-pairs")
    groups = materialize(components(_candidate_edges(found)).withColumnsRenamed({"node": "set", "component": "group"}), "join-groups")
    discard(found)
    # One row of each set that has company; its elements are computed again from its text.
    wanted = classes.join(groups, "set").select(F.col("lead.rid").alias("rid"), F.col("cid").alias("set"), "group")
    members = materialize(base.select("rid", "text").join(wanted, "rid").select("text", "set", "group").mapInArrow(released(_set_rows(words)), "set long, group long, n long, elements binary"), "join-members")
    discard(groups)
    links = _group_links(members, similar)
    placed = classes.join(components(links).withColumnsRenamed({"node": "cid"}), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    placed = materialize(placed, "join-placed")
    discard(members)
    discard(classes)
    least = placed.groupBy("component").agg(F.min("lead").alias("first"), F.count(F.lit(1)).alias("sets"))
    # Read three times below: written, so that the last plan does not hold its joins as often.
    of_set = materialize(join_hot(placed, least, ["component"], "sets", total).select("set", "second", "size", "first"), "join-of-set")
    discard(placed)
    joined = join_hot(some, of_set, ["set", "second"], "size", total)
    joined = joined.select("rid", "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("rid") == F.col("first.rid")).alias("kept"))
    return joined.unionByName(rows.where("n_shingles = 0").select("rid", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def similar_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links of Jaccard >= 0.8.

    Null or blank texts have no shingles and link with nothing: their component is their own id. Texts
    of fewer words than a shingle have one, their whole sequence. Rows with equal sets are linked, so
    repeated rows share a component. Rows without an id link like others; an id is never theirs, and a
    component of such rows alone has none. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = materialize(docs.withColumn("rid", F.monotonically_increasing_id()), "join-base")
    return similar_rows(base, words).select("doc_id", "n_shingles", "component_id")


def drop_similar(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of similar documents, and all without words."""
    rows = materialize(docs.select(F.struct(*docs.columns).alias("row")).withColumn("rid", F.monotonically_increasing_id()), "join-base")
    base = rows.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    gone = similar_rows(base, words).where(~F.col("kept")).select("rid")
    return rows.join(gone, "rid", "left_anti").select("row.*")
