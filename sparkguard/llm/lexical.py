"""Ranked lexical search: a blocked sparse product of item-term multiplicities and term-document impacts.

Documents are read twice at most per block of items, never shuffled. The first pass cuts them into blocks and writes each as a
sparse matrix over the items' terms (term-major rows of document positions and occurrences) with the counts that the
impacts need; those counts are summed by Spark. The second pass turns occurrences into int64 impacts and multiplies: for
each item the rows of its terms are merged into one accumulator over the block's documents (Gustavson's
order), and each task keeps the best k of every item over all of its blocks. Spark then reduces the tasks' bests in two
steps, so that no task gets a number of rows that grows with the table.

Items are taken in blocks of at most ITEM_ENTRIES distinct terms, which bounds what is broadcast and what a task holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .encoding import slices

#: Terms are the longest runs of this; of upper-case letters only A-Z are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Distinct terms of the items of one block, summed over items; bytes of text of a block of documents.
ITEM_ENTRIES, BLOCK_BYTES = 200_000, 8 << 20
#: Rows that the first reducing step forms of an item at most.
SALTS = 64
#: Weight of a document's length in percent, and scales of weights and impacts.
LENGTH_PERCENT, WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, LENGTH_SCALE = 90, 1000, 1_000_000_000, 1000, 8

#: What each byte of UTF-8 becomes: separators a space, A-Z lower case.
_TABLE = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def terms(texts: pa.Array) -> pa.LargeListArray:
    """The terms of each text; a text without any has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])].tobytes().translate(_TABLE)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data))
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain))
    flat, ends = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    held = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # a blank text gives one empty word
    kept = np.concatenate([[0], np.cumsum(held)])[ends - ends[0]]
    return pa.LargeListArray.from_arrays(pa.array(kept), flat.filter(pa.array(held)))


_ITEM_TERMS = "item bigint, terms array<string>"


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in slices(batch.column("text"), BLOCK_BYTES):
            found = [sorted(set(t)) for t in terms(texts).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item").slice(at, len(texts)), pa.array(found, pa.list_(pa.string()))], ["item", "terms"])


@dataclass
class Items:
    """A block of items: rows ``starts[i]`` to ``starts[i + 1]`` of ``columns`` are item i's terms, each with multiplicity 1."""

    ids: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    vocabulary: list[str]

    @classmethod
    def of(cls, rows: list) -> Items:
        vocabulary = sorted({t for r in rows for t in r.terms})
        at = {t: i for i, t in enumerate(vocabulary)}
        columns = [at[t] for r in rows for t in r.terms]
        return cls(np.array([r.item for r in rows], np.int64), np.cumsum([0, *(len(r.terms) for r in rows)]), np.array(columns, np.int64), vocabulary)


#: Blocks of documents (ids, lengths, term-major rows), and one row of counts per task: documents with terms, their terms, df.
_MATRIX = "docs array<bigint>, lengths array<bigint>, starts array<bigint>, at array<int>, tf array<int>, n_docs bigint, n_terms bigint, df array<struct<term:int,n:bigint>>"


def _matrix_blocks(vocabulary: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = pa.array(vocabulary, pa.large_string()), len(vocabulary)
        n_docs = n_terms = 0
        df = np.zeros(size, np.int64)
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        counts = pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int64())]))
        schema = pa.schema({"docs": longs, "lengths": longs, "starts": longs, "at": ints, "tf": ints, "n_docs": pa.int64(), "n_terms": pa.int64(), "df": counts})

        def row(**held) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held.get(f.name)], f.type) for f in schema], schema=schema)

        for batch in batches:
            for first, texts in slices(batch.column("text"), BLOCK_BYTES):
                words = terms(texts)
                lengths = np.diff(words.offsets.to_numpy())
                n_docs, n_terms = n_docs + int(np.count_nonzero(lengths)), n_terms + int(lengths.sum())
                code = pc.fill_null(pc.index_in(words.values, value_set=known), -1).to_numpy()
                doc = np.repeat(np.arange(len(lengths)), lengths)
                pairs, tf = np.unique(code[code >= 0].astype(np.int64) * len(lengths) + doc[code >= 0], return_counts=True)
                term, at = np.divmod(pairs, max(1, len(lengths)))
                held = np.bincount(term, minlength=size)
                df += held
                if len(pairs):
                    yield row(docs=batch.column("doc_id").slice(first, len(texts)).to_pylist(), lengths=lengths, starts=np.concatenate([[0], np.cumsum(held)]), at=at.astype(np.int32), tf=tf.astype(np.int32))
        some = np.flatnonzero(df)
        yield row(n_docs=n_docs, n_terms=n_terms, df=[{"term": t, "n": n} for t, n in zip(some.tolist(), df[some].tolist(), strict=True)])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 less LENGTH_PERCENT, plus that much of a document's length in average lengths; products that pass 64 bits are taken apart."""
    whole = LENGTH_PERCENT * n_docs
    if int(lengths.max(initial=0)) * whole >= 1 << 63:
        return 100 - LENGTH_PERCENT + np.array([n * whole // n_terms for n in lengths.tolist()], np.int64)
    return 100 - LENGTH_PERCENT + lengths * whole // n_terms


class _Best:
    """The best k of each item so far, by falling score, then rising id (null last)."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.item, self.score, self.last, self.doc = (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))

    def add(self, item: np.ndarray, score: np.ndarray, last: np.ndarray, doc: np.ndarray) -> None:
        item, score, last, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.last, last), (self.doc, doc)))
        order = np.lexsort((doc, last, -score, item))
        sizes = np.bincount(item, minlength=len(self.floor))
        place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order, place = order[place < self.k], place[place < self.k]
        self.item, self.score, self.last, self.doc = item[order], score[order], last[order], doc[order]
        full = place == self.k - 1
        self.floor[self.item[full]] = self.score[full]  # an equal score may still win by its id


def _products(items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """(item, doc_id, score): the best k of each item over the matrix blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(items.ids), k)
        for batch in batches:
            for r in range(batch.num_rows):
                docs = batch.column("docs")[r].values
                lengths, starts, at, tf = (batch.column(c)[r].values.to_numpy().astype(np.int64) for c in ("lengths", "starts", "at", "tf"))
                last = docs.is_null().to_numpy(zero_copy_only=False)
                doc = pc.fill_null(docs, 0).to_numpy()
                norm = LENGTH_SCALE * length_norms(lengths, n_docs, n_terms)
                impact = np.repeat(weights, np.diff(starts)) * (IMPACT_SCALE * tf // (TF_SCALE * tf + norm[at]))
                rows = [(at[a:b], impact[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                found: list[tuple[int, np.ndarray, np.ndarray]] = []
                for i in range(len(items.ids)):
                    sums = np.zeros(len(doc), np.int64)
                    for column in items.columns[items.starts[i] : items.starts[i + 1]].tolist():
                        where, what = rows[column]
                        sums[where] += what  # a row holds each document once
                    hit = np.flatnonzero(sums >= best.floor[i])
                    if len(hit) > 4 * k:  # not below the k-th best of this block
                        hit = hit[sums[hit] >= np.partition(sums[hit], len(hit) - k)[len(hit) - k]]
                    if len(hit):
                        found.append((i, hit, sums[hit]))
                if found:
                    hits = np.concatenate([h for _, h, _ in found])
                    best.add(np.repeat([i for i, _, _ in found], [len(h) for _, h, _ in found]), np.concatenate([s for _, _, s in found]), last[hits], doc[hits])
        ids = pa.array(best.doc, pa.int64(), mask=best.last)
        yield pa.RecordBatch.from_arrays([pa.array(items.ids[best.item], pa.int64()), ids, pa.array(best.score, pa.int64())], ["item", "doc_id", "score"])

    return run


def _best_of(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(items: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of ``docs`` with the highest scores above 0 for each row of ``items`` (item_id, text).

    Equal scores go by rising doc_id, null last; rows of one doc_id are documents of their own, and rows of one item_id
    items of their own. A null or blank text has no terms: such a document gets no score, such an item no rows. Texts
    count whole, whatever their length. Other columns are ignored; an empty table on either side gives an empty result.
    """
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = materialize(asked, "lexical-items")
    wanted = materialize(asked.select("item", "text").mapInArrow(_item_terms, _ITEM_TERMS).where(F.size("terms") > 0), "lexical-terms")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    entries = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = entries // ITEM_ENTRIES + 1
    placed = wanted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    found = []
    for b in range(blocks):
        block = Items.of(placed.where(F.col("block") == b).drop("block").collect())
        if len(block.ids):
            found.append(_search_block(block, docs, k))
    if not found:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    best = reduce(DataFrame.unionByName, found)
    discard(wanted)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search_block(items: Items, docs: DataFrame, k: int) -> DataFrame:
    """item, rank, doc_id, score of one block of items over all documents."""
    matrix = materialize(docs.mapInArrow(_matrix_blocks(items.vocabulary), _MATRIX), "lexical-matrix")
    n_docs, n_terms = matrix.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = matrix.where("df is not null").select(F.explode("df").alias("d")).groupBy("d.term").agg(F.sum("d.n").alias("n")).collect()  # at most ITEM_ENTRIES rows
    weights = np.zeros(len(items.vocabulary), np.int64)
    for r in df:
        weights[r.term] = weight(n_docs, r.n)
    blocks = matrix.where("docs is not null").select("docs", "lengths", "starts", "at", "tf")
    bests = blocks.mapInArrow(_products(items, weights, n_docs, n_terms, k), "item bigint, doc_id bigint, score bigint")
    salted = bests.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return _best_of(_best_of(salted, ["item", "salt"], k).select("item", "doc_id", "score"), ["item"], k).select("item", "rank", "doc_id", "score")


#: The same by SQL, for DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark),
s AS (SELECT count(*) AS big_n, CAST(sum(len(words)) AS BIGINT) AS big_l FROM d WHERE len(words) > 0),
a AS (SELECT item, item_id, unnest(terms) AS term FROM q),
p AS (SELECT rid, doc_id, len(words) AS n, unnest(words) AS term FROM d),
t AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM a) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term),
r AS (SELECT item, any_value(item_id) AS item_id, rid, any_value(doc_id) AS doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
    FROM a JOIN t USING (term) JOIN w USING (term), s GROUP BY item, rid)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) <= 10
"""
