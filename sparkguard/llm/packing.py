"""Best-two-fit packing of token sequences.

A bin is filled greedily with the largest document that fits; then its smallest document gives way to
two unpacked documents that together fit the expanded gap more tightly, if such a pair exists. Lengths
are counted per group of documents, so a group of any composition is packed over at most ``capacity``
distinct lengths. Pieces of full capacity are sequences of their own. All others are dealt to groups of a
bounded number of pieces by a hash of their row number in the written table of pieces, so neither repeated
rows nor very long documents meet in one; each group leaves at most its last bins loose.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released
from .encoding import encoder, slices, tokenizer_path

CAPACITY = 4096
#: Pieces of a group that is packed on its own.
GROUP_PIECES = 8192


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of every length; each length is between 1 and ``capacity``."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    first = np.cumsum(counts) - counts  # where the rows of a length begin in order
    left = counts.copy()
    present = 0  # bit l: a row of length l is unpacked
    for length in np.flatnonzero(counts).tolist():
        present |= 1 << length
    scale = np.arange(capacity + 1)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def largest(most: int) -> int:
        return (present & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else 0

    def take(length: int) -> None:
        nonlocal present
        left[length] -= 1
        if not left[length]:
            present &= ~(1 << length)

    def give_back(length: int) -> None:
        nonlocal present
        left[length] += 1
        present |= 1 << length

    number = 0
    while present:
        held, gap = [], capacity
        while present and (length := largest(gap)) > 0:
            held.append(length)
            take(length)
            gap -= length
        if gap and present and len(held) > 1:
            smallest = held[-1]
            room = gap + smallest
            some = left[: room + 1] > 0
            fitting = np.maximum.accumulate(np.where(some, scale[: room + 1], 0))
            a = np.flatnonzero(some)
            a = a[a * 2 >= smallest]  # the larger of the two
            b = fitting[np.minimum(a, room - a)] if len(a) else a
            alone = (b == a) & (left[a] < 2)
            b = np.where(alone, fitting[np.maximum(b - 1, 0)], b)
            two = np.where((b > 0) & (a + b <= room), a + b, 0)
            if len(two) and two.max() > smallest:
                best = int(two.argmax())
                held.pop()
                give_back(smallest)
                for length in (int(a[best]), int(b[best])):
                    take(length)
                    held.append(length)
        at = 0
        for length in held:
            row = order[first[length]]
            first[length] += 1
            bins[row], offsets[row] = number, at
            at += length
        number += 1
    return bins, offsets


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, False)
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                doc_ids = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                ids, offsets = enc.encode(texts)
                rows = []
                for doc_id, a, b in zip(doc_ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    mine = np.append(ids[a:b], enc.dtype(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(mine), capacity)):
                        part = mine[start : start + capacity]
                        rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _pack(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        group = rows.column("pack_group")[0].as_py()
        bins, offsets = best_two_fit(rows.column("length").to_numpy(), capacity)
        return rows.drop_columns(["pack_group"]).append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    return run


def pack_lengths(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (with ``length``, 1 to capacity) with sequence_id and offset."""
    rows = materialize(pieces.withColumn("piece_row", F.monotonically_increasing_id()), "pack-pieces")
    short = rows.where(F.col("length") < capacity)
    groups = max(1, round(short.count() / group_pieces))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    dealt = short.withColumn("pack_group", F.pmod(F.xxhash64("piece_row"), F.lit(groups))).groupBy("pack_group")
    full = rows.where(F.col("length") == capacity).select("*", (-1 - F.col("piece_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.applyInArrow(_pack(capacity), schema).unionByName(full).drop("piece_row")


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Whole texts (null: empty) are encoded, ended with ``end_id`` and cut only where longer than
    ``capacity``. An empty text is a piece of one id. Repeated rows and null ids are packed like others;
    other columns are ignored; an empty table gives an empty result. A task holds one text's ids at a time
    with those of the texts beside it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(released(_pieces(path or tokenizer_path("word_bpe_49k.json"), capacity, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return pack_lengths(pieces, capacity, group_pieces)
