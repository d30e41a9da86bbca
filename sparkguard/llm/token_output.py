"""Token ids in fixed-width bit-packed blocks.

Each id takes the minimum number of bits for its vocabulary. A block holds whole documents in ascending
id order, their ends inside the block and the packed ids, so numpy unpacks a block in one step and a
range of ids without the rest. Blocks are rows of Parquet files under one folder per ``bucket``, a range
of document ids of about ``BUCKET_BYTES`` of text, so any file system that Spark writes serves, and the
folders in order hold the documents in order. A block names its first and last id, which is how a reader
finds the block of a document without touching others.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, shared_dir
from .encoding import encoder, slices, tokenizer_path

#: A block is closed when it has this many ids; a longer document has a block to itself.
BLOCK_IDS = 1 << 16
#: Text of a bucket, about: what a task sorts, encodes and writes.
BUCKET_BYTES = 64 << 20
BLOCK_SCHEMA = "bucket int, block int, start long, n_ids long, first_id long, last_id long, width int, doc_ids array<bigint>, ends array<bigint>, payload binary"


def bit_width(vocabulary: int) -> int:
    """Bits that the largest id, vocabulary - 1, takes."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Little-endian fixed-width packing: id i takes bits [i * width, (i + 1) * width)."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a packed block; only their bytes are touched."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", stop - start, start * width // 8).astype(np.uint32)
    first, last = start * width // 8, -(-stop * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first), bitorder="little")
    skip = start * width - first * 8
    held = bits[skip : skip + (stop - start) * width].reshape(stop - start, width).astype(np.uint32)
    return (held << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _encoded_blocks(path: str, end_id: int, width: int, block_ids: int):
    """Documents of a bucket, in order, to its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, True)
        bucket, block, start, count = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids, held = [], []

        def close() -> pa.RecordBatch:
            ends, ids, known = np.cumsum([len(h) for h in held]), np.concatenate(held), [i for i in doc_ids if i is not None]
            row = {"bucket": bucket, "block": block, "start": start, "n_ids": len(ids), "first_id": known[0] if known else None, "last_id": known[-1] if known else None}
            row |= {"width": width, "doc_ids": doc_ids, "ends": ends.tolist(), "payload": pack(ids, width)}
            types = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for batch in batches:
            for at, texts in slices(batch.column("text")):
                ids, offsets = enc.encode(texts)
                names = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                for doc_id, a, b in zip(names, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    if count >= block_ids:
                        yield close()
                        block, start, count, doc_ids, held = block + 1, start + count, 0, [], []
                    doc_ids.append(doc_id)
                    held.append(np.append(ids[a:b], ids.dtype.type(end_id)))
                    count += b - a + 1
        if held:
            yield close()

    return run


def write_ids(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 0, bucket_bytes: int = BUCKET_BYTES, block_ids: int = BLOCK_IDS) -> str:
    """Encode whole texts (null: empty), end each with ``end_id`` and write them in ascending doc_id order.

    Rows with a null id come first; rows that share an id follow each other, ordered by a hash of their
    texts, and may be spread over several buckets, as rows repeated whole may. Other columns are ignored.
    An empty table writes no block. Returns the folder.

    Texts are dealt to buckets by range of id before they are encoded, so a task sorts the texts of one
    bucket (on disk where they do not fit) and holds one slice of them with its ids and one block.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path("byte_bpe_50k.json")
    path = path or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    keyed = rows.select("doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"), "text")
    ranged = keyed.repartitionByRange(max(partitions(spark), -(-total // bucket_bytes)), *order).sortWithinPartitions(*order)
    width = bit_width(encoder(tokenizer, True).vocabulary)
    blocks = ranged.select("doc_id", "text").mapInArrow(_encoded_blocks(tokenizer, end_id, width, block_ids), BLOCK_SCHEMA)
    blocks.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return path


def blocks_of(spark, path: str) -> DataFrame:
    """The blocks of a folder; a folder without any is an empty table."""
    return spark.read.schema(BLOCK_SCHEMA).option("basePath", path).parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            begin = row["before"] + row["start"]
            ids = unpack(row["payload"], row["width"], 0, row["n_ids"]).astype("<u4")
            ends = np.array(row["ends"], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(begin + starts), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written files."""
    blocks = blocks_of(spark, path)
    sizes = blocks.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    # One row per bucket: a 16 MB table of them stands for some 64 TB of text.
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return blocks.join(F.broadcast(before), "bucket").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_ids(spark, path: str, doc_id: int) -> list[int]:
    """Random access: the ids of one document (of several rows with that id, of the first), from its block alone.

    First and last ids are compared first, by Parquet's statistics where a file holds no such block.
    """
    holds = (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) & F.array_contains("doc_ids", F.lit(doc_id))
    row = blocks_of(spark, path).where(holds).orderBy("bucket", "block").first()
    if row is None:
        return []
    at = row["doc_ids"].index(doc_id)
    return unpack(bytes(row["payload"]), row["width"], row["ends"][at - 1] if at else 0, row["ends"][at]).tolist()
