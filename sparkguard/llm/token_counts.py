"""Token counts from a pre-token vocabulary: count once per distinct pre-token, join, sum.

1. Each block of documents (what a task reads at once) lists its distinct pre-tokens with postings: which
   of its documents hold the pre-token and how often.
2. The postings are sorted by pre-token across the cluster. The pieces of a pre-token are counted once, at
   the first row of its run, and joined to every posting of the run.
3. Each block adds up frequency times pieces per document.

No ids are materialized, and no row stands for a (document, pre-token) pair: a very common pre-token has
one row per block, however many documents hold it, and those rows are dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import BYTE_LEVEL, chunk_codes, load, slices, tokenizer_path

#: A posting: document in its block, frequency; higher frequencies take several postings.
POSTING = np.dtype([("doc", "<u2"), ("freq", "u1")])
#: A partial sum: document in its block, pieces.
PARTIAL = np.dtype([("doc", "<u2"), ("n", "<u8")])
#: Partial sums of a task are sent on beyond so many bytes.
HELD_BYTES = 32 << 20
#: Postings of a block from which a pre-token counts as hot, and over how many keys it is then dealt.
SALTED_POSTINGS, SALTS = 256, 256
BLOCK_BYTES = 48 << 20
#: Bytes of a block that are split at once.
PART_BYTES = 8 << 20

_PATTERN = regex.compile(BYTE_LEVEL)
#: Characters whose class does not depend on the Unicode version; other chunks are split by the library.
_PLAIN = regex.compile(r"[\n -~¡-ſ]*")
_LIBRARY: dict = {}


def _library(path: str):
    if path not in _LIBRARY:
        _LIBRARY[path] = load(path)
    return _LIBRARY[path]


def _pre_tokens(chunk: str, library, special: list[str]) -> list[str]:
    for s in special:
        if s in chunk:
            parts = chunk.split(s)
            out = _pre_tokens(parts[0], library, special)
            for p in parts[1:]:
                out += [s, *_pre_tokens(p, library, special)]
            return out
    if _PLAIN.fullmatch(chunk):
        return _PATTERN.findall(chunk)
    return [chunk[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(chunk)]


def _postings(path: str):
    """Rows (pre_token, block, data). A block's header has a null pre-token and its documents' ids and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(path)
        special = [t.content for t in library.get_added_tokens_decoder().values()]
        task, seq = TaskContext.get().partitionId(), 0

        def rows(pre: list, block: int, data: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pre, pa.string()), pa.array([block] * len(pre), pa.int64()), pa.array(data, pa.binary())], ["pre_token", "block", "data"])

        for batch in batches:
            for at, texts in slices(batch.column("text"), BLOCK_BYTES):
                for low in range(0, len(texts), 1 << 16):
                    part = texts.slice(low, 1 << 16)
                    ids = batch.column("doc_id").slice(at + low, len(part))
                    block, seq = (task << 32) | seq, seq + 1
                    known, n_bytes = ids.is_valid().to_numpy(zero_copy_only=False), []
                    index: dict[str, int] = {}
                    doc_of, code_of, freq_of = [], [], []
                    for first, some in slices(part, PART_BYTES):
                        n_bytes += [len(t.encode()) for t in some.to_pylist()]
                        chunks, codes, offsets = chunk_codes(some, True)
                        split = [_pre_tokens(c, library, special) for c in chunks]
                        local = np.array([index.setdefault(p, len(index)) for s in split for p in s], np.int64)
                        lengths = np.fromiter(map(len, split), np.int64, len(split))
                        starts = np.cumsum(lengths) - lengths
                        mine = lengths[codes]
                        ends = np.cumsum(mine)
                        flat = local[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[codes] - (ends - mine), mine)]
                        doc = np.repeat(np.repeat(np.arange(len(some)) + first, np.diff(offsets)), mine)
                        pair, freq = np.unique((doc << 40) | flat, return_counts=True)
                        doc_of.append(pair >> 40)
                        code_of.append(pair & ((1 << 40) - 1))
                        freq_of.append(freq)
                    header = np.array([ids.fill_null(0).to_numpy(zero_copy_only=False), np.array(n_bytes), known], "<i8").tobytes()
                    yield rows([None], block, [header])
                    doc, code, freq = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc_of, code_of, freq_of))
                    order = np.argsort(code, kind="stable")
                    doc, code, freq = doc[order], code[order], freq[order]
                    times = -(-freq // 255)  # postings of at most 255 each
                    last = np.cumsum(times) - 1
                    data = np.zeros(int(times.sum()), POSTING)
                    data["doc"], data["freq"] = np.repeat(doc, times), 255
                    if len(data):
                        data["freq"][last] = freq - (times - 1) * 255
                    cuts = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(code, times), minlength=len(index)))]) * POSTING.itemsize
                    raw, names = data.tobytes(), list(index)
                    for a in range(0, len(names), 20_000):
                        some = names[a : a + 20_000]
                        yield rows(some, block, [raw[x:y] for x, y in zip(cuts[a : a + len(some)].tolist(), cuts[a + 1 : a + len(some) + 1].tolist(), strict=True)])

    return run


def _count_once(path: str):
    """Rows sorted by pre-token to partial sums (block, header or not, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(path)
        last, pieces = None, 0
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def out(blocks: list[int], header: bool, data: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([header] * len(blocks), pa.bool_()), pa.array(data, pa.binary())], ["block", "header", "data"])

        def summed() -> Iterator[pa.RecordBatch]:
            for block, (docs, ns) in held.items():
                doc, n = np.concatenate(docs), np.concatenate(ns)
                total = np.bincount(doc, n)
                part = np.zeros(np.count_nonzero(total), PARTIAL)
                part["doc"] = np.flatnonzero(total)
                part["n"] = total[part["doc"]]
                yield out([block], False, [part.tobytes()])

        for batch in batches:
            pre, blocks, data = (batch.column(i).to_pylist() for i in range(3))
            fresh = [p for p, before in zip(pre, [last, *pre], strict=False) if p is not None and p != before]
            counts = dict(zip(fresh, (len(e) for e in library.encode_batch_fast(fresh, add_special_tokens=False)), strict=True))
            if last is not None:
                counts[last] = pieces
            lengths = np.fromiter(map(len, data), np.int64, len(data)) // POSTING.itemsize
            for p, block, d in zip(pre, blocks, data, strict=True):
                if p is None:
                    yield out([block], True, [d])
            mine = [i for i, p in enumerate(pre) if p is not None]
            if mine:
                post = np.frombuffer(b"".join(data[i] for i in mine), POSTING)
                lengths = lengths[mine]
                n = post["freq"].astype(np.float64) * np.repeat(np.array([counts[pre[i]] for i in mine], np.float64), lengths)
                block = np.repeat(np.array([blocks[i] for i in mine], np.int64), lengths)
                order = np.argsort(block, kind="stable")
                block, doc, n = block[order], post["doc"][order].astype(np.int64), n[order]
                which, starts = np.unique(block, return_index=True)
                for b, lo, hi in zip(which.tolist(), starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True):
                    docs, ns = held.setdefault(b, ([], []))
                    docs.append(doc[lo:hi])
                    ns.append(n[lo:hi])
                    size += 16 * (hi - lo)
                last, pieces = pre[mine[-1]], counts[pre[mine[-1]]]
            if size > HELD_BYTES:
                yield from summed()
                held, size = {}, 0
        yield from summed()

    return run


def _per_document(limit: int):
    def run(rows: pa.Table) -> pa.Table:
        header, data = rows.column("header").to_pylist(), rows.column("data").to_pylist()
        ids, n_bytes, known = np.frombuffer(data[header.index(True)], "<i8").reshape(3, -1)
        total = np.zeros(len(ids), np.int64)
        for h, d in zip(header, data, strict=True):
            if not h:
                part = np.frombuffer(d, PARTIAL)
                total[part["doc"]] += part["n"].astype(np.int64)
        return pa.table({"doc_id": pa.array(ids, mask=known == 0), "n_bytes": pa.array(n_bytes), "n_tokens": pa.array(total), "over_limit": pa.array(total > limit)})

    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; null counts as empty (0, 0, false).

    Repeated rows give repeated rows, a null id stays null, other columns are ignored, an empty table
    gives an empty result. Special strings inside a text count as the library counts them by default.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    postings = rows.mapInArrow(_postings(path), "pre_token string, block long, data binary")
    # Headers go by block. A pre-token that fills a block's postings is spread over SALTS tasks and counted once in each.
    spread = F.when(F.col("pre_token").isNull(), F.col("block")).when(F.length("data") > SALTED_POSTINGS * POSTING.itemsize, F.pmod(F.xxhash64("block"), F.lit(SALTS)))
    counted = postings.repartition(F.col("pre_token"), spread).sortWithinPartitions("pre_token").mapInArrow(_count_once(path), "block long, header boolean, data binary")
    return counted.groupBy("block").applyInArrow(_per_document(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
