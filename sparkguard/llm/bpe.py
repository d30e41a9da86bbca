"""BPE with forced boundaries: cut where no vocabulary token can reach across, encode the fragments apart.

Two neighbouring bytes that stand side by side in no vocabulary token can never end up in one token, so
the text may be cut between them before any merge. With the white space that the pre-tokenizer drops and
its word pattern, these cuts leave short fragments that repeat all over a corpus; each is merged once
per worker and the ids are concatenated. Decoding is a table look-up per id.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import MEMO_CHUNKS, MEMO_LENGTH, PreTokens, chunk_codes, load, slices, tokenizer_path

#: Rank of a pair that never merges; fragments of more symbols are merged one by one; chunks learned at once.
_NONE, LONG, BATCH = 2**31 - 1, 256, 60_000


class ForcedBoundaryBPE:
    """Encoder for a byte-level BPE vocabulary file whose words end in a suffix and whose white space is dropped."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        model = spec["model"]
        self.library = load(path)
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.pre = PreTokens(self.library)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        bare = [t.removesuffix(self.suffix) if self.suffix else t for t in self.vocab]
        self.inside = {t[i : i + 2] for t in bare for i in range(len(t) - 1)}
        self.token = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for content, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = content
        self.token_bytes = [t.encode() for t in self.token]
        # Merges by sorted pair for the look-ups of many pairs at once.
        keys = np.array([(a << 32) | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int32)[order]
        self.made = np.zeros(len(pairs), np.int64)
        for rank, new in self.merges.values():
            self.made[rank] = new
        self.base, self.base_last = (np.array([self.vocab.get(chr(c) + end, 0) for c in range(512)], np.int64) for end in ("", self.suffix))
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.fragments: dict[str, tuple[bytes, bytes]] = {}

    def _words(self, chunk: str) -> list[str]:
        """Pre-tokens in the byte alphabet. Only plain characters are split here, others by the library."""
        words = self.pre.plain(chunk)
        if words is None:
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]
        return words

    def _cut(self, chunk: str) -> list[str]:
        """Fragments between forced boundaries; a space behind one marks the end of a word, NUL a special string."""
        out: list[str] = []
        parts = self.at_special.split(chunk) if self.at_special and "<" in chunk else [chunk]
        for part in parts:
            if part in self.special:
                out.append("\0" + part)
                continue
            for word in self._words(part):
                if self.inside.issuperset(map(add, word, word[1:])):
                    out.append(word + " ")
                    continue
                at = 0
                for i in range(1, len(word)):
                    if word[i - 1 : i + 1] not in self.inside:
                        out.append(word[at:i])
                        at = i
                out.append(word[at:] + " ")
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges of neighbours, _NONE where there is none."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def _merge_many(self, fragments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all fragments in order, how many each has). Each round does one merge in every unfinished fragment."""
        last = np.array([f[-1] == " " for f in fragments])
        texts = [f[:-1] if f[-1] == " " else f for f in fragments]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-16-le"), "<u2")
        sym, seg = self.base[codes], np.repeat(np.arange(len(texts)), lengths)
        ends = np.cumsum(lengths)[last] - 1
        sym[ends] = self.base_last[codes[ends]]
        rank = np.full(len(sym), _NONE, np.int32)
        inner = np.flatnonzero(seg[:-1] == seg[1:])
        rank[inner] = self._ranks(sym[inner], sym[inner + 1])
        done_sym, done_seg = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(sym)))
            live = best < _NONE
            if not live.all():
                going = np.repeat(live, lengths)
                done_sym.append(sym[~going])
                done_seg.append(seg[~going])
                sym, seg, rank, best, lengths = sym[going], seg[going], rank[going], best[live], lengths[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, lengths))
            at = at[np.concatenate([[True], seg[at[1:]] != seg[at[:-1]]])]  # the leftmost of each fragment
            sym[at] = self.made[best]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, seg, rank = sym[keep], seg[keep], rank[keep]
            at -= np.arange(len(at))
            rank[at] = _NONE
            right = at[at + 1 < len(sym)]
            right = right[seg[right] == seg[right + 1]]
            rank[right] = self._ranks(sym[right], sym[right + 1])
            left = at[at > 0] - 1
            left = left[seg[left] == seg[left + 1]]
            rank[left] = self._ranks(sym[left], sym[left + 1])
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        return sym[np.argsort(seg, kind="stable")], np.bincount(seg, minlength=len(texts))

    def _learn(self, fragments: list[str]) -> None:
        """Merge fragments that the worker does not hold."""
        if len(self.fragments) > MEMO_CHUNKS:
            self.fragments = {}
        known, token = self.fragments, self.token_bytes
        fresh = [f for f in dict.fromkeys(fragments) if f not in known]
        short = [f for f in fresh if f[0] != "\0" and len(f) <= LONG]
        if short:
            ids, counts = self._merge_many(short)
            raw, flat = ids.astype("<u4").tobytes(), ids.tolist()
            at = 0
            for f, n in zip(short, counts.tolist(), strict=True):
                known[f] = raw[4 * at : 4 * (at + n)], b" ".join([token[i] for i in flat[at : at + n]])
                at += n
        for f in fresh:
            if f[0] == "\0" or len(f) > LONG:
                ids = [self.special[f[1:]]] if f[0] == "\0" else self._merge_long(f)
                known[f] = array("I", ids).tobytes(), b" ".join([token[i] for i in ids])

    def _merge_long(self, fragment: str) -> list[int]:
        """The same for one fragment of any length, by a heap of pairs over a linked list."""
        text = fragment.removesuffix(" ")
        symbols = [self.vocab[c] for c in text]
        if text is not fragment and len(text) < len(fragment):
            symbols[-1] = self.vocab[text[-1] + self.suffix]
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*self.merges[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in self.merges]
        heap = [(rank, i, p, new) for rank, new, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, pair, new = heapq.heappop(heap)
            j = after[i] if symbols[i] >= 0 else -1
            if j < 0 or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merges.get((symbols[x], symbols[y]))):
                    heapq.heappush(heap, (m[0], x, (symbols[x], symbols[y]), m[1]))
        return [s for s in symbols if s >= 0]

    def chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit, decoded text in UTF-8) of distinct space-free chunks."""
        young, old = self.young.get, self.old.get
        out = [young(c) or old(c) for c in chunks]
        missing = [i for i, found in enumerate(out) if found is None]
        for at in range(0, len(missing), BATCH):
            part = missing[at : at + BATCH]
            cut = [self._cut(chunks[i]) for i in part]
            self._learn([f for fragments in cut for f in fragments])
            known = self.fragments
            for i, fragments in zip(part, cut, strict=True):
                if len(fragments) == 1:
                    out[i] = known[fragments[0]]
                else:
                    held = [known[f] for f in fragments]
                    out[i] = b"".join([h[0] for h in held]), b" ".join([h[1] for h in held])
        if len(self.young) > MEMO_CHUNKS:
            self.old, self.young = self.young, {}
        self.young.update(p for p in zip(chunks[:MEMO_CHUNKS], out[:MEMO_CHUNKS], strict=True) if len(p[0]) <= MEMO_LENGTH)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text without begin and end; special strings in it give their ids."""
        words = text.split(" ")
        known = dict(zip(distinct := list(dict.fromkeys(words)), self.chunks(distinct), strict=True))
        return np.frombuffer(b"".join([known[w][0] for w in words]), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: what a vocabulary file without a decoder means."""
        return " ".join(map(self.token.__getitem__, ids))


_MADE: dict[str, ForcedBoundaryBPE] = {}


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _MADE.get(path) or _MADE.setdefault(path, ForcedBoundaryBPE(path))
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                chunks, codes, offsets = chunk_codes(texts, False)
                pool = bpe.chunks(chunks)
                filled = np.fromiter((bool(p[0]) for p in pool), bool, len(pool))
                n, ids, decoded = [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    mine = codes[a:b]
                    mine = [pool[c] for c in mine[filled[mine]].tolist()]
                    raw = b"".join([m[0] for m in mine])
                    n.append(len(raw) // 4)
                    ids.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(b" ".join([m[1] for m in mine])).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; null counts as empty.

    A map over the table without a shuffle. Repeated rows give repeated rows, a null id stays null, other
    columns are ignored. A very long text is one row of one task, in memory proportional to it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_digest(path or tokenizer_path("word_bpe_49k.json")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
