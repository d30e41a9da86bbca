"""Whole-text encoding inside tasks: every distinct chunk of a batch goes through the tokenizers library once.

Both vocabularies split at a single space between two non-space characters whatever stands around it, so
the pieces of a text are the pieces of its space-separated chunks in order. A batch of texts is split
and dictionary-encoded by Arrow, the library sees only chunks that the worker has not met lately, and
numpy puts the ids of the chunks together again.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Texts are taken together up to about this many bytes.
SLICE_BYTES = 8 << 20
#: Chunks in each of the two generations that a worker remembers, and the longest that it does.
MEMO_CHUNKS, MEMO_LENGTH = 200_000, 48

_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space beside more white space: there the run counts as a whole, and only lone spaces may be cut.
_RUN = f"[{_SPACES}] | [{_SPACES}]"
_LONE = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def slices(texts: pa.StringArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.StringArray]]:
    """(first row, rows) of about ``most`` bytes each; nulls count as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def chunk_codes(texts: pa.Array, keep_space: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, the code of each chunk in order, offsets of the texts in the codes).

    keep_space: every chunk but a text's first begins with the space that it was cut at.
    """
    runs = pc.match_substring_regex(texts, _RUN) if keep_space else None
    if runs is not None and pc.any(runs).as_py():
        split = [_LONE.split(t) if run else t.split(" ") for t, run in zip(texts.to_pylist(), runs.to_pylist(), strict=True)]
        lists = pa.array(split, pa.large_list(pa.large_string()))
    else:
        lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    offsets = offsets - offsets[0]
    codes, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()
    if not keep_space:
        return words, codes, offsets
    codes = codes * 2 + 1
    codes[offsets[:-1]] -= 1
    used = np.flatnonzero(np.bincount(codes, minlength=1))
    place = np.zeros(2 * len(words) + 1, np.int64)
    place[used] = np.arange(len(used))
    return [" " + words[u >> 1] if u & 1 else words[u >> 1] for u in used.tolist()], place[codes], offsets


def ragged(pool: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` that ``codes`` name, one after the other, and the end of each."""
    starts = np.cumsum(lengths) - lengths
    mine = lengths[codes]
    ends = np.cumsum(mine)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(starts[codes] - (ends - mine), mine)], ends


#: The pattern of the byte-level pre-tokenizer (a fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PreTokens:
    """Pre-tokens, in the byte alphabet, of chunks whose characters mean the same in every Unicode version."""

    #: ASCII, and the Latin letters and signs up to U+017F that have neither marks to compose nor odd classes.
    _PLAIN = regex.compile(r"[\n -~¡-¬®-ſ]*")

    def __init__(self, tokenizer):
        spec = json.loads(tokenizer.to_str())
        pre = spec["pre_tokenizer"]
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        self.pattern = regex.compile(BYTE_LEVEL if pre["type"] == "ByteLevel" else pre["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.alphabet = byte_alphabet()
        self.ascii = {b: c for b, c in enumerate(self.alphabet[:128])}

    def plain(self, chunk: str) -> list[str] | None:
        """None: the library has to split it (other characters, or a special string)."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower() if self.lower else chunk]
            if chunk[:1] == " " and chunk[1:].isalpha() and not self.lower:
                return [self.alphabet[32] + chunk[1:]]
        if not self._PLAIN.fullmatch(chunk) or "<" in chunk and any(s in chunk for s in self.special):
            return None
        found = self.pattern.findall(chunk.lower() if self.lower else chunk)
        return [w.translate(self.ascii) if w.isascii() else "".join([self.alphabet[b] for b in w.encode()]) for w in found]


class ChunkEncoder:
    """Ids of whole texts as the library gives them without begin and end.

    Plain chunks are split here and go to the library's model word by word; all others go through the
    whole library.
    """

    def __init__(self, path: str, keep_space: bool):
        self.tokenizer, self.keep_space = load(path), keep_space
        self.pre, self.model = PreTokens(self.tokenizer), self.tokenizer.model
        self.young, self.old = {}, {}
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.code, self.dtype = ("H", np.uint16) if self.vocabulary <= 1 << 16 else ("I", np.uint32)

    def _pool(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks. What a full generation holds stays known while the next one fills."""
        young, old, code, plain, tokenize = self.young.get, self.old.get, self.code, self.pre.plain, self.model.tokenize
        out = [young(c) or old(c) for c in chunks]
        rest = []
        for i, known in enumerate(out):
            if known is None:
                words = plain(chunks[i])
                if words is None:
                    rest.append(i)
                else:
                    out[i] = array(code, [t.id for w in words for t in tokenize(w)]).tobytes()
        for at in range(0, len(rest), 1024):
            part = rest[at : at + 1024]
            for i, found in zip(part, self.tokenizer.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = array(code, found.ids).tobytes()
        if len(self.young) > MEMO_CHUNKS:
            self.old, self.young = self.young, {}
        self.young.update(p for p in zip(chunks[:MEMO_CHUNKS], out[:MEMO_CHUNKS], strict=True) if len(p[0]) <= MEMO_LENGTH)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        chunks, codes, offsets = chunk_codes(texts, self.keep_space)
        pool = self._pool(chunks)
        lengths = np.fromiter(map(len, pool), np.int64, len(pool)) // self.dtype().itemsize
        ids, ends = ragged(np.frombuffer(b"".join(pool), self.dtype), lengths, codes)
        return ids, np.concatenate([[0], ends])[offsets] if len(codes) else np.zeros(len(texts) + 1, np.int64)


_ENCODERS: dict = {}


def encoder(path: str, keep_space: bool) -> ChunkEncoder:
    """One per Python worker."""
    if (path, keep_space) not in _ENCODERS:
        _ENCODERS[path, keep_space] = ChunkEncoder(path, keep_space)
    return _ENCODERS[path, keep_space]
