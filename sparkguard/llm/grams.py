"""Hashed byte n-grams of lower-cased texts, computed by numpy over a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .encoding import slices

#: Odd multiplier of the multiplicative hash.
_MIX = np.uint32(0x9E3779B1)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def gram_slots(texts: pa.Array, orders: tuple[int, ...], bits: int, pad: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (slot below 2**bits of the n-gram at each position, offsets of the texts in them).

    Texts are lower-cased; ``pad`` adds a space before and behind each. A text shorter than n has no
    n-gram of that order.
    """
    texts = pc.utf8_lower(texts.cast(pa.large_string()))
    if pad:
        space = pa.scalar(" ", pa.large_string())
        texts = pc.binary_join_element_wise(space, texts, space, pa.scalar("", pa.large_string()))
    raw, offsets = _bytes(texts)
    length = np.diff(offsets)
    code, done = raw.astype(np.uint32), 1
    for n in sorted(orders):
        while done < n:
            code = code[:-1] * np.uint32(257) + raw[done:] if len(code) else code
            done += 1
        slots = ((code + np.uint32(n * 7919)) * _MIX) >> np.uint32(32 - bits)
        held = np.maximum(length - n + 1, 0)
        ends = np.cumsum(held)
        # Positions whose n-gram runs into the next text are left out.
        first = np.repeat(offsets[:-1] - (ends - held), held) + np.arange(int(ends[-1]) if len(ends) else 0)
        yield slots[first], np.concatenate([[0], ends])


def presence(texts: pa.Array, orders: tuple[int, ...], bits: int, pad: bool = False) -> Iterator[np.ndarray]:
    """For each text its distinct slots, order k of ``orders`` in [k * 2**bits, (k + 1) * 2**bits)."""
    found = list(gram_slots(texts, orders, bits, pad))
    stamp = np.zeros(1 << bits, np.int64)
    place = np.arange(max((int(np.diff(offsets).max()) for _, offsets in found if len(offsets) > 1), default=0))
    for i in range(len(texts)):
        out = []
        for k, (slots, offsets) in enumerate(found):
            mine = slots[offsets[i] : offsets[i + 1]]
            at = place[: len(mine)]
            stamp[mine] = at  # the last position of a slot stands for all of them
            out.append(mine[stamp[mine] == at].astype(np.int64) + (k << bits))
        yield np.concatenate(out) if out else np.zeros(0, np.int64)


def batches_of(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of a batch in pieces of about ``most`` bytes."""
    for at, texts in slices(batch.column("text"), most):
        yield at, texts
