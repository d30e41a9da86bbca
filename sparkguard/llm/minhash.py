"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find grouping.

Every element of a set draws a random permutation of the signature's slots and, for its j-th place, a random
fraction; its rank in the slot at that place is j plus the fraction, and a slot holds the lowest rank of all
elements. As an element's ranks are spread over all slots, fewer of them chance to lie together than with
independent hashes, and the estimate varies less. Places are taken in turn for all sets of a block at once; a
set stops as soon as all its slots are filled, since later places have higher ranks (sets with many elements need two or three).

A set's signature is cut into bands of ROWS slots. Two sets of similarity 0.85 share 25 of the 48 bands on average
and fewer than NEED with a probability of 1e-8, so candidates have to share NEED. The counting, without
pairs of the sets that a crowded band ties together, is that of ``ngram_join``, and so is the
exact check of candidate groups on their full sets with union-find in each cell.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .ngram_join import _A, _mix, similar_rows

#: Words of a shingle; similarity as a fraction.
WORDS, SIMILAR = 3, (85, 100)
#: Bands of a signature, its slots in each, and how many bands candidates share.
BANDS, ROWS, NEED = 48, 4, 7

_LOW = np.uint64(0xFFFFFFFF)


def _draws(elements: np.ndarray, place: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(fraction in 32 bits, exchange partner from ``place`` on) of each element at a place of its permutation."""
    x = _mix(elements + _A * np.array([place + 1], np.uint64))
    return x >> np.uint64(32), np.uint64(place) + (((x & _LOW) * np.uint64(slots - place)) >> np.uint64(32))


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One row of ``slots`` lowest ranks, place << 32 | fraction, for each non-empty set of 64-bit elements."""
    out = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    if not sets:
        return out.reshape(0, slots)
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    partners: list[np.ndarray] = []
    for place in range(slots):
        fraction, at = _draws(elements, place, slots)
        partners.append(at.astype(np.uint8 if slots <= 256 else np.uint32))
        # The slot at this place after the exchanges so far (the i-th place with its partner): follow it back.
        slot = partners[place].astype(np.int64)
        for i in range(place - 1, -1, -1):
            np.copyto(slot, i, where=slot == partners[i])
        np.minimum.at(out, owner * slots + slot, np.uint64(place) << np.uint64(32) | fraction)
        open_sets = (out.reshape(-1, slots) == np.iinfo(np.uint64).max).any(axis=1)
        if not open_sets.any():
            break
        goes_on = open_sets[owner]
        if not goes_on.all():
            elements, owner, partners = elements[goes_on], owner[goes_on], [p[goes_on] for p in partners]
    return out.reshape(-1, slots)


class Bands:
    """Band digests as signatures of which similar sets share NEED (with the probability above)."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, need: int = NEED):
        self.bands, self.rows, self.need = bands, rows, need

    def of(self, sets: list[np.ndarray]) -> list[list[tuple[np.ndarray, int]]]:
        ranks = super_minhash(sets, self.bands * self.rows).reshape(-1, self.bands, self.rows)
        keys = np.broadcast_to(_mix(np.arange(self.bands, dtype=np.uint64) + _A), ranks.shape[:2]).copy()
        for k in range(self.rows):
            keys = _mix(keys * _A + ranks[:, :, k])
        return [[(row, self.need)] for row in keys]


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; component_id is the smallest doc_id reachable by links of Jaccard >= 0.85.

    kept: whether the row's id is its component's. Null or blank texts have no shingles and link with nothing;
    texts of fewer words than a shingle have one, their whole sequence. Repeated rows share a component, and
    rows with the component's id are all kept. Rows without an id link like others; such a row is
    kept if its component holds no id and it is the first of it, or if it has no words. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = materialize(docs.withColumn("rid", F.monotonically_increasing_id()), "minhash-base")
    found = similar_rows(base, words, Bands, SIMILAR)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), "kept").alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component, the one with the smallest doc_id (null last), and all without words."""
    rows = materialize(docs.select(F.struct(*docs.columns).alias("row")).withColumn("rid", F.monotonically_increasing_id()), "minhash-base")
    base = rows.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    gone = similar_rows(base, words, Bands, SIMILAR).where(~F.col("kept")).select("rid")
    return rows.join(gone, "rid", "left_anti").select("row.*")
