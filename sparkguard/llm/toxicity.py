"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document is the set of its distinct hashed n-grams. Slot s is scaled by r_s = log((p_s / |p|) / (q_s / |q|)),
p and q being how many toxic and clean training documents hold it; slots whose ratio is within CONFIDENT standard errors
of 0 are left out, as the many of a long text would outweigh the few that tell; the scaled vector has length 1;
logistic regression on such vectors gives the score. Training takes a bounded sample of labelled documents
(``SAMPLE`` documents and ``FIT_BYTES`` of each class, drawn by hash, whole texts); scoring is a map over the
table without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, fold, released
from .grams import batches_of, presence

#: Orders of the n-grams and bits of a slot of each order.
ORDERS, BITS = (5, 6), 18
#: The most training documents of each class: toxic, clean.
SAMPLE = (600, 1200)
#: The most bytes that the slots of each class take: a document takes 8 a byte of text, up to 4 a slot.
FIT_BYTES = 48 << 20
#: A slot in fewer training documents has no weight.
MIN_DOCUMENTS = 3
#: A slot has no weight unless its ratio is this many standard errors, sqrt(1 / p_s + 1 / q_s), from 0.
CONFIDENT = 2.0
#: Training documents whose values are worked on at once.
BLOCK = 100
FOLDS, HELD_OUT = 5, 0


@dataclass
class Model:
    weight: np.ndarray  # of each slot, times its ratio
    square: np.ndarray  # of its ratio
    bias: float

    def score(self, slots: np.ndarray) -> float:
        z = float(self.weight[slots].sum()) / (float(self.square[slots].sum()) ** 0.5 + 1e-9) + self.bias
        return 1 / (1 + np.exp(-min(50.0, max(-50.0, z))))


def fit(slots: list[np.ndarray], toxic: np.ndarray, size: int, rounds: int = 60, l2: float = 1e-4, step: float = 8.0) -> Model:
    """Ratios with add-one smoothing, then accelerated gradient descent on class-balanced logistic loss.

    Without documents of both classes there is nothing to tell apart: the score is then the one class.
    """
    if not len(slots) or toxic.min() == toxic.max():
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 50.0 if len(slots) and toxic.max() else -50.0)
    p, q = np.ones(size), np.ones(size)
    for s, label in zip(slots, toxic, strict=True):
        (p if label else q)[s] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(p + q - 2 < MIN_DOCUMENTS) | (np.abs(ratio) < CONFIDENT * np.sqrt(1 / p + 1 / q))] = 0
    # A value is ratio[slot] / norm[document], so slots alone are kept and no array holds all documents' values.
    square = ratio**2
    slots = [s[ratio[s] != 0] for s in slots]
    norm = np.array([np.sqrt(square[s].sum()) for s in slots]) + 1e-9
    blocks = [(slice(at, at + BLOCK), slots[at : at + BLOCK]) for at in range(0, len(slots), BLOCK)]
    y = toxic.astype(float)
    share = y.mean()
    cost = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    step /= 0.25 * cost.max() * len(y)
    w, ahead, bias, bias_ahead = np.zeros(size), np.zeros(size), 0.0, 0.0
    for k in range(rounds):
        scaled, summed, gradient_bias = ratio * ahead, np.zeros(size), 0.0
        for mine, some in blocks:
            slot, row = np.concatenate(some), np.repeat(np.arange(len(some)), [len(s) for s in some])
            z = np.bincount(row, scaled[slot], len(some)) / norm[mine] + bias_ahead
            g = cost[mine] * (1 / (1 + np.exp(-z)) - y[mine])
            summed += np.bincount(slot, (g / norm[mine])[row], size)
            gradient_bias += g.sum()
        gradient = l2 * ahead + ratio * summed
        new, new_bias = ahead - step * gradient, bias_ahead - step * gradient_bias
        m = k / (k + 3)
        ahead, bias_ahead = new + m * (new - w), new_bias + m * (new_bias - bias)
        w, bias = new, new_bias
    return Model((w * ratio).astype(np.float32), square.astype(np.float32), float(bias))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for _, texts in batches_of(batch):
            data = [s.astype("<i4").tobytes() for s in presence(texts, ORDERS, BITS, pad=True)]
            kept = [batch.column(c).slice(at, len(texts)) for c in ("toxic", "draw", "text_hash")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(data, pa.binary())], ["toxic", "draw", "text_hash", "slots"])
            at += len(texts)


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """Fit on labelled documents outside the held-out fold; null labels and null ids are left out, of several labels the highest counts.

    Only ``sample`` documents of each class, and FIT_BYTES, reach the driver as sets of slots. Of several texts
    of one id the one with the lowest hash is used. lang, source and doc_id are no inputs.
    """
    size = len(ORDERS) << BITS
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).withColumn("draw", F.xxhash64("doc_id", F.lit("toxicity")))
    # The lowest draws of each class, more than are used, as some labels have no document here.
    picks = [known.where(F.col("toxic") == c).orderBy("draw", "doc_id").limit(2 * sample[1 - c]) for c in (0, 1)]
    picked = picks[0].unionByName(picks[1])
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").withColumn("text_hash", F.xxhash64("text"))
    sizes = rows.groupBy("doc_id", "toxic", "draw").agg(F.min(F.struct("text_hash", F.octet_length("text").alias("n_bytes"))).alias("x")).select("doc_id", "toxic", "draw", "x.*")
    slots = F.least(F.col("n_bytes") * (4 * len(ORDERS)), F.lit(4 * size))
    share = F.when(F.col("toxic") == 1, sample[0]).otherwise(sample[1])
    chosen = drawn(sizes, "toxic", share, slots, FIT_BYTES).select("doc_id", "text_hash")
    texts = rows.join(F.broadcast(chosen), ["doc_id", "text_hash"], "left_semi").groupBy("toxic", "draw", "text_hash").agg(F.first("text").alias("text"))
    found = texts.mapInArrow(released(_slots), "toxic int, draw long, text_hash long, slots binary").collect()
    got = sorted(found, key=lambda r: (r["draw"], r["toxic"], r["text_hash"]))
    return fit([np.frombuffer(r["slots"], "<i4") for r in got], np.array([r["toxic"] for r in got], int), size)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, texts in batches_of(batch):
                score = np.fromiter((model.score(s) for s in presence(texts, ORDERS, BITS, pad=True)), float, len(texts))
                mine = batch.slice(at, len(texts))
                at += len(texts)
                kept = [mine.column(i) for i in range(mine.num_columns)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*mine.schema.names, "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1, higher: likelier toxic) and predicted (score >= 0.5); null text counts as empty."""
    plain = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", score double, predicted int"
    return plain.mapInArrow(released(_score(model)), schema)


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; repeated rows give repeated rows, other columns are ignored.

    Null ids are in the fold of the empty text and take no label.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = score(rows, train(rows, labels))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
