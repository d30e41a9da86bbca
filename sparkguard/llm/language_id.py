"""Language by string kernels: blended-spectrum presence kernels, Nyström landmarks, kernel ridge regression.

k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), G(x) being the distinct n-grams of all orders of a text.
Landmarks L give the Nyström features K(x, L) K(L, L)^(-1/2); one-versus-rest ridge regression on them gives
a value per language. Presence vectors are hashed, so K(x, L) is a product of matrices and the map from
presence to values folds into one matrix: a batch is scored by one product. Landmarks and training
documents are a bounded sample (parameters), drawn by hash within each language, whole texts. Every known
language is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, fold, released
from .grams import batches_of, gram_slots, presence

ORDERS, BITS = (1, 2, 3), 13
#: The most training documents and landmarks, all languages together.
TRAINING, LANDMARKS = 1600, 400
#: Training documents that a language gives at least, if it has them, and bytes of slots of all languages together.
LEAST, FIT_BYTES = 8, 64 << 20
RIDGE = 0.1
#: How sharply values become scores.
SHARPNESS = 6.0
#: Rows of a matrix product.
ROWS = 128
FOLDS, HELD_OUT = 4, 2
SIZE = len(ORDERS) << BITS


@dataclass
class Model:
    languages: list[str]
    values: np.ndarray  # slots x languages
    bias: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, its score) of each text."""
        best, score = [], []
        for at in range(0, len(texts), ROWS):
            some = texts.slice(at, ROWS)
            held = np.zeros((len(some), SIZE), np.float32)
            flat = held.ravel()
            for k, (slots, offsets) in enumerate(gram_slots(some, ORDERS, BITS, pad=True)):
                flat[np.repeat(np.arange(len(some)) * SIZE + (k << BITS), np.diff(offsets)) + slots] = 1
            value = (held @ self.values) / np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1)) + self.bias
            chance = np.exp(SHARPNESS * (value - value.max(axis=1, keepdims=True)))
            chance /= chance.sum(axis=1, keepdims=True)
            best.append(chance.argmax(axis=1))
            score.append(chance.max(axis=1))
        return np.concatenate(best) if best else np.zeros(0, int), np.concatenate(score) if score else np.zeros(0)


def fit(slots: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((SIZE, 0), np.float32), np.zeros(0, np.float32))
    # Landmarks take turns between the languages, so that a rare one has its share.
    seen: dict[str, int] = {}
    turn = [seen.setdefault(lang, 0) for lang in langs]
    for i, lang in enumerate(langs):
        turn[i] = seen[lang]
        seen[lang] += 1
    chosen = np.argsort(turn, kind="stable")[:landmarks]
    marks = np.zeros((len(chosen), SIZE), np.float32)
    for row, i in enumerate(chosen):
        marks[row, slots[i]] = 1 / np.sqrt(max(1, len(slots[i])))
    kernel = np.zeros((len(slots), len(chosen)))
    for i, s in enumerate(slots):
        kernel[i] = marks[:, s].sum(axis=1) / np.sqrt(max(1, len(s)))
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    z = kernel @ root
    goal = np.where(np.array(langs)[:, None] == np.array(languages), 1.0, -1.0)
    weight = np.array([1 / seen[lang] for lang in langs])
    weight *= len(langs) / weight.sum()
    centre, middle = (weight[:, None] * z).mean(axis=0), (weight[:, None] * goal).mean(axis=0)
    zc = z - centre
    coef = np.linalg.solve(zc.T @ (weight[:, None] * zc) + ridge * np.eye(z.shape[1]), zc.T @ (weight[:, None] * (goal - middle)))
    return Model(languages, (marks.T @ (root @ coef).astype(np.float32)), (middle - centre @ coef).astype(np.float32))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for _, texts in batches_of(batch):
            data = [s.astype("<i4").tobytes() for s in presence(texts, ORDERS, BITS, pad=True)]
            kept = [batch.column(c).slice(at, len(texts)) for c in ("lang", "draw", "text_hash")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(data, pa.binary())], ["lang", "draw", "text_hash", "slots"])
            at += len(texts)


def train(docs: DataFrame, training: int = TRAINING, landmarks: int = LANDMARKS, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """Fit on text and language of documents outside the held-out fold whose language is known and text has a letter.

    Each language gives its even share of ``training`` documents, LEAST where that is less, and of FIT_BYTES,
    but at least one document. They are drawn by a hash of id and text; rows repeated whole count once.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held_out))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a language, as the model has
    if not counts:
        return fit([], [])
    share = max(LEAST, training // len(counts))
    known = known.select("doc_id", "text", "lang", F.xxhash64("text").alias("text_hash"))
    known = known.withColumn("draw", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("language")), F.lit(1 << 30)))
    # A threshold lets about twice the share through; of those the lowest are taken.
    limits = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int((1 << 30) * min(1.0, (2 * share + 30) / r["n"])))])
    few = known.where((F.col("draw") < F.element_at(limits, F.col("lang"))) & F.col("text").rlike(r"\p{L}"))
    key = ["lang", "doc_id", "text_hash", "draw"]
    sizes = few.groupBy(*key).agg(F.max(F.octet_length("text")).alias("n_bytes"))
    slots = F.least(F.col("n_bytes") * len(ORDERS), F.lit(SIZE)) * 4
    picked = drawn(sizes, "lang", F.lit(share), slots, FIT_BYTES // len(counts)).select(*key)
    # At most a share of each language: bounded by the parameters and the number of languages.
    rows = few.join(F.broadcast(picked.select("lang", "draw", "text_hash")), ["lang", "draw", "text_hash"], "left_semi")
    texts = rows.groupBy("lang", "draw", "text_hash").agg(F.first("text").alias("text"))
    found = texts.mapInArrow(released(_slots), "lang string, draw long, text_hash long, slots binary").collect()
    got = [(r["lang"], bytes(r["slots"])) for r in sorted(found, key=lambda r: (r["lang"], r["draw"], r["text_hash"]))]
    return fit([np.frombuffer(s, "<i4") for _, s in got], [lang for lang, _ in got], landmarks)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*model.languages, "und"]
        for batch in batches:
            at = 0
            for _, texts in batches_of(batch):
                lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                best, score = model.predict(texts) if model.languages else (np.zeros(len(texts), int), np.zeros(len(texts)))
                best, score = np.where(lettered & bool(model.languages), best, len(names) - 1), np.where(lettered, score, 0.0)
                mine = batch.slice(at, len(texts))
                at += len(texts)
                kept = [mine.column(i) for i in range(mine.num_columns)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([names[b] for b in best]), pa.array(score.astype(float))], [*mine.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; `und` with score 0 where the text is null or has no letter."""
    plain = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", lang_pred string, score double"
    return plain.mapInArrow(released(_predict(model)), schema)


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; repeated rows give repeated rows, other columns are ignored.

    Null ids are in the fold of the empty text. Rows that share an id are told apart by their texts, in
    training too. Without any known language all rows are `und`.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = predict(rows.select("doc_id", "text"), train(rows))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
