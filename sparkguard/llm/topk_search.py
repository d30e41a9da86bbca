"""Exact top-k inner products: vectors in order of length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Candidates are cut into stripes by falling length over the whole table, and each stripe into blocks, again by
falling length. They are rotated by the right singular vectors of the table (from its summed Gram matrix), so
the first coordinates carry most of every product. The longest candidates of all are sent to every query first:
its k-th best score among them is a floor. A stripe or block whose longest vector gives |query| * |candidate|
under the floor is skipped, a stripe before its rows are shuffled to that query. In a block, products are
summed coordinate step by coordinate step, and a candidate goes on only while

    partial product + |rest of query| * |rest of candidate| >= floor.

Survivors get their exact integer product, and the floor rises with the k-th best score found.

A task takes one query block and the blocks of one stripe and keeps k rows per query, so what is shuffled is
the blocks of the pairs (query block, stripe) that bounds leave, as 16- or 32-bit integers where they fit, and
k rows per query and stripe. Both blocks are bounded in rows and bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, partitions

SCALE = 256
#: Rows of a query block, of a candidate block and of a stripe; and the most bytes of any of them, as doubles.
QUERY_BLOCK, CANDIDATE_BLOCK, STRIPE, BLOCK_BYTES = 4096, 1024, 16_384, 32 << 20
#: The longest candidates that give the first floors: rows and bytes.
HEAD, HEAD_BYTES = 2048, 8 << 20
#: Where partial sums are tested, as shares of the coordinates.
STEPS = (1 / 4, 1 / 2, 3 / 4, 7 / 8)
#: The most norm ranges of a table; a fuller one is dealt over several stripes.
RANGES = 4096
#: How many vector lengths, the most frequent ones, are rotated and cut by norm, and up to which length.
ROTATED, ROTATED_LENGTH = 8, 2048
#: Under this all sums of integer products are exact in doubles, under the next in wrapping 64-bit integers.
EXACT_DOUBLE, EXACT_LONG = 2.0**52, 2.0**62
LONG = np.iinfo(np.int64)


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v = floor(scale * x), d = its length; vectors that are null, empty or hold null, NaN or infinity are left out."""
    x = F.transform(vector_col, lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fine)

    def whole(e):
        # Doubles of 2**52 and more are whole already; a product beyond doubles counts as the largest of them.
        y = F.least(F.greatest(e * scale, F.lit(-np.finfo(float).max.item())), F.lit(np.finfo(float).max.item()))
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v")).withColumn("d", F.size("v"))


def _with_norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("v")
        flat, starts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        most = np.maximum(np.maximum.reduceat(np.abs(flat), starts), 1e-300)  # no list is empty
        parts = (flat / np.repeat(most, np.diff(np.append(starts, len(flat))))) ** 2
        with np.errstate(over="ignore"):
            norm = most * np.sqrt(np.add.reduceat(parts, starts))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm)], [*batch.schema.names, "norm"])


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            m = _matrix(batch.column("v"))
            m = m / max(1.0, float(np.abs(m).max()))  # only directions matter, and squares must stay finite
            total = m.T @ m if total is None else total + m.T @ m
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["row", "sums"])


def _summed(rows: pa.Table) -> pa.Table:
    total = _matrix(rows.column("sums")).sum(axis=0)
    return pa.table({"row": rows.column("row").slice(0, 1), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})


def rotation(rows: DataFrame) -> np.ndarray:
    """Right singular vectors of the table, by falling singular value; d arrays of d numbers reach the driver."""
    kind = "row int, sums array<double>"
    found = rows.select("v").mapInArrow(_gram, kind).groupBy("row").applyInArrow(_summed, kind).collect()
    gram = np.array([r["sums"] for r in sorted(found, key=lambda r: r["row"])])
    return np.linalg.eigh(gram)[1][:, ::-1]


def _small(v: np.ndarray) -> tuple[int, bytes]:
    """(bytes of a number, data) in the narrowest of 16-bit, 32-bit and double that holds all numbers."""
    most = float(np.abs(v).max()) if v.size else 0
    for size, kind in ((2, "<i2"), (4, "<i4")):
        if most < 2.0 ** (8 * size - 1):
            return size, v.astype(kind).tobytes()
    return 8, v.astype("<f8").tobytes()


def _large(size: int, data: bytes, d: int) -> np.ndarray:
    return np.frombuffer(data, {2: "<i2", 4: "<i4", 8: "<f8"}[size]).reshape(-1, d).astype(float)


def _norms(v: np.ndarray) -> np.ndarray:
    most = np.maximum(np.abs(v).max(axis=1), 1e-300)
    with np.errstate(over="ignore"):
        return most * np.sqrt(((v / most[:, None]) ** 2).sum(axis=1))


def _products(q: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray, reach: float) -> np.ndarray:
    """Exact integer products of the pairs; what a long cannot hold counts as the nearest long."""
    out = np.zeros(len(row), np.int64)
    if not reach < EXACT_LONG:
        whole_q, whole_v = ({i: [int(x) for x in m[i]] for i in np.unique(which).tolist()} for m, which in ((q, row), (v, col)))
        for at, (i, j) in enumerate(zip(row.tolist(), col.tolist(), strict=True)):
            out[at] = min(LONG.max, max(LONG.min, sum(x * y for x, y in zip(whole_q[i], whole_v[j], strict=True))))
        return out
    kind = float if reach < EXACT_DOUBLE else np.int64  # integers that wrap on the way are right in the end
    for at in range(0, len(row), 1 << 16):
        i, j = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
        out[at : at + len(i)] = (q[i].astype(kind) * v[j].astype(kind)).sum(axis=1)
    return out


def block_top_k(q: np.ndarray, q_rids: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], basis: np.ndarray | None, k: int, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row ids, ids, scores) of the k best candidates of each query over ``blocks`` (row ids, ids, vectors).

    Row id -1 where there are fewer; a query's own row is no candidate. ``floor``: scores that k candidates
    are known to reach. Queries and candidates hold integers, bounds are loosened by more than what doubles
    round. ``tally`` gains how many products there are and how many were computed in full.
    """
    d = q.shape[1]
    rotated = q if basis is None else q @ basis
    norms, floor = _norms(q), floor.astype(float).copy()
    best, best_ids, best_rids = np.full((len(q), k), LONG.min), np.full((len(q), k), -1, np.int64), np.full((len(q), k), -1, np.int64)
    steps = sorted({int(d * s) for s in STEPS} - {0, d})
    lengths = [_norms(v) for _, _, v in blocks]
    largest = [float(x.max()) for x in lengths]
    for b in np.argsort(largest)[::-1]:
        rids, ids, v = blocks[b]
        with np.errstate(over="ignore"):
            reach = norms * largest[b]
        slack = 1e-6 * (1 + reach)
        live = np.flatnonzero(~(reach + slack < floor))
        if tally is not None:
            tally[0] += len(q) * len(ids)
        if not len(live):
            continue
        cut = (floor - slack)[live]
        row = col = None
        most = float(reach[live].max())
        if steps and np.isfinite(cut).any() and np.isfinite(4 * most) and most * most < 1e300:
            w = v if basis is None else v @ basis
            mine, done = rotated[live], 0
            partial = np.zeros((len(live), len(ids)))
            for s in steps:
                q_rest, v_rest = (np.sqrt((x[:, s:] ** 2).sum(axis=1)) for x in (mine, w))
                if row is None:
                    partial += mine[:, done:s] @ w[:, done:s].T
                    alive = partial + np.outer(q_rest, v_rest) >= cut[:, None]
                    if np.count_nonzero(alive) * 8 < alive.size:
                        row, col = np.nonzero(alive)
                        partial = partial[row, col]
                else:
                    partial = partial + (mine[row, done:s] * w[col, done:s]).sum(axis=1)
                    held = partial + q_rest[row] * v_rest[col] >= cut[row]
                    row, col, partial = row[held], col[held], partial[held]
                done = s
            if row is None:
                row, col = np.nonzero(alive)
        if row is None:
            row, col = np.divmod(np.arange(len(live) * len(ids)), len(ids))
        if tally is not None:
            tally[1] += len(row)
        if most < EXACT_DOUBLE and len(row) * 4 > len(live) * len(ids):
            score = (q[live] @ v.T)[row, col].astype(np.int64)
        else:
            score = _products(q[live], v, row, col, most)
        fine = (score >= cut[row]) & (q_rids[live[row]] != rids[col])
        row, col, score = row[fine], col[fine], score[fine]
        edges = np.searchsorted(row, np.arange(len(live) + 1))  # pairs come row by row
        for r in np.flatnonzero(np.diff(edges)).tolist():
            mine, at = slice(edges[r], edges[r + 1]), live[r]
            s, c = score[mine], col[mine]
            if len(s) > 4 * k:
                high = s >= np.partition(s, -k)[-k]
                s, c = s[high], c[high]
            s, i, x = np.concatenate([best[at], s]), np.concatenate([best_ids[at], ids[c]]), np.concatenate([best_rids[at], rids[c]])
            order = np.lexsort((x, i, ~s, x < 0))[:k]  # ~s falls as s rises, without overflow
            best[at], best_ids[at], best_rids[at] = s[order], i[order], x[order]
            if best_rids[at, -1] >= 0:
                floor[at] = max(floor[at], float(best[at, -1]))
    return best_rids, best_ids, best


def _ranges(bounds: np.ndarray):
    """Adds ``at``: which norm range a row is in, 0 being the longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = len(bounds) - np.searchsorted(bounds, batch.column("norm").to_numpy(zero_copy_only=False), "left")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])

    return run


def _candidates(rows: pa.Table) -> pa.Table:
    """A stripe as blocks, longest first."""
    v, rids, ids = _matrix(rows.column("v")), rows.column("rid").to_numpy(), rows.column("vec_id").to_numpy()
    size = max(1, min(CANDIDATE_BLOCK, BLOCK_BYTES // (8 * v.shape[1])))
    order = np.lexsort((rids, -_norms(v)))
    cuts = [order[a : a + size] for a in range(0, len(order), size)]
    small = [_small(v[c]) for c in cuts]
    key = [pa.array([rows.column(n)[0].as_py()] * len(cuts), pa.int64()) for n in ("d", "stripe")]
    data = [pa.array([x[c].astype("<i8").tobytes() for c in cuts], pa.binary()) for x in (rids, ids)]
    return pa.table([*key, *data, pa.array([s for s, _ in small], pa.int32()), pa.array([x for _, x in small], pa.binary())], ["d", "stripe", "rids", "ids", "width", "data"])


def _queries(head: tuple[np.ndarray, np.ndarray, np.ndarray], basis: np.ndarray | None, longest: np.ndarray, k: int):
    """Query blocks for each stripe that the floors among the longest candidates leave to some of their rows."""

    def run(rows: pa.Table) -> pa.Table:
        v, rids, ids = _matrix(rows.column("v")), rows.column("rid").to_numpy(), rows.column("vec_id").to_numpy()
        floor = np.full(len(v), -np.inf)
        for at in range(0, len(v) if len(head[0]) else 0, 512):
            part = slice(at, at + 512)
            found, _, scores = block_top_k(v[part], rids[part], floor[part], [head], basis, k)
            floor[part] = np.where(found[:, -1] >= 0, scores[:, -1].astype(float), -np.inf)
        norms = _norms(v)
        out = []
        for stripe, most in enumerate(longest):
            with np.errstate(over="ignore", invalid="ignore"):
                reach = norms * most
                mine = np.flatnonzero(~(reach + 1e-6 * (1 + reach) < floor))
            if len(mine):
                out.append((stripe, mine, *_small(v[mine])))
        key = [pa.array([rows.column(n)[0].as_py()] * len(out), pa.int64()) for n in ("d", "q_group")]
        data = [pa.array([x[c].astype(t).tobytes() for _, c, _, _ in out], pa.binary()) for x, t in ((rids, "<i8"), (ids, "<i8"), (floor, "<f8"))]
        columns = [*key, pa.array([o[0] for o in out], pa.int64()), *data, pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.binary())]
        return pa.table(columns, ["d", "q_group", "stripe", "q_rids", "q_ids", "floor", "width", "data"])

    return run


#: What a cell gives: results, or how many products there were and how many were computed in full.
_FOUND, _TALLY = "q_rid long, query_id long, rid long, vec_id long, score long", "products long, computed long"


def _cell(basis: np.ndarray | None, k: int, count: bool):
    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        d = key[0].as_py()
        long = lambda b: np.frombuffer(b, "<i8")
        blocks = [(long(r["rids"]), long(r["ids"]), _large(r["width"], r["data"], d)) for r in candidates.to_pylist()]
        out, tally = [[np.zeros(0, np.int64)] for _ in range(5)], [0, 0]
        for r in queries.to_pylist() if blocks else []:
            q_rids, q_ids, floor, q = long(r["q_rids"]), long(r["q_ids"]), np.frombuffer(r["floor"], "<f8"), _large(r["width"], r["data"], d)
            for at in range(0, len(q), 512):
                part = slice(at, at + 512)
                rids, ids, scores = block_top_k(q[part], q_rids[part], floor[part], blocks, basis, k, tally)
                fine = rids.ravel() >= 0
                for held, x in zip(out, (np.repeat(q_rids[part], k), np.repeat(q_ids[part], k), rids.ravel(), ids.ravel(), scores.ravel()), strict=True):
                    held.append(x[fine])
        if count:
            return pa.table({"products": tally[:1], "computed": tally[1:]})
        return pa.table(dict(zip(["q_rid", "query_id", "rid", "vec_id", "score"], (pa.array(np.concatenate(x)) for x in out), strict=True)))

    return run


def _cells(rows: DataFrame, n: int, d: int, rotated: bool, k: int, every: int, count: bool) -> DataFrame:
    """Results of all cells of rows of length ``d``; if not ``rotated``, of lengths up to ``d``, each for itself."""
    spark = rows.sparkSession
    bound = lambda most: max(1, min(most, BLOCK_BYTES // (8 * d)))
    stripes = max(1, n // bound(STRIPE), min(n // 512, 2 * partitions(spark)))
    basis, head, bounds = None, (np.zeros(0, np.int64),) * 3, np.zeros(0)
    if rotated:
        basis = rotation(rows)
        few = max(16 * k, min(HEAD, HEAD_BYTES // (8 * d)))
        top = rows.orderBy(F.desc("norm"), "rid").limit(few).select("rid", "vec_id", "v").collect()
        head = tuple(np.array([r[c] for r in top]) for c in ("rid", "vec_id", "v"))
        ranges = min(stripes, RANGES)
        cuts = rows.agg(F.percentile_approx("norm", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
        bounds = np.unique(np.array(cuts, float))
    kind = "d int, rid long, vec_id long, v array<double>, norm double, at long"
    placed = rows.select("d", "rid", "vec_id", "v", "norm").mapInArrow(_ranges(bounds), kind)
    # A bounded number of norm ranges; one that holds more than its share is dealt over several stripes.
    stats = {r["at"]: r for r in rows.select("norm").mapInArrow(_ranges(bounds), "norm double, at long").groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).collect()}
    held = [stats[i] for i in sorted(stats)]
    dealt = [max(1, round(r["n"] * stripes / n)) for r in held]
    first = np.cumsum([0, *dealt]).tolist()
    longest = np.repeat([r["most"] for r in held], dealt)
    plan = spark.createDataFrame([(r["at"], f, m) for r, f, m in zip(held, first, dealt, strict=False)], "at long, first long, dealt long")
    salt = F.pmod(F.xxhash64("rid"), F.col("dealt"))
    striped = placed.join(F.broadcast(plan), "at").select("d", "rid", "vec_id", "v", (F.col("first") + salt).alias("stripe"))
    cands = striped.groupBy("d", "stripe").applyInArrow(_candidates, "d long, stripe long, rids binary, ids binary, width int, data binary")
    asked = rows.where(F.col("vec_id") % every == 0)
    groups = max(1, -(-asked.count() // bound(QUERY_BLOCK)))
    dealt_queries = asked.select("d", "rid", "vec_id", "v").withColumn("q_group", F.pmod(F.xxhash64("rid", F.lit("query")), F.lit(groups)))
    kind = "d long, q_group long, stripe long, q_rids binary, q_ids binary, floor binary, width int, data binary"
    queries = materialize(dealt_queries.groupBy("d", "q_group").applyInArrow(_queries(head, basis, longest, k), kind), "topk-queries")
    wanted = queries.select(*[F.col(c).alias(c) for c in ("d", "q_group", "stripe")])
    pairs = queries.groupBy("d", "q_group", "stripe").cogroup(cands.join(wanted, ["d", "stripe"]).groupBy("d", "q_group", "stripe"))
    return pairs.applyInArrow(_cell(basis, k, count), _TALLY if count else _FOUND)


def _rows(vectors: DataFrame) -> DataFrame:
    whole = quantized(vectors).withColumn("rid", F.monotonically_increasing_id())
    return materialize(whole.mapInArrow(_with_norms, "vec_id long, v array<double>, d int, rid long, norm double"), "topk-rows")


def _spaces(rows: DataFrame, k: int, every: int, count: bool) -> list[DataFrame]:
    """Cells of the most frequent vector lengths, each for itself, and of all other lengths together."""
    sizes = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(ROTATED).collect()
    main = [r for r in sizes if r["d"] <= ROTATED_LENGTH]
    out = [_cells(rows.where(F.col("d") == r["d"]), r["n"], r["d"], True, k, every, count) for r in main]
    rest = rows.where(~F.col("d").isin([r["d"] for r in main]))
    n, d = rest.agg(F.count(F.lit(1)), F.max("d")).first()
    return [*out, _cells(rest, n, d, False, k, every, count)] if n else out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the query's
    own. Fewer than k candidates give all. Rows repeated with one vec_id are rows like others: each is a
    candidate, and each query row has k ranks of its own. Vectors of different lengths have no product, so
    each length is searched for itself. A product that a long cannot hold counts as the nearest long. Null
    ids and vectors that are null, empty or hold null, NaN or infinity take no part. Other columns are
    ignored. An empty table gives an empty result.
    """
    spaces = _spaces(_rows(vectors), k, every, False)
    if not spaces:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spaces[0]
    for more in spaces[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "rid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruning(vectors: DataFrame, k: int = 5, every: int = 50) -> tuple[int, int]:
    """(products of queries and the candidates of the stripes left to them, those of them computed in full)."""
    rows = _rows(vectors)
    spaces = _spaces(rows, k, every, True)
    sums = [df.agg(F.sum("products"), F.sum("computed")).first() for df in spaces]
    discard(rows)
    return sum(s[0] or 0 for s in sums), sum(s[1] or 0 for s in sums)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
WHERE rank <= 5
"""
