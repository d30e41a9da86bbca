"""What the operators of this subpackage share: tables, the shared folder, deterministic draws."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the package is sent to the workers, whose tasks will import it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    A session in one JVM (tests) that has none gets a temporary folder once; on a cluster, where no local
    folder is shared, its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkguard-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables materialized inside are removed at its end, but for those that are to be kept."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for df in _SCOPES.pop():
            discard(df)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts lineage, keeps row ids stable and lets later jobs start from replicated files when
    an executor is lost. The table stays until ``discard`` or the end of an enclosing ``scratch``; what a
    returned plan still reads is its caller's to clear with the folder.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.__dict__["shared_path"] = path
    if _SCOPES and not keep:
        _SCOPES[-1].append(back)
    return back


def discard(df: DataFrame | None) -> None:
    """Remove a materialized table that no later plan reads."""
    path = getattr(df, "shared_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which its worker gives freed memory back to the system: workers wait for later tasks and would keep it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as decimal text, modulo ``folds``; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def drawn(rows: DataFrame, by: str, share: Column, cost: Column, most: int) -> DataFrame:
    """Of each value of ``by`` the first ``share`` rows by (draw, doc_id, text_hash) while their cost is at most ``most``.

    At least one row of each value stays. The order does not depend on partitions, so a retried task or a
    later run draws the same rows. ``rows`` are few: what a hash threshold let through.
    """
    order = Window.partitionBy(by).orderBy("draw", "doc_id", "text_hash")
    so_far = F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumns({"place": F.row_number().over(order), "so_far": so_far})
    return placed.where((F.col("place") == 1) | ((F.col("place") <= share) & (F.col("so_far") <= most))).drop("place", "so_far")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, total: int, hot_keys: int = 1000) -> DataFrame:
    """Inner join with a table of one row per key, where some keys may hold a large share of ``rows``.

    ``weight`` is how many rows a key has. At most ``hot_keys`` keys hold more than total / hot_keys rows
    each, so those are broadcast; all others are shuffled.
    """
    limit = max(1, total // hot_keys)
    hot, rest = side.where(F.col(weight) > limit), side.where(F.col(weight) <= limit)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))
