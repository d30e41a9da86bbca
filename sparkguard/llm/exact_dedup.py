"""Exact duplicates by deterministic block naming (the doubling scheme of Karp, Miller and Rosenberg).

Every text is cut into blocks of ``block_bytes`` bytes. Level 0 gives each distinct block an integer
name by sorting; each further level names adjacent pairs of names by sorting the distinct pairs, until
one name is left for the document. Names are equal exactly when the bytes are, so (levels, name) is a
collision-free identity: no step trusts a hash. A 64-bit fingerprint only orders the blocks, and blocks
whose fingerprints tie are ordered by their bytes.

DataFrame functions only. The rows are written once with a row id, so that every later step means the same
rows. What is shuffled: the distinct blocks once (equal blocks of a task are merged before the shuffle), else
integers. A hot text costs one row per task in every naming table. The join
back to hot identities broadcasts the at most 1000 groups that hold over a thousandth of the rows;
joins on block names are inner sort-merge joins, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize, partitions

BLOCK_BYTES = 4096


def _blocks(text: Column, block_bytes: int) -> Column:
    """Fixed-size slices of the UTF-8 bytes; an empty text has one empty block."""
    raw = text.cast("binary")
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(text) / F.lit(block_bytes)).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))


def _ranked(distinct: DataFrame, keys: list[str], weight: Column, buckets: int) -> DataFrame:
    """Integer names by sort order: ``name`` = (position in the bucket's order) * buckets + bucket.

    The bucket depends on the keys alone, so a lost task computes the same names again. ``weight`` is
    how many names a row takes.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    before = Window.partitionBy("bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(weight).over(before), F.lit(0))
    return distinct.withColumn("bucket", bucket).withColumn("name", at * buckets + F.col("bucket")).withColumn("step", F.lit(buckets)).drop("bucket")


def identities(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(rid, text_sha256; rid, levels, name; tables to discard after use) of rows (rid, text) of a materialized table.

    A null text counts as empty.
    """
    buckets = max(64, 4 * partitions(rows.sparkSession))
    text = F.coalesce(F.col("text"), F.lit(""))
    blocks = _blocks(text, block_bytes)
    base = materialize(rows.select("rid", F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.transform(blocks, lambda b: F.xxhash64(b)).alias("fps")), "dedup-rows")
    # Distinct blocks by fingerprint: a count over 1 is a fingerprint that different blocks share.
    distinct = rows.select(F.explode(blocks).alias("block")).select(F.xxhash64("block").alias("fp"), "block").distinct()
    counts = materialize(distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("variants")), "dedup-fps")
    names = _ranked(counts, ["fp"], F.col("variants"), buckets)
    placed = base.select("rid", F.posexplode("fps").alias("pos", "fp"))
    level = placed.join(names, "fp")
    tied = counts.where("variants > 1").select("fp")
    if tied.isEmpty():
        level = level.select("rid", "pos", "name")
    else:
        level = _with_ties(rows.select("rid", F.posexplode(blocks).alias("pos", "block")), tied, level)
    level = materialize(level.select("rid", "pos", F.col("name").cast("long").alias("name")), "dedup-level")
    discard(counts)
    size = base.select("rid", F.size("fps").alias("n"))
    longest = size.agg(F.max("n")).first()[0] or 1
    done, levels, width, used = [], 0, 1, [base, level]
    while True:
        ended = level.join(size.where((F.col("n") <= width) & (F.col("n") > width // 2)), "rid", "left_semi")
        done.append(ended.select("rid", F.lit(levels).alias("levels"), "name"))
        if width >= longest:
            break
        going = level.join(size.where(F.col("n") > width), "rid", "left_semi")
        even = F.col("pos") % 2 == 0
        pairs = materialize(
            going.groupBy("rid", F.expr("cast(pos div 2 as int)").alias("pos")).agg(F.max(F.when(even, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r")),
            "dedup-pairs",
        )
        named = _ranked(pairs.select("l", "r").distinct(), ["l", "r"], F.lit(1), buckets)
        level = materialize(pairs.join(named, ["l", "r"]).select("rid", "pos", F.col("name").cast("long").alias("name")), "dedup-level")
        discard(pairs)
        used.append(level)
        levels, width = levels + 1, width * 2
    ids = done[0]
    for more in done[1:]:
        ids = ids.unionByName(more)
    return base.select("rid", "text_sha256"), ids, used


def _with_ties(blocks: DataFrame, tied: DataFrame, level: DataFrame) -> DataFrame:
    """Blocks (rid, pos, block) of tied fingerprints get consecutive names in the order of their bytes.

    Runs only when 64-bit fingerprints of different blocks meet.
    """
    mine = blocks.withColumn("fp", F.xxhash64("block")).join(tied, "fp", "left_semi")
    order = mine.select("fp", "block").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("fp").orderBy("block")) - 1)
    ranks = mine.join(order, ["fp", "block"]).select("rid", "pos", "rank")
    return level.join(ranks, ["rid", "pos"], "left").withColumn("name", F.col("name") + F.coalesce(F.col("rank"), F.lit(0)) * F.col("step"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id
    stays. A null id never wins against another; a group of null ids alone keeps them. Rows repeated
    with the same id and text are one document twice: they share one flag and both count in
    ``group_size``. Other columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("rid", F.monotonically_increasing_id()), "dedup-base")
    shas, ids, used = identities(rows.select("rid", "text"), block_bytes)
    ids = materialize(ids.join(shas, "rid").join(rows.select("rid", "doc_id"), "rid"), "dedup-ids")
    groups = ids.groupBy("levels", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    for df in (rows, *used):
        discard(df)
    return join_hot(ids, groups, ["levels", "name"], "group_size", ids.count()).select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text, with all their columns: the largest id, null ids last."""
    rows = materialize(docs.select(F.struct(*docs.columns).alias("row")).withColumn("rid", F.monotonically_increasing_id()), "dedup-base")
    _, ids, used = identities(rows.select("rid", F.col("row")[text_col].alias("text")), block_bytes)
    ids = materialize(ids.join(rows.select("rid", F.col("row")[id_col].alias("doc_id")), "rid"), "dedup-ids")
    for df in used:
        discard(df)
    lead = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "rid"))["rid"].alias("keep_rid")
    groups = ids.groupBy("levels", "name").agg(lead, F.count(F.lit(1)).alias("group_size"))
    # A text that occurs once drops nothing, so only groups are joined back.
    gone = join_hot(ids, groups.where("group_size > 1"), ["levels", "name"], "group_size", ids.count()).where("rid <> keep_rid").select("rid")
    return rows.join(gone, "rid", "left_anti").select("row.*")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
