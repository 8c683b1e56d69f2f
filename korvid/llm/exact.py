"""Exact dedup: Misra-Gries heavy hitters leave by broadcast, the rest by an ordinary shuffle.

DataFrame functions only.  The text is read once, for its digest; everything
after works on (id, digest) pairs.  ``approx_top_k`` keeps Misra-Gries counters
(the frequent-items sketch of Anderson et al., 2017): ``TRACKED`` counters a
task, whatever the input's size, merged in two levels.  Its candidates are
counted exactly before they count as heavy, so a wrong guess costs time only.

Defined results: null text is empty text; a null id loses against any other;
of repeated rows (same id, same text) one stays; an empty table gives no rows;
columns other than id and text are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korvid.llm.common import fresh, staged

#: Counters of a sketch, and digests that may be broadcast (about 100 bytes each).
TRACKED, HEAVY = 4096, 1000
#: Sketches that meet in the last merge.
MERGERS = 64


def digest(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def heavy_hitters(slim: DataFrame, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """At most ``heavy`` rows: digest (sha), keep_id, n_at_max, n; every count exact.

    ``slim`` has doc_id and sha.
    """
    keyed = slim.withColumn("h", F.xxhash64("sha"))
    level = keyed.groupBy((F.spark_partition_id() % MERGERS).alias("m")).agg(F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("s"))
    # Grouped, as a partition without sketches must send none.
    top = level.groupBy(F.col("m") >= 0).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s")).select(F.explode(F.expr(f"approx_top_k_estimate(s, {heavy})")).alias("t"))
    guess = top.filter("t.count > 1").select(F.col("t.item").alias("h"))
    counted = keyed.join(F.broadcast(guess), "h", "left_semi").groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    # Two levels, both combined before the shuffle: a hot digest with a hot id is one row a task.
    return counted.groupBy("sha").agg(
        F.max("doc_id").alias("keep_id"),
        F.sum("c").alias("n"),
        F.coalesce(F.max_by("c", "doc_id"), F.sum("c")).alias("n_at_max"),
    ).filter("n > 1")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    slim = staged(docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("sha")), "exact-digests")
    hot = staged(heavy_hitters(slim, tracked, heavy), "exact-heavy")
    with_hot = slim.join(F.broadcast(hot), "sha", "left")

    whole = Window.partitionBy("sha")
    ranked = whole.orderBy(F.desc_nulls_last("doc_id"))
    light = with_hot.filter(F.col("n").isNull()).select(
        "doc_id",
        F.max("doc_id").over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        (F.row_number().over(ranked) == 1).alias("kept"),
        "sha",
    )
    # A heavy row is kept if it holds the largest id.  Where several rows do, they are
    # alike in all that is returned, so their rows come from the count itself.
    at_max = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    map_side = with_hot.filter(F.col("n").isNotNull() & ~(at_max & (F.col("n_at_max") > 1))).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), at_max.alias("kept"), "sha"
    )
    tied = hot.filter("n_at_max > 1").select(
        F.col("keep_id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_at_max"))).alias("k"), "sha",
    ).select("doc_id", "keep_id", "group_size", (F.col("k") == 1).alias("kept"), "sha")
    return light.unionByName(map_side).unionByName(tied).withColumnRenamed("sha", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`decisions` keeps, with all their columns.

    The smaller side, what goes, is joined back as the hashed side of a shuffled
    join, so that texts are not sorted.
    """
    h, j, k = fresh(docs, "sha", "gone_id", "gone_sha")
    dropped = staged(decisions(docs, id_col, text_col).filter("NOT kept").select("doc_id", "keep_id", "text_sha256"), "exact-dropped")
    tied = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = dropped.filter(~tied).select(F.col("doc_id").alias(j), F.col("text_sha256").alias(k))
    keyed = docs.withColumn(h, digest(text_col))
    out = keyed.join(gone.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(j)) & (F.col(h) == F.col(k)), "left_anti")
    if not dropped.filter(tied).isEmpty():  # rows that repeat both id and text: one of them stays
        out = out.dropDuplicates([id_col, h])
    return out.drop(h)
