"""Mixing sources to target weights with hash-threshold histograms (native Spark only).

Every document has a fixed 48-bit hash. A source's fractional budget is the set
of its documents whose hash lies below a threshold, so budgets are nested: a
smaller budget takes a subset of a larger one, and reruns agree. Thresholds come
from histograms of words by (source, hash bucket); only the bucket in which the
budget ends is refined, 12 bits at a time, and the documents are never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stage

BITS, LEVELS = 12, 4


def doc_hash(doc_id: Column) -> Column:
    """48 bits of the document's identity; a null id hashes as the text `null`."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size) -> adds target: weighted shares of the whole, none above cap times its source.

    The excess of capped sources is reshared by weight until none is above, which
    is water-filling: in the order of cap / weight, a source is capped as long as
    the level that the rest would get exceeds it. One row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("w", w).withColumn("limit", F.col("source_size") * cap)
    ranked = ranked.withColumn("pos", F.row_number().over(Window.orderBy(F.col("limit") / F.col("w"), "rank")))
    order = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    ranked = (
        ranked.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(order), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(order), F.lit(0)))
        .withColumn("capped", F.col("limit") * F.col("w_left") <= F.col("left") * F.col("w"))
    )
    # from the first uncapped source on, all share what is left
    first = F.min(F.when(~F.col("capped"), F.struct("pos", "left", "w_left"))).over(all_rows)
    ranked = ranked.withColumn("rest", first)
    share = (F.col("w") * F.col("rest.left")).cast("double") / F.col("rest.w_left")
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def thresholds(slim: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Per source: source_size, target, whole (times every document is taken) and below (a document
    whose hash is less is taken once more). slim: source, size, h."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, cap).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = stage(plan.withColumns({"prefix": F.lit(0).cast("long"), "under": F.lit(0).cast("long"), "upto": F.lit(0).cast("long")}), "mix-plan")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        p = plan.select(F.col("source").alias("p_source"), "prefix", "under", "need")
        in_bucket = F.col("source").eqNullSafe(F.col("p_source")) & (F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = slim.select("source", "size", "h").join(p, in_bucket).groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.first("under").alias("under"), F.first("need").alias("need"))
        upto = F.col("under") + F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("upto", upto).filter(F.col("upto") > F.col("need")).filter(F.col("upto") - F.col("size") <= F.col("need"))
        edge = hist.select(F.col("source").alias("e_source"), F.col("bucket").alias("prefix"), (F.col("upto") - F.col("size")).alias("under"), "upto")
        plan = plan.drop("prefix", "under", "upto").join(edge, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
        plan = stage(plan.fillna(0, ["prefix", "under", "upto"]), "mix-plan")
    nearer = F.col("upto") - F.col("need") < F.col("need") - F.col("under")
    return plan.select("source", "source_size", "target", "whole", (F.col("prefix") + nearer.cast("long")).alias("below"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Per document: doc_id, size (words), source_size, target, taken (words the mix takes, repeats counted).

    Null text has size 0; the null source is a source of its own, after the others.
    Documents with equal ids share a hash and are taken together. A source without
    words has target 0. An empty table gives no rows. Other columns are ignored.
    """
    slim = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("h")), "mix-docs")
    plan = thresholds(slim, weights, cap).withColumnRenamed("source", "p_source")
    copies = F.col("whole") + (F.col("h") < F.col("below")).cast("long")
    return slim.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it; same columns.

    Null texts, texts without words and documents of a source whose target is 0 have no words to take: they come
    `whole` times like the rest of their source. A null source is one of its own; rows of one id go together; an
    empty table stays empty.
    """
    slim = stage(docs.select("source", n_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("h")), "mix-docs")
    plan = stage(thresholds(slim, weights, cap).select(F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("below").alias("__below")), "mix-plan")
    copies = F.col("__whole") + (doc_hash(docs["doc_id"]) < F.col("__below")).cast("long")
    times = docs.join(plan, docs["source"].eqNullSafe(F.col("__source"))).withColumn("__copies", copies).filter("__copies > 0")
    return times.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS lim, row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY lim / w, rk) AS pos FROM w),
f AS (SELECT o.*, (SELECT sum(source_size) FROM o)::BIGINT - coalesce(sum(lim) OVER p, 0)::BIGINT AS rest,
  (SELECT sum(w) FROM o)::BIGINT - coalesce(sum(w) OVER p, 0)::BIGINT AS wrest FROM o
  WINDOW p AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, lim * wrest <= rest * w AS capped FROM f),
t AS (SELECT source, source_size, CASE WHEN capped THEN lim::DOUBLE
  ELSE (w * (SELECT arg_min(rest, pos) FROM c WHERE NOT capped))::DOUBLE / (SELECT arg_min(wrest, pos) FROM c WHERE NOT capped) END AS target FROM c),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
u AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS need,
  sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN upto <= need
  OR (upto - own <= need AND upto - need < need - (upto - own)) THEN 1 ELSE 0 END) AS taken FROM u
"""
