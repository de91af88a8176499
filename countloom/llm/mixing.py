"""Mixing sources to target weights by Efraimidis-Spirakis sampling (native: DataFrame functions only).

Each document gets the exponential key ``-ln(u) / weight`` (u from a hash of its id, so reruns agree; weight: its quality
weight).  Ascending keys are a weighted sample without replacement; within a source they are summed up to the token budget.
Complete epochs of a source come first: a target of 2.3 times a source's size takes every document twice and then the
sampled prefix that is nearest to the remaining 0.3.

No source is gathered in one task: a source's keys are cut into buckets of a bounded expected number of rows by a
monotone map of the key, buckets are summed before any shuffle of documents, and only within a bucket does a window run.

Defined results: null or empty texts have size 0 and are never taken; a null source is a source of its own (last); a row
without an id is keyed by its text; repeated rows are told apart by key, id and text hash (full ties share a place in the
order, which does not change any sum's result set); an empty table gives an empty result; extra columns are ignored by
``plan`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, cut, let, read, unit

#: A source is repeated at most so often.
MOST = 3
#: Expected rows of one bucket of keys.
BUCKET_ROWS = 2000
#: Up to so many sources the table of sources (a few dozen bytes a row) is broadcast.
BROADCAST_SOURCES = 20_000


def size_of(text: Column) -> Column:
    """Words of the text: pieces between white space, without the empty ones at either end."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    ends = lambda p: (p[0] == "").cast("int") + ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int")
    return let(parts, lambda p: F.size(p) - ends(p)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.5 (a symbol a word or more) and 1 (none)."""
    symbols = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^#*$%&|<>]+", ""))
    return 1 - 0.5 * F.least(F.lit(1.0), symbols / F.greatest(size, F.lit(1)))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size, n_rows) with rank, weight and target (double).

    Weights 1, 2, 3 repeat over the sources in code point order, null last.  Shares above ``most`` times the source's
    size are cut there and the excess shared again by weight: in order of size / weight, the sources that are cut are
    a prefix, so two running sums find the level at which none is above.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.orderBy("ratio", "source_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("ratio", "source_id").rowsBetween(W.unboundedPreceding, -1)
    out = sources.withColumn("source_id", F.row_number().over(order)).withColumn("weight", ((F.col("source_id") - 1) % 3 + 1).cast("long"))
    out = out.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    out = out.withColumns(
        {
            "cut_before": F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)),
            "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "all_size": F.sum("source_size").over(everything),
            "all_weight": F.sum("weight").over(everything),
        }
    )
    out = out.withColumn("level", (F.col("all_size") - F.col("cut_before")) / (F.col("all_weight") - F.col("weight_before")))
    # the first source whose own level it can bear fixes the level for all that follow
    bears = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_id", "level"))).over(everything)
    out = out.withColumn("at", bears)
    uncut = F.col("at").isNotNull() & (F.struct("ratio", "source_id") >= F.struct(F.col("at.ratio"), F.col("at.source_id")))
    out = out.withColumn("target", F.when(uncut, F.col("at.level") * F.col("weight")).otherwise((most * F.col("source_size")).cast("double")))
    return out.select("source", "source_id", "source_size", "n_rows", "weight", "target")


def plan(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs`` (doc_id, source, text)."""
    text = F.col("text")
    keyed = docs.select("doc_id", "source", text, size_of(text).alias("size"))
    keyed = keyed.select(
        "doc_id", "source", "size", F.xxhash64("text").alias("tie"),
        (-F.ln(unit(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))) / quality_weight(text, F.col("size"))).alias("key"),
    )
    keyed = cut(keyed, "keyed")  # texts are read once
    sources = cut(targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), most), "sources")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    same = keyed["source"].eqNullSafe(sources["source"])
    rows = keyed.join(sources, same).drop(sources["source"])
    # 1 - exp(-0.75 key) is near uniform for the weights above and rises with the key
    buckets = F.ceil(F.col("n_rows") / BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.floor(buckets * (1 - F.exp(-0.75 * F.col("key")))))
    sums = rows.groupBy("source_id", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = W.partitionBy("source_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("earlier", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")
    within = W.partitionBy("source_id", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(within)).join(sums, ["source_id", "bucket"])
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - full * F.col("source_size")
    nearer = F.col("earlier") + F.col("upto") - F.col("size") / 2 <= rest
    copies = F.when(F.col("size") > 0, full + nearer.cast("long")).otherwise(0)
    copies = F.least(copies, F.lit(most)).cast("long")
    return rows.select("doc_id", "source", "size", "tie", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The mixed corpus: rows of ``docs`` with all their columns, each as often as the mix takes it."""
    taken = plan(docs, most).groupBy("doc_id", "source", "tie").agg(F.sum("copies").alias("n"), F.count("*").alias("rows"))
    taken = cut(taken.where("n > 0"), "taken")
    # the document is one column here, so its own columns may have any names
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.xxhash64("text").alias("text_tie"))
    on = left["document.doc_id"].eqNullSafe(taken["doc_id"]) & left["document.source"].eqNullSafe(taken["source"]) & (left["text_tie"] == taken["tie"])
    # about as many rows as documents: always a shuffle, so the plan is the same at every size
    joined = left.join(taken.hint("merge"), on)
    each = F.col("n")
    if not taken.where("rows > 1").isEmpty():  # fully equal rows share their copies
        turn = F.row_number().over(W.partitionBy("doc_id", "source", "tie").orderBy(F.lit(1)))
        each = F.floor(F.col("n") / F.col("rows")) + (turn <= F.col("n") % F.col("rows")).cast("long")
    joined = joined.withColumn("each", each).where("each > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("each"))))
    return joined.select("document.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(t))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE)
         / (1 - 0.5 * least(1.0, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::DOUBLE / greatest(size, 1))) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source
), s1 AS (
  SELECT *, (sid - 1) % 3 + 1 AS weight, 3 * source_size::DOUBLE / ((sid - 1) % 3 + 1) AS ratio FROM s
), s2 AS (
  SELECT *, coalesce(sum(3 * source_size) OVER b, 0) AS cut_before, coalesce(sum(weight) OVER b, 0) AS weight_before,
         sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
  FROM s1 WINDOW b AS (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT *, (all_size - cut_before)::DOUBLE / (all_weight - weight_before)::DOUBLE AS level, row_number() OVER (ORDER BY ratio, sid) AS place FROM s2
), s4 AS (
  SELECT *, min(CASE WHEN level <= ratio THEN place END) OVER () AS edge FROM s3
), s5 AS (
  SELECT source, source_size, CASE WHEN place >= edge THEN (SELECT x.level FROM s4 x WHERE x.place = x.edge) * weight ELSE 3.0::DOUBLE * source_size END AS target FROM s4
), r AS (
  SELECT k.doc_id, k.size, s5.source_size, s5.target, sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id ROWS UNBOUNDED PRECEDING) AS upto,
         CASE WHEN s5.source_size > 0 THEN floor(s5.target / s5.source_size) ELSE 0 END AS full_epochs
  FROM k JOIN s5 ON k.source IS NOT DISTINCT FROM s5.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (CASE WHEN size > 0 THEN size * least(3, full_epochs + (upto - size / 2 <= target - full_epochs * source_size)::INT) ELSE 0 END)::BIGINT AS taken
FROM r
"""
