"""Count sets over the driver's star schema and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import CountSet, Family
from ..store import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_by_supplier(spark: SparkSession, sf_dir: str) -> CountSet:
    """Genes are parts, cells suppliers, values summed quantities."""
    t = lambda n: table(spark, sf_dir, n)
    expr = t("lineitem").groupBy(F.col("l_partkey").alias("gene_id"), F.col("l_suppkey").alias("cell_id")).agg(F.sum("l_quantity").alias("value"))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = t("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    cells = cells.select(F.col("s_suppkey").alias("cell_id"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("s_acctbal").alias("acctbal"))
    return CountSet(expr, cells, parts(spark, sf_dir))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene_short_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size")
    )


def parts_by_order(spark: SparkSession, sf_dir: str) -> CountSet:
    """Genes are parts, cells orders: very sparse."""
    lines = table(spark, sf_dir, "lineitem")
    expr = lines.groupBy(F.col("l_partkey").alias("gene_id"), F.col("l_orderkey").alias("cell_id")).agg(F.sum("l_quantity").alias("value"))
    cells = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cell_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("totalprice")
    )
    return CountSet(expr, cells, parts(spark, sf_dir))


def tokens_by_document(spark: SparkSession, sf_dir: str, least: int = 1) -> CountSet:
    """Genes are lower-case words (letters of any script) that at least ``least`` documents have, cells documents with their labels.

    Texts are split once: the counts are a stored table, which genes and entries are read from.
    """
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.col("doc_id").alias("cell_id"), F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("gene_id")).where("gene_id <> ''")
    expr = cut(words.groupBy("gene_id", "cell_id").agg(F.count("*").cast("double").alias("value")))
    genes = expr.groupBy("gene_id").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)
    if least > 1:
        expr = expr.join(genes.select("gene_id"), "gene_id", "left_semi")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "cell_id")
    cells = docs.select(F.col("doc_id").alias("cell_id"), "lang", "source").join(labels, "cell_id", "left")
    return CountSet(expr, cells, genes, Family.BINOMIAL)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, label): embeddings in double precision."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations along pseudotime (0 to 100) on two branches (parity of the user)."""
    ev = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    span = ev.agg(F.min(seconds).alias("lo"), F.max(seconds).alias("hi"))
    return ev.crossJoin(F.broadcast(span)).select(  # one row
        F.col("event_type").alias("gene_id"), F.col("event_id").alias("cell_id"), "value",
        (100 * (seconds - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("pseudotime"), (F.col("user_id") % 2).alias("branch"),
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (parent, child, weight) of a binary tree over the parts, by rank of their keys."""
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"), F.col("p_size").cast("double").alias("weight"))
    return keys.where("child > 1").select(F.floor(F.col("child") / 2).alias("parent"), "child", "weight")
