"""From raw documents to packed sequences, in stages that each read what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm import mixing, ngram_join, packing, quality, rules
from countloom.llm.common import cut, read

#: Up to so many ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Words whose ids a worker of the last stage remembers: less than by default, as the workers still hold memory of earlier stages.
REMEMBERED = 300_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the policy, with all their columns (also ones that are named like a measurement).

    A null, empty or wordless text has too few words and goes; a very long one is measured whole; repeated rows are judged alike, each for
    itself; an empty table stays empty.
    """
    return rules.keep(docs, "web-1")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that likely are of good quality; the model learns from the labels of the whole table.

    A null or empty text has the score of no difference; equal texts are judged alike; without labels of both kinds all documents stay
    (their score is 0.5); an empty table stays empty; all columns are kept.
    """
    model = quality.fit(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def _few(ids: DataFrame) -> DataFrame:
    """``ids``, broadcast where they are few: then no text is moved."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _keyed(docs: DataFrame) -> DataFrame:
    """(document, text, doc_id, key): each row as one column beside a key of its id and text, which no two different pairs of them share."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), "doc_id", "text")
    salt = 0
    while True:
        key = F.xxhash64(F.lit(salt), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
        keyed = whole.withColumn("key", key)
        pairs = keyed.select("key", "doc_id", F.md5("text").alias("text")).distinct()
        if pairs.groupBy("key").count().where("count > 1").isEmpty():
            return keyed
        salt += 1


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id, with all its columns.

    Every row is a document of its own: where ids are null or repeated, rows are told apart by id and text, so two rows with one id
    and unlinked texts both stay, and rows without an id leave only for a text that theirs is linked with.  Of rows equal in id and
    text one stays.  Null, empty and wordless texts are linked with nothing and all stay; an empty table stays empty.
    """
    repeated = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if repeated.isEmpty():
        found = cut(ngram_join.join(docs), "near_duplicates")
        leaving = found.where("doc_id <> component_id").select("doc_id")
        return docs.join(_few(leaving), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = _keyed(docs)
    found = ngram_join.join(keyed.select(F.col("key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "key")
    found = found.groupBy("key", "component_id").agg(F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    found = cut(found.join(keyed.select("key", "doc_id").distinct(), "key"), "near_duplicates")
    least = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("least"))
    leaving = found.join(least, "component_id").where(F.col("key") != F.col("least.key")).select("key")
    staying = keyed.join(_few(leaving), "key", "left_anti")
    equal = _few(found.where("rows > 1 and n > 0").select("key"))
    once = staying.join(equal, "key", "left_semi").groupBy("key").agg(F.min_by("document", F.xxhash64(F.to_json("document"))).alias("document"))
    return staying.join(equal, "key", "left_anti").select("document.*").unionByName(once.select("document.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, with all their columns.

    A text without words has no size and is not taken; a null source is a source; a row without an id is keyed by its text; fully equal
    rows share their copies; an empty table stays empty.
    """
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences.

    A null or empty text is the end id alone; very long texts become many pieces; each copy of a document is packed for itself (its
    pieces may go to different sequences); an empty table gives no pieces; columns but the id are not carried on.  Workers forget their
    words at the end of a task, as they live on beside stages that need the memory.
    """
    return packing.pack_documents(docs, remembered=REMEMBERED, forget=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: Compression and tokenization have no SQL; tests hold the pipeline against a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage_{k + 1}")
    return docs
