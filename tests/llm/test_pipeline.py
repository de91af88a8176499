"""The pipeline's stages against plain versions of each, on the smallest tables."""

import hashlib
import math
import os
import subprocess
import sys
from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from countloom.llm import mixing, packing, quality
from countloom.llm.common import cut, read
from test_llm_operators import SMALL, brute_join, brute_rules, brute_targets, check_slots, table

def plain_rules(docs):
    out = []
    for r in docs:
        n, chars, symbols, dup, repeat = brute_rules(r["text"])
        lines = sum(1 for x in (r["text"] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r"))
        upper = sum(1 for c in r["text"] or "" if c.isupper())
        marks = sum((r["text"] or "").count(c) for c in "!?")
        bad = n < 20 or 100 * repeat > 30 * n or 4 * symbols > n or 2 * dup > lines or chars > 30 * n or chars < 2 * n or 2 * upper > chars or 3 * marks > n
        out += [] if bad else [r]
    return out

def plain_mix(docs):
    sizes, rows = Counter(), []
    for r in docs:
        n = len((r["text"] or "").split())
        sizes[r["source"]] += n
        symbols = sum((r["text"] or "").count(c) for c in "#*$%&|<>")
        u = (int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rows.append((r["source"], -math.log(u) / (1 - 0.5 * min(1.0, symbols / max(n, 1))), r["doc_id"], n))
    target, upto, out = brute_targets(dict(sizes)), Counter(), Counter()
    for source, _, i, n in sorted(rows):
        full = math.floor(target[source] / sizes[source] + 1e-12) if sizes[source] else 0
        upto[source] += n
        copies = full + (upto[source] - n / 2 <= target[source] - full * sizes[source])
        if n and copies:
            out[i] = min(3, copies)
    return out

def test_stages(spark):
    docs = read(spark, SMALL, "documents")
    columns, kept = docs.columns, [r.asDict() for r in docs.collect()]
    model = quality.fit(read(spark, SMALL, "documents", "doc_id", "text"), read(spark, SMALL, "labels"))
    of = model.scorer()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, SMALL), f"test_{k}")
        ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            kept = plain_rules(kept)
        elif k == 1:
            kept = [r for r in kept if of((r["text"] or "").encode()) >= 0.5]
        elif k == 2:
            top = {i: c for i, _, c in brute_join([(r["doc_id"], r["text"]) for r in kept])}  # ids are distinct here
            kept = [r for r in kept if top[r["doc_id"]] == r["doc_id"]]
        elif k == 3:
            copies = plain_mix(kept)
            assert Counter(ids) == copies, name
            continue
        else:
            rows = docs.toPandas()
            check_slots(rows)
            assert Counter(rows[rows["piece"] == 0]["doc_id"].tolist()) == copies
            continue
        assert ids == sorted(r["doc_id"] for r in kept), name
    assert len(kept) > 0 and mixing.MOST == 3

def test_empty_and_awkward_documents(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "a", 0), (3, "some plain words that go on and on about nothing much at all, as plain words do when nobody minds them", "en", "a", 1)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        out = start
        for _, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, out, SMALL))
        assert set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"} and out.where("doc_id < 3").count() == 0
    assert table("documents").shape[0] > 0

def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [
        (5, text("a")), (5, text("b")),  # an id twice, texts that are not linked
        (3, text("c")), (7, text("c") + " end"), (7, text("d")),  # one of two rows with id 7 is linked to a smaller id
        (None, text("e")), (None, text("f")), (None, text("f") + " end"), (None, text("c")),  # linked with each other, and with 3
        (9, text("g")), (9, text("g")), (None, None), (None, ""), (11, text("h")), (12, ""), (12, ""),
    ]
    want = Counter(r for r in rows if r[1] not in (text("c") + " end", text("f"), text("f") + " end") and r != (None, text("c")))
    want[9, text("g")] = 1
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, source string")
    out = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    f = [got.pop((None, text("f") + end), 0) for end in ("", " end")]
    assert sorted(f) == [0, 1] and got == want


def test_stages_keep_columns_of_any_name(spark):
    """Columns that bear the names of measurements, of bookkeeping or of results come out as they went in."""
    plain = lambda k: " ".join(f"{w}{k}" if i % 3 else w for i, w in enumerate("some plain words that go on about nothing much at all as plain words do when nobody minds them and more of it".split()))
    names = ["n_words", "ledger", "__tie", "key", "document", "each", "copy", "rows", "n", "tie", "size", "part", "component_id", "a.b"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in names)
    docs = spark.createDataFrame([(k, plain(k), "en", "s", 0, *(1000 * k + i for i in range(len(names)))) for k in range(6)], schema)
    for repeated in (False, True):
        start = docs.unionByName(docs.where("doc_id = 3")) if repeated else docs
        for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_duplicates, corpus_pipeline.mix_sources):
            out = stage(spark, start, SMALL)
            assert out.columns == docs.columns
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == set(range(6))
            assert all(r[c] == 1000 * r["doc_id"] + i for r in rows for i, c in enumerate(names))


def test_idle_workers_keep_no_words(spark):
    """What a worker has learned in the packing stage does not stay in memory beside later stages."""
    docs = read(spark, SMALL, "documents").repartition(8)
    assert corpus_pipeline.best_fit_packing(spark, docs, SMALL).count() > 0
    key = packing.default_tokenizer(), corpus_pipeline.REMEMBERED

    def words(batches):
        for batch in batches:
            encoder = packing._TOKENIZERS.get(key)
            yield pa.RecordBatch.from_arrays([pa.array([len(encoder.known) if encoder else None] * batch.num_rows, pa.int64())], ["words"])

    found = {r["words"] for r in spark.range(0, 64, 1, 16).mapInArrow(words, "words long").collect()}
    assert 0 in found and found <= {0, None}


SMALL_HEAP = """
import sys
import corpus_pipeline
from countloom.llm import quality
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1] + "/steps").getOrCreate()
quality.fit = lambda docs, labels: quality.Model(b"", b"", ())
docs = spark.read.parquet(sys.argv[1] + "/documents.parquet")
print("kept", corpus_pipeline.quality_classifier(spark, docs, sys.argv[1]).selectExpr("count(*)", "sum(length(text))").first())
"""


def test_classifier_stage_reads_few_texts_at_once(tmp_path):
    """4,000 texts of 50,000 characters, which one task reads with a heap of 512 MB: 4,096 at once do not fit."""
    text = "some plain words that go on and on about nothing much " * 926
    rows = [f"{k} {text}"[:50_000] for k in range(4000)]
    pq.write_table(pa.table({"doc_id": range(4000), "text": rows}), tmp_path / "documents.parquet", use_dictionary=False)
    pq.write_table(pa.table({"doc_id": [0], "quality": [1]}), tmp_path / "labels.parquet")
    env = os.environ | {"PYTHONPATH": os.pathsep.join(sys.path), "PYSPARK_SUBMIT_ARGS": "--driver-memory 512m pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", SMALL_HEAP, str(tmp_path)], env=env, capture_output=True, text=True, timeout=200)
    assert "kept Row(count(1)=4000, sum(length(text))=200000000)" in out.stdout, out.stderr[-2000:]


def test_stored_steps_have_small_row_groups(spark):
    """A reader holds a whole row group: 50 MB of texts that do not compress are stored as several."""
    docs = spark.range(0, 25_000, 1, 1).selectExpr("id doc_id", "array_join(transform(sequence(1, 32), k -> sha2(concat(id, ' ', k), 256)), '') text")
    at = cut(docs).stored_at.removeprefix("file:")
    groups = [pq.ParquetFile(f"{at}/{f}").metadata for f in os.listdir(at) if f.endswith(".parquet")]
    most = max(m.row_group(k).column(1).total_compressed_size for m in groups for k in range(m.num_row_groups))
    assert sum(m.num_rows for m in groups) == 25_000 and most < 20e6


def test_repeated_labels_fit_the_same_model(spark, monkeypatch):
    """Copies of documents and labels take no places in the bounded sample of the fit: the model is that of the tables without copies."""
    from countloom.llm import quality

    monkeypatch.setattr(quality, "FIT_ROWS", 20)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    many = lambda df: df.union(df).union(df).union(df)
    once = quality.fit(docs, labels)
    assert once.good and once == quality.fit(many(docs), many(labels)) == quality.fit(many(docs), labels)
