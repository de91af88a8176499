"""Reads matrix-market directories of droplet pipelines, layouts 2 and 3, and writes count sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dataset import CountSet, Family


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def genome_dir(spark: SparkSession, path: str, genome: str | None = None) -> str:
    """The genome's sub-directory: the only one if none is named."""
    fs, p = _fs(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    if genome is None:
        if len(names) != 1:
            raise ValueError(f"several genomes in {path}: name one of {names}")
        return f"{path}/{names[0]}"
    if genome not in names:
        raise ValueError(f"no genome {genome} in {path}: {names}")
    return f"{path}/{genome}"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, n) of a text file, from 1.  The partitions' counts give each its first number, so lines are not gathered."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id"))
    part = F.shiftright("id", 33)
    counts = lines.groupBy(part.alias("part")).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select("part", before.alias("first")))  # one row a partition
    rows = lines.withColumn("part", part).join(counts, "part")
    return rows.select(F.col("value").alias("line"), (F.col("first") + (F.col("id") - F.shiftleft(F.col("part"), 33)) + 1).alias("n"))


def make_unique(df: DataFrame, key: str, order: str) -> DataFrame:
    """Repeats of a key get ``.1``, ``.2`` ... in order."""
    turn = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    return df.withColumn("__t", turn).withColumn(key, F.when(F.col("__t") == 0, F.col(key)).otherwise(F.concat(key, F.lit("."), F.col("__t").cast("string")))).drop("__t")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """(gene_idx, cell_idx, value) and the header's dimensions."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).withColumn("f", F.split(F.trim("value"), "\\s+"))
    head = lines.first()  # the dimensions come first in the file
    dims = tuple(int(x) for x in head["f"][:3])
    body = numbered_lines(spark, path).where(~F.col("line").startswith("%") & (F.trim("line") != ""))
    first = body.agg(F.min("n")).scalar()
    f = F.split(F.trim("line"), "\\s+")
    return body.where(F.col("n") > first).select(f[0].cast("long").alias("gene_idx"), f[1].cast("long").alias("cell_idx"), f[2].cast("double").alias("value")), dims


def load(spark: SparkSession, path: str, genome: str | None = None, filtered: bool = True, detection_limit: float = 0.5, family: Family = Family.NB_SIZE) -> CountSet:
    """A pipeline's output directory as a count set."""
    if not exists(spark, f"{path}/outs"):
        raise ValueError(f"Could not find the output directory {path}/outs")
    kind = "filtered" if filtered else "raw"
    new = exists(spark, f"{path}/outs/filtered_feature_bc_matrix")
    if new:
        root = f"{path}/outs/{kind}_feature_bc_matrix"
        files = [f"{root}/{n}.gz" for n in ("features.tsv", "barcodes.tsv", "matrix.mtx")]
    else:
        root = f"{path}/outs/{kind}_gene_bc_matrices"
        if not exists(spark, root):
            raise ValueError(f"Could not find matrix directory {root}")
        root = genome_dir(spark, root, genome)
        files = [f"{root}/{n}" for n in ("genes.tsv", "barcodes.tsv", "matrix.mtx")]
    for f in files:
        if not exists(spark, f):
            raise ValueError(f"Could not find {f}")
    fields = F.split("line", "\t")
    genes = numbered_lines(spark, files[0]).select("n", fields[0].alias("gene_id"), F.get(fields, F.lit(1)).alias("gene_short_name"), F.get(fields, F.lit(2)).alias("feature_type"))
    cells = numbered_lines(spark, files[1]).select("n", fields[0].alias("cell_id"))
    entries, (n_genes, n_cells, _) = read_matrix(spark, files[2])
    if genes.count() != n_genes or cells.count() != n_cells:
        raise ValueError("the dimensions of the matrix do not match its gene and barcode lists")
    genes, cells = make_unique(genes, "gene_id", "n"), make_unique(cells, "cell_id", "n")
    if new:
        genes = genes.where("feature_type = 'Gene Expression'")
        if genome is not None:
            own = genes.where(F.col("gene_id").contains(genome))
            genes = own if own.limit(1).count() else genes
    expr = entries.join(genes.select(F.col("n").alias("gene_idx"), "gene_id"), "gene_idx").join(cells.select(F.col("n").alias("cell_idx"), "cell_id"), "cell_idx")
    cells = cells.select("cell_id", F.col("cell_id").alias("barcode"))
    return CountSet(expr.select("gene_id", "cell_id", "value"), cells, genes.select("gene_id", "gene_short_name", "feature_type") if new else genes.select("gene_id", "gene_short_name"), family, detection_limit)


def read_sheet(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A tab-separated attribute sheet; its first column is the key."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.withColumnRenamed(df.columns[0], key)


def write(cs: CountSet, path: str, logged: bool = False) -> None:
    """Parquet tables expr, cells, genes; ``logged`` writes log2(value + 1)."""
    expr = cs.expr.withColumn("value", F.log2(F.col("value") + 1)) if logged else cs.expr
    for name, df in (("expr", expr), ("cells", cs.cells), ("genes", cs.genes)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, logged: bool = False, offset: float = 1.0) -> CountSet:
    """The counterpart of ``write``; logged values are taken back, the family is inferred."""
    from ..dataset import from_tables

    expr, cells, genes = (spark.read.parquet(f"{path}/{n}") for n in ("expr", "cells", "genes"))
    expr = expr.withColumn("value", F.round(F.pow(F.lit(2.0), F.col("value")) - offset, 9)) if logged else expr
    return from_tables(expr, cells, genes)


def _lines(df: DataFrame, path: str, name: str, compressed: bool) -> None:
    """One text file ``path/name`` of the ordered rows of ``df`` (place, line): sorted and written in parts, which are then joined in order."""
    spark = df.sparkSession
    part = f"{path}/.{name}"
    writer = df.orderBy("place").select("line").write.mode("overwrite")
    writer.option("compression", "gzip" if compressed else "none").text(part)
    fs, folder = _fs(spark, part)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    out = fs.create(target, True)
    try:
        for piece in sorted(str(s.getPath()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")):
            piece_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(piece)
            stream = fs.open(piece_path)
            spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)  # gzip members follow each other
            stream.close()
    finally:
        out.close()
    fs.delete(folder, True)


def write_directory(cs: CountSet, path: str) -> None:
    """A droplet pipeline's output directory in the newer layout: features, barcodes and the matrix, compressed.  Values of the matrix keep their digits."""
    root = f"{path}/outs/filtered_feature_bc_matrix"
    number = lambda df, key: numbered(df.select(key).orderBy(key))
    genes, cells = number(cs.genes, "gene_id"), number(cs.cells, "cell_id")
    names = cs.genes if "gene_short_name" in cs.genes.columns else cs.genes.withColumn("gene_short_name", F.col("gene_id").cast("string"))
    features = genes.join(names.select("gene_id", "gene_short_name"), "gene_id")
    entries = cs.expr.join(genes.withColumnRenamed("n", "i"), "gene_id").join(cells.withColumnRenamed("n", "j"), "cell_id")
    head = cs.genes.agg(F.count("*").alias("g")).crossJoin(cs.cells.agg(F.count("*").alias("c"))).crossJoin(entries.agg(F.count("*").alias("e")))  # one row each
    banner = head.sparkSession.createDataFrame([("%%MatrixMarket matrix coordinate real general",)], "line string")
    body = entries.select(F.struct(F.lit(2).alias("k"), "j", "i").alias("place"), F.concat_ws(" ", "i", "j", "value").alias("line"))
    zero = lambda k: F.struct(F.lit(k).alias("k"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("i")).alias("place")
    matrix = banner.select(zero(0), "line").unionByName(head.select(zero(1), F.concat_ws(" ", "g", "c", "e").alias("line"))).unionByName(body)
    kind = F.lit("Gene Expression")
    _lines(features.select(F.col("n").alias("place"), F.concat_ws("\t", "gene_id", "gene_short_name", kind).alias("line")), root, "features.tsv.gz", True)
    _lines(cells.select(F.col("n").alias("place"), F.col("cell_id").cast("string").alias("line")), root, "barcodes.tsv.gz", True)
    _lines(matrix, root, "matrix.mtx.gz", True)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` (sorted) with ``n`` from 1; the partitions' counts give each its first number."""
    from ..store import cut

    rows = cut(df.withColumn("id", F.monotonically_increasing_id()))  # ids must not change between two readings
    part = F.shiftright("id", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select("part", before.alias("first")))  # one row a partition
    rows = rows.withColumn("part", part).join(counts, "part")
    return rows.withColumn("n", F.col("first") + (F.col("id") - F.shiftleft(F.col("part"), 33)) + 1).drop("part", "first", "id")


def write_sheet(df: DataFrame, path: str) -> None:
    """A tab-separated attribute sheet with a header; its first column is the key."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)
