"""Detection, quality windows, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import CountSet


def detect(cs: CountSet, min_expr: float | None = None) -> CountSet:
    """``num_cells_expressed`` per gene and ``num_genes_expressed`` per cell: entries strictly above ``min_expr``."""
    least = cs.detection_limit if min_expr is None else min_expr
    above = cs.expr.where(F.col("value") > least)
    out = cs
    for key, name, other in (("gene_id", "num_cells_expressed", cs.n_cells()), ("cell_id", "num_genes_expressed", cs.n_genes())):
        found = above.groupBy(key).agg(F.count("*").alias(name))
        if least < 0:  # zeros count too
            stored = cs.expr.groupBy(key).agg(F.count("*").alias("stored"))
            found = stored.join(found, key, "left").select(key, (other - F.col("stored") + F.coalesce(name, F.lit(0))).cast("long").alias(name))
        out = out.with_genes(found) if key == "gene_id" else out.with_cells(found)
    missing = 0
    return out.with_(genes=out.genes.fillna(missing, ["num_cells_expressed"]), cells=out.cells.fillna(missing, ["num_genes_expressed"]))


def totals(cs: CountSet) -> DataFrame:
    """(cell_id, total) of every cell, zero for cells without an entry."""
    sums = cs.expr.groupBy("cell_id").agg(F.sum("value").alias("total"))
    return cs.cells.select("cell_id").join(sums, "cell_id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def qc_window(cs: CountSet, most: float = 1e6, widths: float = 2.0) -> DataFrame:
    """Cells below ``most`` whose log10 total is strictly within so many standard deviations of the mean."""
    t = totals(cs).where((F.col("total") < most) & (F.col("total") > 0))
    m = t.agg(F.avg(F.log10("total")).alias("m"), F.stddev_samp(F.log10("total")).alias("s"))
    low, high = F.pow(F.lit(10.0), F.col("m") - widths * F.col("s")), F.pow(F.lit(10.0), F.col("m") + widths * F.col("s"))
    return t.crossJoin(F.broadcast(m)).where((F.col("total") > low) & (F.col("total") < high)).select("cell_id", "total")  # one row


def ordering_filter(cs: CountSet, ids: DataFrame) -> CountSet:
    """``use_for_ordering``: whether the gene is one of ``ids``."""
    marked = ids.select("gene_id").distinct().withColumn("use_for_ordering", F.lit(True))
    out = cs.with_genes(marked)
    return out.with_(genes=out.genes.fillna(False, ["use_for_ordering"]))


def varying(cs: CountSet) -> DataFrame:
    """Mean and population deviation of genes that are not constant, zeros included."""
    n = cs.n_cells()
    sums = cs.expr.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    mean = F.col("s") / n
    return sums.select("gene_id", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / n - mean * mean)).alias("sd")).where("sd > 0")
