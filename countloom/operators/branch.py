"""Branch analysis: branch data sets, areas between curves, log ratios, divergence points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dataset import CountSet
from ..store import cut
from . import difftest
from .dispersion import Curve
from .graph import Adjacency, path
from .normalize import stabilized

FULL, REDUCED = "~sm.ns(Pseudotime, df=3)*Branch", "~sm.ns(Pseudotime, df=3)"


def branch_paths(tree: Adjacency, root: int, branch_point: int | None = None, tips: list[int] | None = None) -> list[list[int]]:
    """The vertices of two branches, each from the root: to the given tips, or through the branch vertex into each part that does
    not hold the root."""
    if tips is None:
        way = path(tree, root, branch_point)
        on = set(way)
        parts = []
        for u in sorted(tree[branch_point]):
            if u in on:
                continue
            own, stack = [u], [u]
            while stack:
                for x in sorted(tree[stack.pop()]):
                    if x != branch_point and x not in own:
                        own.append(x)
                        stack.append(x)
            parts.append(way + own)
    else:
        parts = [path(tree, root, t) for t in tips]
    if len(parts) != 2:
        raise ValueError("exactly two branches are needed")
    return parts


def stretch(cells: DataFrame) -> DataFrame:
    """cells (cell_id, branch, pseudotime, progenitor) with pseudotime rescaled: the part after the split of each branch to the
    longest branch, and all of it to 0..100."""
    split = cells.where("progenitor").agg(F.max("pseudotime").alias("split"))
    ends = cells.groupBy("branch").agg(F.max("pseudotime").alias("stop"))
    longest = ends.agg(F.max("stop").alias("longest"))
    rows = cells.join(F.broadcast(ends), "branch").crossJoin(F.broadcast(split)).crossJoin(F.broadcast(longest))  # one row each
    start = F.coalesce("split", F.lit(0.0))
    t = F.when(F.col("progenitor") | (F.col("stop") <= start), F.col("pseudotime")).otherwise(
        start + (F.col("pseudotime") - start) * (F.col("longest") - start) / (F.col("stop") - start)
    )
    return rows.withColumn("pseudotime", 100 * t / F.col("longest")).drop("stop", "split", "longest")


def sequential_split(cells: DataFrame) -> DataFrame:
    """(cell_id, original_cell_id, branch): progenitors alternate between the two branches by pseudotime rank, and the first of them
    is in both, so each branch begins at the root."""
    turn = F.row_number().over(W.orderBy("pseudotime", "cell_id"))  # progenitors of one branch point
    parents = cells.where("progenitor").withColumn("turn", turn)
    alternate = parents.select(F.col("cell_id").cast("string").alias("cell_id"), F.col("cell_id").alias("original_cell_id"), ((F.col("turn") - 1) % 2).alias("branch"))
    root = parents.where("turn = 1").select(F.lit("duplicate_root").alias("cell_id"), F.col("cell_id").alias("original_cell_id"), F.lit(1).alias("branch"))
    own = cells.where("not progenitor").select(F.col("cell_id").cast("string").alias("cell_id"), F.col("cell_id").alias("original_cell_id"), F.col("branch").cast("int").alias("branch"))
    return own.unionByName(alternate).unionByName(root)


def duplicate(cells: DataFrame) -> DataFrame:
    """(cell_id, original_cell_id, branch): every progenitor in both branches."""
    parents = cells.where("progenitor").select("cell_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("branch"))
    parents = parents.select(F.concat_ws("_", F.lit("duplicate"), "branch", "cell_id").alias("cell_id"), F.col("cell_id").alias("original_cell_id"), "branch")
    own = cells.where("not progenitor").select(F.col("cell_id").cast("string").alias("cell_id"), F.col("cell_id").alias("original_cell_id"), F.col("branch").cast("int").alias("branch"))
    return own.unionByName(parents)


def branch_set(cs: CountSet, cells: DataFrame, method: str = "sequential_split", stretched: bool = True) -> CountSet:
    """The count set over the cells of both branches; copies of a cell have its entries and size factor."""
    if method not in ("sequential_split", "duplicate"):
        raise ValueError(f"unknown progenitor method {method}")
    cells = stretch(cells) if stretched else cells
    copies = sequential_split(cells) if method == "sequential_split" else duplicate(cells)
    times = cells.groupBy(F.col("cell_id").alias("original_cell_id")).agg(F.min("pseudotime").alias("pseudotime"))
    old = cs.cells.withColumnRenamed("cell_id", "original_cell_id").drop("pseudotime", "branch")
    new = copies.join(times, "original_cell_id").join(old, "original_cell_id").withColumn("branch", F.col("branch").cast("string"))
    expr = cs.expr.withColumnRenamed("cell_id", "original_cell_id").join(copies.select("cell_id", "original_cell_id"), "original_cell_id")
    return cs.with_(cells=new, expr=expr.select("gene_id", "cell_id", "value"))


def branch_cells(cells: DataFrame, tree: Adjacency, root: int, branch_point: int | None = None, tips: list[int] | None = None, vertex: str = "vertex") -> DataFrame:
    """``cells`` (cell_id, pseudotime, vertex) of two branches of a principal tree, with branch (0, 1) and progenitor (on both paths, or before the split)."""
    paths = branch_paths(tree, root, branch_point, tips)
    shared = set(paths[0]) & set(paths[1])
    places = [(v, k, v in shared) for k, way in enumerate(paths) for v in way if k == 0 or v not in shared]
    places = F.broadcast(cells.sparkSession.createDataFrame(places, f"{vertex} long, branch long, progenitor boolean"))  # the tree's vertices
    return cells.drop("branch", "progenitor").join(places, vertex).select("cell_id", "branch", "pseudotime", "progenitor")


def model_set(cs: CountSet, cells: DataFrame, method: str, stretched: bool) -> CountSet:
    """``branch_set`` as stored tables with the names that formulas use."""
    both = branch_set(cs, cells, method, stretched)
    renamed = both.cells.withColumnsRenamed({"pseudotime": "Pseudotime", "branch": "Branch"})
    return both.with_(cells=cut(renamed), expr=cut(both.expr))  # read by each step of a fit


def branch_test(cs: CountSet, cells: DataFrame, full: str = FULL, reduced: str = REDUCED, curve: Curve | None = None, method: str = "sequential_split", stretched: bool = True) -> DataFrame:
    """Likelihood-ratio test by gene of two formulas over the cells (cell_id, branch, pseudotime, progenitor) of two branches; without ``Branch`` in the
    formulas over the cells of ``cs`` as they are."""
    if "Branch" in difftest.variables(full, reduced):
        cs = model_set(cs, cells, method, stretched)
    return difftest.regression_test(cs, full, reduced, curve)


def beam(cs: CountSet, cells: DataFrame, full: str = FULL, reduced: str = REDUCED, curve: Curve | None = None, method: str = "sequential_split") -> DataFrame:
    """``branch_test`` (gene_id, status, family, pval, qval) with the genes' attributes."""
    test = branch_test(cs, cells, full, reduced, curve, method).select("gene_id", "status", "family", "pval", "qval")
    return test.join(cs.genes.drop("status", "family", "pval", "qval"), "gene_id")


def fitted_curves(cs: CountSet, cells: DataFrame, num: int = 100, formula: str = FULL, curve: Curve | None = None, stretched: bool = True, method: str = "duplicate") -> DataFrame:
    """(gene_id, grid_idx, a, b): the branch model's curves of both branches at ``num`` places from 0 to the greatest pseudotime."""
    import numpy as np
    import pandas as pd

    both = model_set(cs, cells, method, stretched)
    end = both.cells.agg(F.max("Pseudotime")).first()[0]
    at = np.linspace(0, end, num)
    grid = pd.DataFrame({"Pseudotime": np.tile(at, 2), "Branch": ["0"] * num + ["1"] * num})
    rows = difftest.smooth_curves(both, formula, grid, curve)
    value = lambda first: F.max(F.when((F.col("grid_idx") < num) == first, F.col("value")))
    rows = rows.groupBy("gene_id", (F.col("grid_idx") % num).alias("grid_idx"))
    return rows.agg(value(True).alias("a"), value(False).alias("b")).where("a is not null and b is not null")


def areas(cs: CountSet, cells: DataFrame, num: int = 5000, formula: str = FULL, curve: Curve | None = None) -> DataFrame:
    """Signed areas between the fitted curves of the branches (pseudotime from 0 to 100), with the genes' attributes."""
    return area_between(fitted_curves(cs, cells, num, formula, curve), 100.0 / (num - 1)).join(cs.genes, "gene_id")


def log_ratios(cs: CountSet, cells: DataFrame, num: int = 100, limit: float | None = 3.0, variance_stabilized: bool = False, formula: str = FULL, curve: Curve | None = None) -> DataFrame:
    """(gene_id, grid_idx, ilr) of the fitted curves: log2 ratios, or differences of variance-stabilised values, clipped to +-limit."""
    curves = fitted_curves(cs, cells, num, formula, curve)
    if not variance_stabilized:
        return log_ratio(curves, limit)
    if curve is None:
        raise ValueError("variance stabilisation needs a dispersion curve")
    d = stabilized(F.col("a"), curve.a, curve.e) - stabilized(F.col("b"), curve.a, curve.e)
    d = d if limit is None else F.greatest(F.lit(-limit), F.least(F.lit(limit), d))
    return curves.select("gene_id", "grid_idx", d.alias("ilr"))


def area_between(curves: DataFrame, width: float) -> DataFrame:
    """(gene_id, abc): the signed area between the curves (gene_id, grid_idx, a, b) by trapezoids of ``width``, to 3 places."""
    w = W.partitionBy("gene_id").orderBy("grid_idx")
    x = F.col("a") - F.col("b")
    rows = curves.withColumn("x", x).withColumn("nxt", F.lead("x").over(w))
    return rows.groupBy("gene_id").agg(F.round(F.sum((F.col("x") + F.col("nxt")) / 2 * width), 3).alias("abc"))


def log_ratio(curves: DataFrame, limit: float | None = 3.0, pseudo: float = 1.0) -> DataFrame:
    """(gene_id, grid_idx, ilr): log2 of the curves' ratio, clipped."""
    r = F.log2((F.col("a") + pseudo) / (F.col("b") + pseudo))
    r = r if limit is None else F.greatest(F.lit(-limit), F.least(F.lit(limit), r))
    return curves.select("gene_id", "grid_idx", r.alias("ilr"))


def divergence(ilr: DataFrame) -> DataFrame:
    """(gene_id, divergence): the greatest absolute log ratio."""
    return ilr.groupBy("gene_id").agg(F.max(F.abs("ilr")).alias("divergence"))


def divergences(curves: DataFrame, limit: float = 3.0) -> DataFrame:
    """(gene_id, raw, normalized, ratio): greatest absolute difference of the curves, that over the curves' greatest value, and the greatest absolute clipped
    log ratio."""
    d, top = F.max(F.abs(F.col("a") - F.col("b"))), F.max(F.greatest("a", "b"))
    plain = curves.groupBy("gene_id").agg(d.alias("raw"), F.when(top > 0, d / top).otherwise(0.0).alias("normalized"))
    return plain.join(divergence(log_ratio(curves, limit)).withColumnRenamed("divergence", "ratio"), "gene_id")


def bifurcation_point(ilr: DataFrame, threshold: float = 0.1, cross_only: bool = True) -> DataFrame:
    """(gene_id, point): the last sign change before the greatest absolute log ratio, with the sign of the ratios' sum; null if there
    is none.  Without ``cross_only`` the first index from there to the greatest whose ratio is above the threshold."""
    w = W.partitionBy("gene_id").orderBy("grid_idx")
    rows = ilr.withColumn("nxt", F.lead("ilr").over(w))
    top = rows.groupBy("gene_id").agg(F.max_by("grid_idx", F.struct(F.abs("ilr"), -F.col("grid_idx"))).alias("top"), F.signum(F.sum("ilr")).cast("int").alias("sign"))
    rows = rows.join(top, "gene_id").where(F.col("grid_idx") <= F.col("top"))
    cross = F.max(F.when((F.col("ilr") * F.col("nxt") <= 0) & (F.col("grid_idx") < F.col("top")), F.col("grid_idx")))
    found = rows.groupBy("gene_id", "sign").agg(cross.alias("cross"))
    if not cross_only:
        rows = rows.join(found.select("gene_id", "cross"), "gene_id").where(F.col("grid_idx") >= F.col("cross"))
        first = rows.where(F.abs("ilr") > threshold).groupBy("gene_id").agg(F.min("grid_idx").alias("first"))
        found = found.join(first, "gene_id", "left").withColumn("cross", F.col("first"))
    return found.select("gene_id", (F.col("cross") * F.col("sign")).alias("point"))


def curves_of(values: DataFrame, at: Column, bins: int = 100) -> DataFrame:
    """(gene_id, grid_idx, a, b): mean value by bin of pseudotime (0..100) on branches 0 and 1; bins that lack a branch are left out."""
    idx = F.least(F.lit(bins - 1), F.floor(at * bins / 100)).cast("int")
    g = values.groupBy("gene_id", idx.alias("grid_idx"))
    out = g.agg(F.avg(F.when(F.col("branch") == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("branch") == 1, F.col("value"))).alias("b"))
    return out.where("a is not null and b is not null")
