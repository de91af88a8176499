"""The data behind each figure, as DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dataset import CountSet, everywhere
from ..functions.stats import round_half_even


def _grid(cs: CountSet, genes: DataFrame) -> DataFrame:
    """Every chosen gene in every cell, zeros filled in, with the attributes."""
    chosen = cs.genes.join(genes.select("gene_id"), "gene_id", "left_semi")
    entries = cs.expr.join(chosen.select("gene_id"), "gene_id", "left_semi")
    return everywhere(chosen, cs.cells, entries).withColumn("value", F.coalesce("value", F.lit(0.0)))


def expression(cs: CountSet, genes: DataFrame, min_expr: float, rounded: bool) -> DataFrame:
    """``_grid`` with ``expression``: value over size factor, rounded for jitter plots, floored at min_expr."""
    x = F.col("value") / F.col("size_factor")
    x = round_half_even(x) if rounded else x
    return _grid(cs, genes).withColumn("expression", F.greatest(F.lit(min_expr), x))


def positive_cells(cs: CountSet, genes: DataFrame, by: str, min_expr: float = 0.1) -> DataFrame:
    """(gene_id, by, target, percent): cells whose rounded expression is above min_expr (not negative), from the entries and the groups' sizes."""
    if min_expr < 0:
        raise ValueError("min_expr must not be negative")
    sizes = cs.cells.groupBy(by).agg(F.count("*").alias("n"))
    chosen = cs.genes.join(genes.select("gene_id"), "gene_id", "left_semi").select("gene_id")
    x = round_half_even(F.col("value") / F.col("size_factor"))
    above = cs.expr.join(chosen, "gene_id", "left_semi").join(cs.cells.select("cell_id", "size_factor", by), "cell_id").where(x > min_expr)
    rows = chosen.crossJoin(sizes).join(above.groupBy("gene_id", by).agg(F.count("*").alias("k")), ["gene_id", by], "left")  # genes times groups is the result
    return rows.select("gene_id", by, F.coalesce("k", F.lit(0)).alias("target"), (100 * F.coalesce("k", F.lit(0)) / F.col("n")).alias("percent"))


def mean_by_group(cs: CountSet, genes: DataFrame, by: str, min_expr: float = 0.1, rounded: bool = True, z: float = 1.96) -> DataFrame:
    """(gene_id, by, mean, low, high) of the expression that ``expression`` gives for every cell, from the entries and the groups' sizes: each cell
    without an entry adds ``min_expr``."""
    sizes = cs.cells.groupBy(by).agg(F.count("*").cast("double").alias("n"))
    chosen = cs.genes.join(genes.select("gene_id"), "gene_id", "left_semi").select("gene_id")
    x = F.col("value") / F.col("size_factor")
    x = F.greatest(F.lit(min_expr), round_half_even(x) if rounded else x) - min_expr  # what an entry adds to min_expr
    rows = cs.expr.join(chosen, "gene_id", "left_semi").join(cs.cells.select("cell_id", "size_factor", by), "cell_id")
    sums = rows.groupBy("gene_id", by).agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    g = chosen.crossJoin(sizes).join(sums, ["gene_id", by], "left").fillna(0.0, ["s", "ss"])
    m = F.col("s") / F.col("n")
    var = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.col("ss") - F.col("n") * m * m) / (F.col("n") - 1)).otherwise(0.0)
    g = g.withColumns({"mean": m + min_expr, "se": F.sqrt(var / F.col("n"))})
    return g.select("gene_id", by, "mean", (F.col("mean") - z * F.col("se")).alias("low"), (F.col("mean") + z * F.col("se")).alias("high"))


def bootstrap_interval(rows: DataFrame, by: list[str], value: str = "expression", draws: int = 1000, level: float = 0.95, seed: int = 2016) -> DataFrame:
    """(by, mean, low, high): percentile interval of the mean over ``draws`` resamples of each group (one gene and group of cells in a task)."""
    import numpy as np
    import pandas as pd

    types = dict(rows.dtypes)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(g[value].to_numpy(float))  # whatever order the rows come in
        rng = np.random.default_rng(seed)
        # a resample as counts of the distinct values: equal in law to drawing rows
        values, counts = np.unique(x, return_counts=True)
        means = rng.multinomial(len(x), counts / len(x), size=draws) @ values / len(x)
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame([(*key, x.mean(), low, high)], columns=[*by, "mean", "low", "high"])

    schema = ", ".join([f"{c} {types[c]}" for c in by] + ["mean double", "low double", "high double"])
    return rows.select(*by, value).groupBy(*by).applyInPandas(run, schema)


def in_pseudotime(cs: CountSet, genes: DataFrame, expected: DataFrame, min_expr: float) -> DataFrame:
    """Observed and expected expression, both floored; pairs without an expectation are left out.

    ``expected`` is (gene_id, cell_id, expectation), or (gene_id, an attribute of the cells, expectation): then it goes along with the gene, so no
    row of a gene and a cell is moved.
    """
    by = next(c for c in expected.columns if c not in ("gene_id", "expectation"))
    if by == "cell_id":
        rows = expression(cs, genes, min_expr, True).join(expected, ["gene_id", "cell_id"])
    else:
        entry = F.struct(by, F.struct("expectation").alias("e"))
        groups = expected.where(F.col(by).isNotNull()).groupBy("gene_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_expected"))
        rows = expression(cs.with_(genes=cs.genes.join(groups, "gene_id")), genes, min_expr, True)
        rows = rows.withColumn("_expected", F.try_element_at("_expected", F.col(by))).where("_expected is not null")
        rows = rows.withColumn("expectation", F.col("_expected.expectation")).drop("_expected")
    return rows.withColumn("expectation", F.greatest(F.lit(min_expr), F.coalesce("expectation", F.lit(min_expr))))


def coexpression(cs: CountSet, rows: DataFrame, columns: DataFrame, min_expr: float = 0.1) -> DataFrame:
    """(row_gene, column_gene, cell_id, row_value, column_value): both genes in each cell, if either is above min_expr."""
    a, b = _grid(cs, rows), _grid(cs, columns)
    a = a.select("cell_id", F.col("gene_id").alias("row_gene"), F.col("value").alias("row_value"))
    b = b.select("cell_id", F.col("gene_id").alias("column_gene"), F.col("value").alias("column_value"))
    return a.join(b, "cell_id").where((F.col("row_value") > min_expr) | (F.col("column_value") > min_expr))


def rotation(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return x * c - y * s, x * s + y * c


def trajectory_edges(edges: DataFrame, coords: DataFrame) -> DataFrame:
    """Edges (parent, child) with the coordinates (vertex, x, y) of either end; ends without any stay null."""
    a = coords.select(F.col("vertex").alias("parent"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = coords.select(F.col("vertex").alias("child"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.join(a, "parent", "left").join(b, "child", "left")


def tree_edges_full(edges: DataFrame, coords: DataFrame) -> DataFrame:
    """Full outer: also vertices that are no parent."""
    a = coords.select(F.col("vertex").alias("parent"), "x", "y")
    return edges.select("parent", "child").join(a, "parent", "full")


def heat_matrix(curves: DataFrame, clip: float = 3.0, log: bool = True) -> DataFrame:
    """(gene_id, grid_idx, z): log10(value + 1), standardised by gene, clipped; constant genes are left out."""
    v = F.log10(F.col("value") + 1) if log else F.col("value")
    w = W.partitionBy("gene_id")
    rows = curves.withColumn("v", v).withColumns({"m": F.avg("v").over(w), "s": F.stddev_samp("v").over(w)}).where("s > 0")
    return rows.select("gene_id", "grid_idx", F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col("v") - F.col("m")) / F.col("s"))).alias("z"))


def branched_heat_matrix(a: DataFrame, b: DataFrame, bins: int = 100, **more) -> DataFrame:
    """Branch A backwards, then branch B."""
    left = a.select("gene_id", (bins - 1 - F.col("grid_idx")).alias("grid_idx"), "value")
    return heat_matrix(left.unionByName(b.select("gene_id", (bins + F.col("grid_idx")).alias("grid_idx"), "value")), **more)


def unit_pseudotime(cells: DataFrame, by: str = "branch") -> DataFrame:
    """Pseudotime of each branch from 0 to 100."""
    ends = cells.groupBy(by).agg(F.min("pseudotime").alias("lo"), F.max("pseudotime").alias("hi"))
    rows = cells.join(F.broadcast(ends), by)  # a row a branch
    return rows.withColumn("pseudotime", 100 * (F.col("pseudotime") - F.col("lo")) / (F.col("hi") - F.col("lo"))).drop("lo", "hi")


def moving_mean(values: DataFrame, half: int = 25) -> DataFrame:
    """(gene_id, cell_id, smooth): mean of the neighbouring ranks along pseudotime."""
    w = W.partitionBy("gene_id").orderBy("pseudotime", "cell_id").rowsBetween(-half, half)
    return values.select("gene_id", "cell_id", F.avg("value").over(w).alias("smooth"))


def local_lines(x, y, span: float = 2 / 3, rounds: int = 3, step: float | None = None):
    """Locally weighted lines through (x, y) in the order of x (Cleveland 1979): tricube weights over the nearest ``span`` of the points, and
    ``rounds`` refits with bisquare weights of the residuals.  Points closer than ``step`` (default: 1 % of the range) to the last fitted one are
    interpolated."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    if n < 2:
        return y.copy()
    near = min(n, max(2, int(span * n + 1e-7)))
    step = 0.01 * (x[-1] - x[0]) if step is None else step
    robust, fit = np.ones(n), np.zeros(n)
    anchors = [0]
    while anchors[-1] < n - 1:  # the last point within a step, or the next one
        at = anchors[-1]
        nxt = max(int(np.searchsorted(x, x[at] + step, "right")) - 1, at + 1)
        anchors.append(nxt)
    for turn in range(rounds + 1):
        values = []
        for at in anchors:
            low = max(0, min(at, n - near))
            # the window of the nearest points slides until moving it on would not bring it nearer
            left, right = max(0, at - near + 1), min(at, n - near)
            while left < right:
                middle = (left + right) // 2
                if x[at] - x[middle] > x[middle + near] - x[at]:
                    left = middle + 1
                else:
                    right = middle
            low = left
            high = low + near
            reach = max(x[at] - x[low], x[high - 1] - x[at])
            while high < n and x[high] - x[at] <= reach:  # ties at the edge
                high += 1
            d = np.abs(x[low:high] - x[at])
            w = np.where(d <= 0.001 * reach, 1.0, np.where(d <= 0.999 * reach, (1 - (d / reach if reach else d) ** 3) ** 3, 0.0)) * robust[low:high]
            total = w.sum()
            if total <= 0:
                values.append(y[at])
                continue
            w = w / total
            mean = (w * x[low:high]).sum()
            spread = (w * (x[low:high] - mean) ** 2).sum()
            if np.sqrt(spread) > 0.001 * (x[-1] - x[0]):
                w = w * (1 + (x[at] - mean) * (x[low:high] - mean) / spread)
            values.append(float((w * y[low:high]).sum()))
        places = x[anchors]
        fit = np.interp(x, places, values) if places[-1] > places[0] else np.full(n, float(np.mean(values)))
        if turn == rounds:
            break
        off = np.abs(y - fit)
        scale = 6 * np.median(off)
        if scale < 1e-7 * off.mean() or scale == 0:
            break
        robust = np.where(off <= 0.001 * scale, 1.0, np.where(off <= 0.999 * scale, (1 - np.minimum(off / scale, 1) ** 2) ** 2, 0.0))
    return fit


def lowess(values: DataFrame, by: list[str] | None = None, span: float = 2 / 3, rounds: int = 3) -> DataFrame:
    """(gene_id, by, cell_id, smooth): robust local regression of value on pseudotime for each gene (and branch); two numbers a cell meet in a task."""
    import pandas as pd

    keys = ["gene_id", *(by or [])]
    types = dict(values.dtypes)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["pseudotime", "cell_id"], ignore_index=True)
        return pd.DataFrame({**dict(zip(keys, key)), "cell_id": g["cell_id"], "smooth": local_lines(g["pseudotime"], g["value"], span, rounds)})

    schema = ", ".join([f"{c} {types[c]}" for c in (*keys, "cell_id")] + ["smooth double"])
    return values.select(*keys, "cell_id", "pseudotime", "value").groupBy(*keys).applyInPandas(run, schema)


def branched_in_pseudotime(cs: CountSet, genes: DataFrame, cells: DataFrame, curve, min_expr: float = 0.1, method: str = "fitting", pvalues: DataFrame | None = None) -> DataFrame:
    """(gene_id, cell_id, branch, pseudotime, expression, expectation) of chosen genes on both branches, progenitors in each: observed values beside the
    branch model's (``method`` fitting) or local lines' (loess), both floored; with ``pvalues`` (gene_id, pval) each gene's."""
    from . import branch, difftest

    model = branch.model_set(cs.subset(genes=genes), cells, "duplicate", True)
    both = model.with_(cells=model.cells.withColumnsRenamed({"Pseudotime": "pseudotime", "Branch": "branch"}))
    rows = expression(both, both.genes, min_expr, True).select("gene_id", "cell_id", "branch", "pseudotime", "expression")
    if method == "loess":
        fitted = lowess(rows.withColumnRenamed("expression", "value"), ["branch"]).select("gene_id", "cell_id", F.col("smooth").alias("expectation"))
    elif method == "fitting":
        fitted = difftest.fitted_values(model, branch.FULL, curve).withColumnRenamed("value", "expectation")
    else:
        raise ValueError(f"unknown method {method}")
    rows = rows.join(fitted, ["gene_id", "cell_id"], "left").withColumn("expectation", F.greatest(F.lit(min_expr), F.coalesce("expectation", F.lit(min_expr))))
    return rows if pvalues is None else rows.join(pvalues.select("gene_id", "pval"), "gene_id", "left")


def pseudotime_heatmap(cs: CountSet, curve, bins: int = 100, formula: str = "~sm.ns(Pseudotime, df=3)", clusters: int | None = None, clip: float = 3.0) -> DataFrame:
    """(gene_id, grid_idx, z) of each gene's fitted curve; with ``clusters`` also its cluster: Ward's on correlation distances of the curves."""
    import numpy as np
    import pandas as pd

    from . import cluster, difftest

    ends = cs.cells.agg(F.min("Pseudotime"), F.max("Pseudotime")).first()
    grid = pd.DataFrame({"Pseudotime": np.linspace(ends[0], ends[1], bins)})
    matrix = heat_matrix(difftest.smooth_curves(cs, formula, grid, curve).where("value is not null"), clip)
    return matrix if clusters is None else matrix.join(cluster.row_clusters(matrix, clusters), "gene_id")


def branches_heatmap(cs: CountSet, paths: dict[str, list], curve, by: str = "State", bins: int = 100, clusters: int | None = None, clip: float = 3.0) -> DataFrame:
    """(gene_id, branch, grid_idx, z): the fitted curves of several root-to-tip paths (name -> states) side by side, standardised by gene over all of them."""
    import numpy as np
    import pandas as pd

    from . import cluster, difftest

    out = None
    for k, (name, states) in enumerate(paths.items()):
        own = cs.subset(cells=F.col(by).isin(states))
        ends = own.cells.agg(F.min("Pseudotime"), F.max("Pseudotime")).first()
        grid = pd.DataFrame({"Pseudotime": np.linspace(ends[0], ends[1], bins)})
        curves = difftest.smooth_curves(own, "~sm.ns(Pseudotime, df=3)", grid, curve).where("value is not null")
        part = curves.select("gene_id", F.lit(name).alias("branch"), (F.col("grid_idx") + k * bins).alias("grid_idx"), "value")
        out = part if out is None else out.unionByName(part)
    matrix = heat_matrix(out, clip).withColumn("branch", F.element_at(F.array(*map(F.lit, paths)), (F.floor(F.col("grid_idx") / bins) + 1).cast("int")))
    return matrix if clusters is None else matrix.join(cluster.row_clusters(matrix, clusters), "gene_id")


def branches_in_pseudotime(cs: CountSet, genes: DataFrame, paths: dict[str, list], by: str = "State") -> DataFrame:
    """(gene_id, branch, cell_id, pseudotime, value, smooth): expression of chosen genes along several paths, each path's pseudotime from 0 to 100, with
    its local lines."""
    named = [F.when(F.col(by).isin(states), F.lit(name)) for name, states in paths.items()]
    cells = cs.cells.withColumn("branch", F.explode(F.array_compact(F.array(*named)))).withColumnRenamed("Pseudotime", "pseudotime")
    cells = unit_pseudotime(cells.select("cell_id", "branch", "pseudotime"))
    rows = expression(cs, genes, 0.0, False).select("gene_id", "cell_id", F.col("expression").alias("value")).join(cells, "cell_id")
    return rows.join(lowess(rows, ["branch"]), ["gene_id", "branch", "cell_id"])


def ordering_genes(table: DataFrame, genes: DataFrame) -> DataFrame:
    return table.join(genes.select("gene_id", "use_for_ordering"), "gene_id")


def cell_clusters(coords: DataFrame, cells: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Coordinates with attributes, repeated by marker (gene_id, cell_id, value) with log10(value + 0.1)."""
    rows = coords.join(cells, "cell_id")
    return rows if markers is None else rows.join(markers.withColumn("log_value", F.log10(F.col("value") + 0.1)), "cell_id")


def gene_clusters(curves: DataFrame, clusters: DataFrame) -> DataFrame:
    return curves.join(clusters, "gene_id")


def rho_delta(dens: DataFrame, rho: float, delta: float) -> DataFrame:
    return dens.select("id", "rho", "delta", ((F.col("rho") >= rho) & (F.col("delta") >= delta)).alias("peak"))


def layout(edges: list[tuple[int, int]], root: int) -> dict[int, tuple[float, float]]:
    """Places of a small tree: depth down, leaves side by side, parents over the middle of their children."""
    children: dict[int, list[int]] = {}
    for a, b in edges:
        children.setdefault(a, []).append(b)
    out: dict[int, tuple[float, float]] = {}
    stack, leaf = [(root, 0, False)], 0
    while stack:
        v, depth, ready = stack.pop()
        below = sorted(children.get(v, []))
        if not below:
            out[v] = (float(leaf), -float(depth))
            leaf += 1
        elif ready:
            out[v] = (sum(out[c][0] for c in below) / len(below), -float(depth))
        else:
            stack.append((v, depth, True))
            stack += [(c, depth + 1, False) for c in reversed(below)]
    return out


#: Stops of the ramps as (red, green, blue), from low to high.
RAMPS = {
    "blue_green_red": [(0, 0, 255), (0, 255, 0), (255, 0, 0)],
    "jet": [(0, 0, 143), (0, 0, 255), (0, 255, 255), (255, 255, 0), (255, 0, 0), (128, 0, 0)],
    "blue_white_red": [(0, 0, 255), (255, 255, 255), (255, 0, 0)],
}


def color_ramp(n: int, name: str = "blue_green_red") -> list[str]:
    """n colours along a ramp."""
    stops, out = RAMPS[name], []
    for i in range(n):
        t = i / max(1, n - 1) * (len(stops) - 1)
        k = min(int(t), len(stops) - 2)
        out.append("#" + "".join(f"{round(x + (y - x) * (t - k)):02x}" for x, y in zip(stops[k], stops[k + 1])))
    return out
