"""Size factors, transforms, per-cell calibration and residuals."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dataset import CountSet, Family, everywhere
from ..functions.stats import ln0, round_half_even
from . import qc

METHODS = ("mean-geometric-mean-total", "geometric-mean-total", "weighted-median", "median-geometric-mean", "median", "mode")


def rounded(cs: CountSet) -> CountSet:
    return cs.with_(expr=cs.expr.withColumn("value", round_half_even("value")))


def padded_median(values: DataFrame, key: str, n: Column, value: str = "value") -> DataFrame:
    """Median per key of ``n`` non-negative values of which the missing ones are zero.

    With k stored values the padded median is an order statistic of the stored ones: the zeros take the first n - k ranks.  Ranks come
    from a histogram of each key's distinct values, so no key's values are gathered.
    """
    return weighted_median(values.where(F.col(value) > 0).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("w")), key, n)


def weighted_median(hist: DataFrame, key: str, n: Column) -> DataFrame:
    """(key, median) of ``n`` values each: ``hist`` (key, v, w) has each distinct value once with its number; those it lacks come first, as zeros."""
    along = W.partitionBy(key).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = hist.withColumns({"upto": F.sum("w").over(along), "all": F.sum("w").over(W.partitionBy(key)), "n": n})
    rows = rows.withColumn("zeros", F.greatest(F.lit(0.0), F.col("n") - F.col("all")))
    reaches = lambda rank: F.min(F.when(F.col("zeros") + F.col("upto") >= rank, F.col("v")))
    low, high = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
    found = rows.groupBy(key).agg(reaches(low).alias("low"), reaches(high).alias("high"), F.max(low <= F.col("zeros")).alias("z0"), F.max(high <= F.col("zeros")).alias("z1"))
    at = lambda z, v: F.when(F.col(z), F.lit(0.0)).otherwise(F.col(v))
    return found.select(key, ((at("z0", "low") + at("z1", "high")) / 2).alias("median"))


def size_factors(cs: CountSet, method: str = METHODS[0], round_exprs: bool = True, locfunc: Callable[[Column], Column] | None = None) -> DataFrame:
    """(cell_id, size_factor); an undefined factor is 1.  Cells without any count are left out of the geometric means and get 1.

    ``locfunc`` takes the place of the median of a gene's values (weighted-median; zeros are in an array column beside them) and of a cell's log
    ratios (median-geometric-mean): a function from an array column to a column.
    """
    if method not in METHODS:
        raise ValueError(f"unknown size factor method {method}")
    cs = rounded(cs) if round_exprs else cs
    cells = cs.cells.select("cell_id")
    if method.endswith("total"):
        t = qc.totals(cs)
        logs = F.broadcast(t.where("total > 0").agg(F.avg(F.ln("total")).alias("m")))  # one row
        made = F.col("total") / F.exp("m") if method == METHODS[0] else ln0(F.col("total")) / F.col("m")
        found = t.crossJoin(logs).select("cell_id", F.when(F.col("total") > 0, made).alias("f"))
    elif method == "weighted-median":
        if locfunc is None:
            med = padded_median(cs.expr, "gene_id", cs.n_cells()).where("median > 0")
        else:
            lists = cs.expr.groupBy("gene_id").agg(F.collect_list("value").alias("v")).crossJoin(F.broadcast(cs.cells.agg(F.count("*").alias("n"))))  # one row
            zeros = F.array_repeat(F.lit(0.0), (F.col("n") - F.size("v")).cast("int"))
            med = lists.select("gene_id", F.concat("v", zeros).alias("v")).select("gene_id", locfunc(F.col("v")).alias("median")).where("median > 0")
        weights = cs.expr.where("value > 0").groupBy("gene_id").agg((F.count("*") / cs.n_cells()).alias("w"))
        rows = cs.expr.where("value > 0").join(med, "gene_id").join(weights, "gene_id")
        found = rows.groupBy("cell_id").agg(F.exp(F.avg(F.col("w") * (F.ln("value") - F.ln("median")))).alias("f"))
    elif method == "median-geometric-mean":
        full = cs.expr.where("value > 0").groupBy("gene_id").agg(F.count("*").alias("k"), F.avg(F.ln("value")).alias("g")).where(F.col("k") == cs.n_cells())
        ratio = F.ln("value") - F.col("g")
        middle = F.median(ratio) if locfunc is None else locfunc(F.collect_list(ratio))
        found = cs.expr.join(full, "gene_id").groupBy("cell_id").agg(F.exp(middle).alias("f"))
    elif method == "mode":
        from .dispersion import most_frequent

        found = most_frequent(cs).withColumnRenamed("t", "f")
    else:
        # every gene counts in each cell: its entry (or zero) less the gene's median.  All cells share the histogram of minus the medians,
        # which has few distinct values; each entry moves one count of it.
        med = padded_median(cs.expr, "gene_id", cs.n_cells())
        everything = cs.genes.select("gene_id").join(med, "gene_id", "left").select("gene_id", F.coalesce("median", F.lit(0.0)).alias("median"))
        base = everything.groupBy((-F.col("median")).alias("v")).agg(F.count("*").alias("w"))
        moved = cs.expr.join(everything, "gene_id").select("cell_id", F.explode(F.array(
            F.struct((-F.col("median")).alias("v"), F.lit(-1).cast("long").alias("w")), F.struct((F.col("value") - F.col("median")).alias("v"), F.lit(1).cast("long").alias("w"))
        )).alias("x")).select("cell_id", "x.v", "x.w")
        rows = cells.crossJoin(base).unionByName(moved)
        hist = rows.groupBy("cell_id", (F.col("v") + 0.0).alias("v")).agg(F.sum("w").alias("w")).where("w > 0")
        found = weighted_median(hist, "cell_id", cs.n_genes()).withColumnRenamed("median", "f")
    return cells.join(found, "cell_id", "left").select("cell_id", F.coalesce("f", F.lit(1.0)).alias("size_factor"))


def with_size_factors(cs: CountSet, method: str = METHODS[0]) -> CountSet:
    return cs.with_cells(size_factors(cs, method))


def scaled(cs: CountSet) -> DataFrame:
    """(gene_id, cell_id, value / size factor)."""
    f = cs.cells.select("cell_id", "size_factor")
    return cs.expr.join(f, "cell_id").select("gene_id", "cell_id", (F.col("value") / F.col("size_factor")).alias("value"))


def log_normalized(cs: CountSet, pseudo: float = 1.0) -> DataFrame:
    """log2(value / size factor + pseudo) of the entries; with pseudo 1 the missing ones stay 0."""
    return scaled(cs).withColumn("value", F.log2(F.col("value") + pseudo))


def stabilized(q: Column, a: float, e: float) -> Column:
    """Variance-stabilised value of a normalised count for dispersion a + e / mean."""
    return F.log2((1 + e + 2 * a * q + 2 * F.sqrt(a * q * (1 + e + a * q))) / (4 * a))


def vst(cs: CountSet, a: float, e: float, round_vals: bool = True) -> DataFrame:
    """(gene_id, cell_id, value, baseline): the entries' values, and the value of every missing entry."""
    q = scaled(cs)
    value = round_half_even("value") if round_vals else F.col("value")
    return q.select("gene_id", "cell_id", stabilized(value, a, e).alias("value"), stabilized(F.lit(0.0), a, e).alias("baseline"))


def tfidf(cs: CountSet) -> DataFrame:
    """1[x > 0] ln(1 + cells / cells with the gene)."""
    df = cs.expr.where("value > 0").groupBy("gene_id").agg(F.count("*").alias("df"))
    return cs.expr.where("value > 0").join(df, "gene_id").select("gene_id", "cell_id", F.ln(1 + cs.n_cells() / F.col("df")).alias("value"))


def normalize(cs: CountSet, method: str = "log", pseudo: float = 1.0, relative: bool = True, coefficients: tuple[float, float] | None = None) -> DataFrame:
    """(gene_id, cell_id, value) of the entries that reductions work on, of the ordering genes if some are set; ``baseline_of`` is the value of
    every missing entry."""
    if "use_for_ordering" in cs.genes.columns:
        chosen = cs.subset(genes=F.col("use_for_ordering"))
        cs = chosen if chosen.genes.limit(1).count() else cs
    if cs.family.counts:
        if method == "log":
            return log_normalized(cs, pseudo) if relative else cs.expr.withColumn("value", F.log2(F.col("value") + pseudo))
        if method == "vstExprs":
            if not coefficients:
                raise ValueError("Error: no dispersion model found.")
            return vst(cs, *coefficients, round_vals=False).drop("baseline")
        if method == "none":
            return (scaled(cs) if relative else cs.expr).withColumn("value", F.col("value") + pseudo)
    if cs.family is Family.BINOMIAL and method == "none":
        return tfidf(cs)
    if cs.family is Family.TOBIT and method in ("log", "none"):
        value = F.col("value") + pseudo
        return cs.expr.withColumn("value", F.log2(value) if method == "log" else value)
    if cs.family is Family.GAUSSIAN and method == "none":
        return cs.expr.withColumn("value", F.col("value") + pseudo)
    raise ValueError(f"Error: normalization method {method} is not available for {cs.family.value}")


def baseline_of(family: Family, method: str = "log", pseudo: float = 1.0, coefficients: tuple[float, float] | None = None) -> float:
    """What ``normalize`` makes of a zero."""
    if method == "vstExprs":
        a, e = coefficients
        return math.log2((1 + e) / (4 * a))
    if family is Family.BINOMIAL:
        return 0.0
    return math.log2(pseudo) if method == "log" else pseudo


def dense(cs: CountSet, values: DataFrame, baseline: DataFrame | float = 0.0) -> DataFrame:
    """(gene_id, cell_id, value) of every gene of ``cs`` in every cell: ``values`` where it has a row, else the baseline: one number, or a
    table by gene and cell attributes (such as gene_id, baseline).  The size is genes times cells: subset ``cs`` to the genes that are wanted."""
    rows = everywhere(cs.genes.select("gene_id"), cs.cells.drop("value"), values.select("gene_id", "cell_id", "value"))
    if isinstance(baseline, DataFrame):
        rows = rows.join(baseline, [c for c in baseline.columns if c != "baseline"], "left")
    else:
        rows = rows.withColumn("baseline", F.lit(float(baseline)))
    return rows.select("gene_id", "cell_id", F.coalesce("value", "baseline").alias("value"))


def standardized(cs: CountSet, clip: float | None = None) -> DataFrame:
    """(gene_id, cell_id, value, baseline): (value - mean) / sd (n - 1) by gene, zeros included in both, clipped to +-clip; the baseline is
    that of the gene's missing entries."""
    n = cs.n_cells()
    sums = cs.expr.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    mean = F.col("s") / n
    sums = sums.select("gene_id", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - n * mean * mean) / (n - 1))).alias("sd")).where("sd > 0")
    z = lambda x: (x - F.col("mean")) / F.col("sd")
    cut = lambda x: x if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), x))
    return cs.expr.join(sums, "gene_id").select("gene_id", "cell_id", cut(z(F.col("value"))).alias("value"), cut(z(F.lit(0.0))).alias("baseline"))


def per_million(cs: CountSet) -> DataFrame:
    t = qc.totals(cs).where("total > 0")
    return cs.expr.join(t, "cell_id").select("gene_id", "cell_id", (F.col("value") / F.col("total") * 1e6).alias("value"))


def census(cs: CountSet, t: DataFrame, method: str = "num_genes", capture: float = 0.25, floor: float = 0.1) -> DataFrame:
    """(cell_id, total_mrna) from relative abundances and each cell's most frequent value ``t`` (cell_id, t).

    num_genes: expressed genes over the capture rate (where any value is at most t); tpm_fraction: values at most t over the
    share of abundance strictly below t.
    """
    x = cs.expr.where(F.col("value") > floor).join(t, "cell_id")
    facts = x.groupBy("cell_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") <= F.col("t")).alias("low"), F.sum("value").alias("all"),
        F.sum(F.when(F.col("value") < F.col("t"), F.col("value")).otherwise(0.0)).alias("below"),
    )
    if method == "num_genes":
        total = F.when(F.col("low") > 0, F.col("n") / capture)
    elif method == "tpm_fraction":
        total = F.when(F.col("below") > 0, F.col("low") / (F.col("below") / F.col("all")) / capture)
    else:
        raise ValueError(f"unknown method {method}")
    return cs.cells.select("cell_id").join(facts, "cell_id", "left").select("cell_id", total.alias("total_mrna"))


def relative_to_absolute(cs: CountSet, t: DataFrame, method: str = "num_genes") -> DataFrame:
    """Abundances scaled to the calibrated total of their cell."""
    sums = qc.totals(cs).join(census(cs, t, method), "cell_id").where("total > 0")
    return cs.expr.join(sums, "cell_id").select("gene_id", "cell_id", (F.col("value") / F.col("total") * F.col("total_mrna")).alias("value"))


def spike_scale(concentration: Column, volume: float, dilution: float) -> Column:
    """Molecules of a spike-in: attomoles per microlitre times volume over dilution."""
    return concentration * volume * 1e-3 / dilution * 1e-18 * 6.02214129e23


def batch_effects(cs: CountSet, factor: str) -> DataFrame:
    """(gene_id, factor, effect) of every gene with a value and every level: the level's mean less that of the reference (least) level, zeros included."""
    sizes = cs.cells.groupBy(factor).agg(F.count("*").alias("n"))
    level = cs.cells.agg(F.min(factor)).scalar()
    sums = cs.expr.join(cs.cells.select("cell_id", factor), "cell_id").groupBy("gene_id", factor).agg(F.sum("value").alias("s"))
    grid = sums.select("gene_id").distinct().crossJoin(sizes)  # genes times levels
    means = grid.join(sums, ["gene_id", factor], "left").select("gene_id", factor, (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("m"))
    base = means.where(F.col(factor) == level).select("gene_id", F.col("m").alias("base"))
    return means.join(base, "gene_id").select("gene_id", factor, (F.col("m") - F.col("base")).alias("effect"))


def batch_residuals(cs: CountSet, factor: str) -> DataFrame:
    """(gene_id, cell_id, value, baseline): values without the effect of one factor; the baseline is what a missing entry of the gene becomes in a
    cell of this level (``batch_baseline`` has it for all levels)."""
    rows = cs.expr.join(cs.cells.select("cell_id", factor), "cell_id").join(batch_effects(cs, factor), ["gene_id", factor])
    return rows.select("gene_id", "cell_id", (F.col("value") - F.col("effect")).alias("value"), (-F.col("effect")).alias("baseline"))


def batch_baseline(cs: CountSet, factor: str) -> DataFrame:
    """(gene_id, factor, baseline): what missing entries become, for ``dense``."""
    return batch_effects(cs, factor).select("gene_id", factor, (-F.col("effect")).alias("baseline"))


def model_residuals(cs: CountSet, formula: str) -> DataFrame:
    """(gene_id, cell_id, value) of every gene with a value in every cell, without the effects of all terms of a formula but the intercept.

    Least squares on any number of factors and covariates; coefficients that the design does not determine count as 0.
    """
    from . import difftest

    covariates = difftest._covariates(cs.with_(family=Family.GAUSSIAN), difftest.variables(formula))
    design = difftest.Design.of(formula, covariates)
    kind = cs.expr.schema["cell_id"].dataType.simpleString()

    def run(gene, y, cells):
        import numpy as np
        import pandas as pd

        x = design.matrix(cells)
        used: list[int] = []
        for k in range(x.shape[1]):  # columns that earlier ones determine have no coefficient
            if np.linalg.matrix_rank(x[:, [*used, k]]) > len(used):
                used.append(k)
        b = np.linalg.lstsq(x[:, used], y, rcond=None)[0]
        return pd.DataFrame({"gene_id": gene, "cell_id": cells["cell_id"], "value": y - x[:, used[1:]] @ b[1:]})

    return difftest.apply_by_gene(cs, run, f"gene_id {{kind}}, cell_id {kind}, value double", difftest.variables(formula), covariates)


def calibration_line(t: Column, at_mode: Column | float, slope: float, intercept: float) -> tuple[Column, Column]:
    """(k, b) with ``k log10 t + b = log10 at_mode`` and ``slope k - b = -intercept``."""
    k = (F.log10(F.lit(at_mode) if isinstance(at_mode, float) else at_mode) - intercept) / (F.log10(t) + slope)
    return k, slope * k + intercept


def along_line(value: Column, k: Column, b: Column) -> Column:
    """10^(k log10 value + b), 0 for a value of 0."""
    return F.when(value > 0, F.pow(F.lit(10.0), k * F.log10(value) + b)).otherwise(0.0)


def robust_line(x, y, steps: int = 20, k: float = 1.345) -> tuple[float, float]:
    """Slope and intercept by Huber weights (scale from the median absolute residual)."""
    import numpy as np

    w = np.ones(len(x))
    slope, intercept = 0.0, float(np.mean(y)) if len(y) else 0.0
    for _ in range(steps):
        a = np.column_stack([x, np.ones(len(x))]) * w[:, None]
        new = np.linalg.lstsq(a.T @ np.column_stack([x, np.ones(len(x))]), a.T @ y, rcond=None)[0]
        done = abs(new[0] - slope) + abs(new[1] - intercept) < 1e-10
        slope, intercept = float(new[0]), float(new[1])
        r = np.abs(y - slope * x - intercept)
        scale = np.median(r) / 0.6745
        if done or scale == 0:
            break
        w = np.minimum(1.0, k * scale / np.maximum(r, 1e-300))
    return slope, intercept


def spike_in_lines(cs: CountSet, spikes: DataFrame, volume: float, dilution: float, threshold: float = 0.01430512, floor: float = 1e-10) -> DataFrame:
    """(cell_id, slope, intercept) of log10 molecules against log10 abundance of the spike-ins (gene_id, concentration) in each cell."""
    import numpy as np
    import pandas as pd

    if not 0.01430512 <= threshold <= 7500:
        raise ValueError("concentration detection limit should be between 0.01430512 and 7500")
    used = spikes.where(F.col("concentration") >= threshold).select("gene_id", spike_scale(F.col("concentration"), volume, dilution).alias("molecules"))
    rows = cs.expr.join(F.broadcast(used), "gene_id").where(F.col("value") >= floor)  # a spike-in kit has under a hundred
    kind = cs.expr.schema["cell_id"].dataType.simpleString()

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        line = robust_line(np.log10(g["value"].to_numpy()), np.log10(g["molecules"].to_numpy())) if len(g) > 1 else (None, None)
        return pd.DataFrame({"cell_id": [key[0]], "slope": [line[0]], "intercept": [line[1]]})

    return rows.select("cell_id", "value", "molecules").groupBy("cell_id").applyInPandas(run, f"cell_id {kind}, slope double, intercept double")


def by_spike_ins(cs: CountSet, lines: DataFrame) -> DataFrame:
    """Abundances as molecules along each cell's spike-in line."""
    value = F.pow(F.lit(10.0), F.col("slope") * F.log10("value") + F.col("intercept"))
    return cs.expr.where("value > 0").join(lines, "cell_id").select("gene_id", "cell_id", value.alias("value"))
