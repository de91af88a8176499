"""Dispersion of counts: moments by gene, the curve disp = a + e / mean, and its table."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import CountSet
from ..functions.stats import round_half_even


@dataclass(frozen=True)
class Curve:
    a: float
    e: float

    def at(self, mu: Column) -> Column:
        return self.a + self.e / mu


def moments(cs: CountSet, min_cells: int = 1) -> DataFrame:
    """(gene_id, mu, disp) of genes detected in more than ``min_cells`` cells, from half-even rounded counts over size factors."""
    n = cs.n_cells()
    inverse = cs.cells.agg(F.avg(1 / F.col("size_factor"))).scalar()
    rows = cs.expr.join(cs.cells.select("cell_id", "size_factor"), "cell_id")
    r = round_half_even("value")
    y = r / F.col("size_factor")
    g = rows.groupBy("gene_id").agg(F.count_if(r > cs.detection_limit).alias("k"), F.sum(y).alias("s"), F.sum(y * y).alias("ss")).where(F.col("k") > min_cells)
    mu = F.col("s") / n
    var = F.col("ss") / n - mu * mu
    return g.select("gene_id", mu.alias("mu"), F.greatest(F.lit(0.0), (var - inverse * mu) / (mu * mu)).alias("disp"))


def grouped_moments(cs: CountSet, by: list[str], min_cells: int = 1) -> DataFrame:
    """Moments within each group of cells, pooled in one table (all of it feeds one curve)."""
    values = [r.asDict() for r in cs.cells.select(*by).distinct().collect()]
    out = None
    for v in values:
        cond = F.lit(True)
        for k, x in v.items():
            cond = cond & F.col(k).eqNullSafe(F.lit(x))
        part = moments(cs.subset(cells=cond), min_cells).withColumns({k: F.lit(x) for k, x in v.items()})
        out = part if out is None else out.unionByName(part)
    return out


def _sums(rows: pd.DataFrame, fit: np.ndarray) -> tuple[float, ...]:
    w, x, y = 1 / fit**2, 1 / rows["mu"].to_numpy(), rows["disp"].to_numpy()
    return tuple(float((w * c).sum()) for c in (1.0, x, x * x, y, x * y))


def _steps(rows: pd.DataFrame, a: float, e: float, most: int) -> tuple[float, float, np.ndarray]:
    """Fisher scoring of disp on 1 / mu (gamma, identity link) and which rows were in the last step."""
    good = np.ones(len(rows), bool)
    for _ in range(most):
        fit = a + e / rows["mu"].to_numpy()
        ratio = rows["disp"].to_numpy() / fit
        good = (ratio > 1e-6) & (ratio < 1e4)
        s = _sums(rows[good], fit[good])
        det = s[0] * s[2] - s[1] ** 2
        if not det:
            break
        new = max((s[2] * s[3] - s[1] * s[4]) / det, 1e-6), (s[0] * s[4] - s[1] * s[3]) / det
        if new[1] < 0:
            raise ValueError("the dispersion curve has a negative part; try another set of genes")
        moved = math.log(new[0] / a) ** 2 + math.log(max(new[1], 1e-300) / max(e, 1e-300)) ** 2
        a, e = new
        if moved < 1e-6:
            break
    return a, e, good


def fit_curve(table: DataFrame, most: int = 11, remove_outliers: bool = True) -> Curve:
    """Gamma regression with identity link of disp on 1 / mu by Fisher scoring, in one task: two numbers a gene.

    Genes whose dispersion is below 1e-6 or above 1e4 times the current curve are left out of a step.  Then genes that the last step left
    out, or with a Cook's distance above 4 over the number of genes, are removed and the fit is made once more.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"mu": [], "disp": []}), *batches], ignore_index=True)
        rows = rows.sort_values(["mu", "disp"], ignore_index=True)
        if not len(rows):
            return
        try:
            a, e, good = _steps(rows, 0.1, 1.0, most)
            if remove_outliers:
                fit = a + e / rows["mu"].to_numpy()
                s = _sums(rows, fit)
                det = s[0] * s[2] - s[1] ** 2
                if det:
                    w, x = 1 / fit**2, 1 / rows["mu"].to_numpy()
                    hat = w * (s[2] - 2 * x * s[1] + x * x * s[0]) / det
                    cook = ((rows["disp"].to_numpy() - fit) / fit) ** 2 * hat / (2 * (1 - hat) ** 2)
                    a, e, _ = _steps(rows[(cook <= 4 / len(rows)) & good], a, e, most)
            yield pd.DataFrame({"a": [a], "e": [e], "error": [""]})
        except ValueError as error:
            yield pd.DataFrame({"a": [0.0], "e": [0.0], "error": [str(error)]})

    found = table.where("disp > 0").select("mu", "disp").repartition(1).mapInPandas(run, "a double, e double, error string").collect()
    if not found:
        return Curve(0.1, 1.0)
    if found[0]["error"]:
        raise ValueError(found[0]["error"])
    return Curve(found[0]["a"], found[0]["e"])


def dispersion_table(table: DataFrame, curve: Curve) -> DataFrame:
    return table.select("gene_id", F.col("mu").alias("mean_expression"), curve.at(F.col("mu")).alias("dispersion_fit"), F.col("disp").alias("dispersion_empirical"))


def select_genes(table: DataFrame, curve: Curve, least_mean: float = 0.5, ratio: float = 1.0) -> DataFrame:
    t = dispersion_table(table, curve)
    return t.where((F.col("mean_expression") >= least_mean) & (F.col("dispersion_empirical") >= ratio * F.col("dispersion_fit")))


def hints(cs: CountSet, curve: Curve) -> DataFrame:
    """(gene_id, hint): the curve at the mean of the rounded raw counts."""
    g = cs.expr.groupBy("gene_id").agg(F.sum(round_half_even("value")).alias("s")).where("s > 0")
    return g.select("gene_id", curve.at(F.col("s") / cs.n_cells()).alias("hint"))


def quasi_poisson_hint(mu: float, fit: float, moment: float) -> float:
    return 1 + mu * max(fit, moment)


def kde_mode(values: np.ndarray, grid: int = 512) -> float:
    """Place of the highest point of a gaussian kernel density (normal reference bandwidth); 0 for fewer than two values."""
    if len(values) < 2:
        return 0.0
    sd, iqr = values.std(ddof=1), np.subtract(*np.percentile(values, [75, 25]))
    width = 0.9 * (min(sd, iqr / 1.34) or sd or abs(values[0]) or 1.0) * len(values) ** -0.2
    at = np.linspace(values.min() - 3 * width, values.max() + 3 * width, grid)
    density = np.zeros(grid)
    for block in np.array_split(values, max(1, len(values) // 4096)):
        density += np.exp(-0.5 * ((at[:, None] - block) / width) ** 2).sum(1)
    return float(at[density.argmax()])


def most_frequent(cs: CountSet, least: float = 0.1) -> DataFrame:
    """(cell_id, t): 10 to the mode of log10 of each cell's values above ``least``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell_id": [key[0]], "t": [10 ** kde_mode(np.log10(rows["value"].to_numpy()))]})

    kind = cs.expr.schema["cell_id"].dataType.simpleString()
    return cs.expr.where(F.col("value") > least).groupBy("cell_id").applyInPandas(run, f"cell_id {kind}, t double")
