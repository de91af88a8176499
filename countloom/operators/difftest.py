"""Differential tests: closed-form likelihood ratios for a categorical factor, regressions for everything else."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import CountSet, Family
from ..functions.stats import bh_adjust, chi2_tail, round_half_even, xlogy
from .dispersion import Curve

NOT_FINITE = "the cell attributes of the model terms have null, NaN or infinite values"
NO_SIZE_FACTORS = "cells lack size factors: run normalize.with_size_factors first"


def responses(cs: CountSet) -> DataFrame:
    """(gene_id, cell_id, y): half-even rounded count over size factor for counts, else the value."""
    if not cs.family.counts:
        return cs.expr.select("gene_id", "cell_id", F.col("value").alias("y"))
    f = cs.cells.select("cell_id", "size_factor")
    return cs.expr.join(f, "cell_id").select("gene_id", "cell_id", round_half_even(F.col("value") / F.col("size_factor")).alias("y"))


def refuse_missing(cells: DataFrame, names: list[str], *more: Column) -> tuple:
    """Raises if an attribute of a model term is null or not finite in any cell; ``more`` aggregates of the same pass are returned."""
    kinds = dict(cells.dtypes)
    bad = F.lit(False)
    for v in names:
        bad = bad | F.col(v).isNull()
        if kinds[v] in ("double", "float"):
            bad = bad | F.isnan(v) | (F.abs(F.col(v)) == math.inf)
    found = cells.agg(F.bool_or(bad), *more).first()
    if found[0]:
        raise ValueError(NOT_FINITE)
    return tuple(found)[1:]


def likelihood_ratio(cs: CountSet, factor: str, hints: DataFrame | None = None) -> DataFrame:
    """(gene_id, lr) of ``~ factor`` against ``~ 1``.

    The maximum-likelihood mean of a group is its sample mean (zeros included), so two aggregations by gene and level give the
    exact statistic; levels without an entry of a gene still have their cells.
    """
    n = cs.n_cells()
    sizes = cs.cells.groupBy(F.col(factor).alias("level")).agg(F.count("*").cast("double").alias("n"))
    y = responses(cs).join(cs.cells.select("cell_id", F.col(factor).alias("level")), "cell_id")
    by = y.groupBy("gene_id", "level").agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss")).join(sizes, "level")
    m = F.col("s") / F.col("n")
    if cs.family is Family.NB_SIZE:
        by = by.join(hints, "gene_id").withColumn("k", 1 / F.col("hint"))
        k = F.col("k")
        ll = F.col("n") * (xlogy(m, m) - (m + k) * F.ln(m + k))
        g = by.groupBy("gene_id", "k").agg(F.sum(ll).alias("l1"), F.sum("n").alias("seen"), F.sum("s").alias("s"))
        mean = F.col("s") / n
        full = F.col("l1") - (n - F.col("seen")) * k * F.ln(k)  # levels without an entry: mean 0
        null = n * (xlogy(mean, mean) - (mean + k) * F.ln(mean + k))
        return g.select("gene_id", F.greatest(F.lit(0.0), 2 * (full - null)).alias("lr"))
    if cs.family is Family.BINOMIAL:
        ll = F.col("n") * (xlogy(m, m) + xlogy(1 - m, 1 - m))
        g = by.groupBy("gene_id").agg(F.sum(ll).alias("l1"), F.sum("s").alias("s"))
        mean = F.col("s") / n
        return g.select("gene_id", F.greatest(F.lit(0.0), 2 * (F.col("l1") - n * (xlogy(mean, mean) + xlogy(1 - mean, 1 - mean)))).alias("lr"))
    if cs.family is Family.GAUSSIAN:
        g = by.groupBy("gene_id").agg(F.sum("ss").alias("ss"), F.sum("s").alias("s"), F.sum(F.col("n") * m * m).alias("between"))
        rss0, rss1 = F.col("ss") - F.col("s") * F.col("s") / n, F.col("ss") - F.col("between")
        return g.where(rss1 > 1e-12).select("gene_id", F.greatest(F.lit(0.0), n * F.ln(rss0 / rss1)).alias("lr"))
    raise ValueError(f"no closed form for {cs.family.value}")


def differential_test(cs: CountSet, factor: str, hints: DataFrame | None = None) -> DataFrame:
    """(gene_id, status, family, lr, pval, qval) for every gene; without a fit FAIL with p and q of 1.

    Cells without a level are an error, as in the regressions: drop them first.
    """
    (levels,) = refuse_missing(cs.cells, [factor], F.count_distinct(factor))
    lr = likelihood_ratio(cs, factor, hints).withColumn("pval", chi2_tail(F.col("lr"), max(1, levels - 1)))
    rows = cs.genes.select("gene_id").join(lr, "gene_id", "left")
    ok = F.col("lr").isNotNull()
    rows = rows.select("gene_id", F.when(ok, "OK").otherwise("FAIL").alias("status"), F.lit(cs.family.value).alias("family"), "lr", F.coalesce("pval", F.lit(1.0)).alias("pval"))
    return bh_adjust(rows, where=F.col("status") == "OK")


def compare_models(full: DataFrame, reduced: DataFrame) -> DataFrame:
    """Likelihood-ratio tests of two tables (gene_id, loglik, df); here the correction runs over all rows, failed ones included."""
    r = reduced.select("gene_id", F.col("loglik").alias("l0"), F.col("df").alias("d0"))
    rows = full.select("gene_id", "loglik", "df").join(r, "gene_id", "left")
    gap = [x["d"] for x in rows.select((F.col("df") - F.col("d0")).alias("d")).distinct().collect() if x["d"]]  # a handful of model sizes
    stat = F.greatest(F.lit(0.0), 2 * (F.col("loglik") - F.col("l0")))
    p = F.coalesce(*[F.when(F.col("df") - F.col("d0") == d, chi2_tail(stat, int(d))) for d in gap], F.lit(1.0))
    rows = rows.select("gene_id", F.when(F.col("loglik").isNotNull() & F.col("l0").isNotNull(), "OK").otherwise("FAIL").alias("status"), p.alias("pval"))
    return bh_adjust(rows)


# Formulas -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    """A product of variables; a variable is (name, spline degrees of freedom or 0)."""

    factors: tuple[tuple[str, int], ...]


SPLINE = re.compile(r"(?:sm\.)?(?:ns|bs)\(\s*(\w+)\s*(?:,\s*df\s*=\s*(\d+)\s*)?\)|VGAM::bs\(\s*(\w+)\s*\)")


def parse_formula(text: str) -> list[Term]:
    """Terms of ``~ 1``, ``~ A + B``, ``~ A * B``, ``~ sm.ns(x, df = 3) * B``."""
    body = text.strip().removeprefix("~").strip()
    splines: list[tuple[str, int]] = []

    def hold(m: re.Match) -> str:
        splines.append((m[1] or m[3], int(m[2] or 3)))
        return f"__s{len(splines) - 1}"

    body = SPLINE.sub(hold, body)
    of = lambda name: splines[int(name[3:])] if name.startswith("__s") else (name, 0)
    terms: dict[Term, None] = {}
    for part in body.split("+"):
        names = [n.strip() for n in re.split(r"[*:]", part)]
        if names in (["1"], ["0"], [""]):
            continue
        if not all(re.fullmatch(r"\w+", n) for n in names):
            raise ValueError(f"unknown term {part.strip()!r} in formula {text!r}")
        if "*" in part:
            for n in names:
                terms[Term((of(n),))] = None
        terms[Term(tuple(map(of, names)))] = None
    return list(terms)


def variables(*formulas: str) -> list[str]:
    return list(dict.fromkeys(v for f in formulas for t in parse_formula(f) for v, _ in t.factors))


def natural_spline(x: np.ndarray, df: int, knots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A natural cubic basis without intercept with ``df`` columns and its knots (boundary ones at the range)."""
    if knots is None:
        knots = np.unique(np.quantile(x, np.linspace(0, 1, df + 1)))
    k = len(knots)
    if k < 3:
        return x[:, None].astype(float), knots
    span = knots[-1] - knots[0]
    cube = lambda t: np.maximum(0, (x - t) / span) ** 3
    d = [(cube(knots[i]) - cube(knots[-1])) / ((knots[-1] - knots[i]) / span) for i in range(k - 1)]
    return np.column_stack([(x - knots[0]) / span] + [d[i] - d[k - 2] for i in range(k - 2)]), knots


@dataclass
class Design:
    """The design matrix of a formula over cells; remembers levels and knots for prediction."""

    terms: list[Term]
    levels: dict[str, list]
    knots: dict[str, np.ndarray]

    @classmethod
    def of(cls, formula: str, cells: pd.DataFrame) -> Design:
        terms, levels, knots = parse_formula(formula), {}, {}
        for t in terms:
            for v, df in t.factors:
                if df:
                    knots[v] = natural_spline(cells[v].to_numpy(float), df)[1]
                elif not pd.api.types.is_numeric_dtype(cells[v]) or pd.api.types.is_bool_dtype(cells[v]):
                    levels[v] = sorted(cells[v].unique())
        return cls(terms, levels, knots)

    def matrix(self, cells: pd.DataFrame) -> np.ndarray:
        columns = [np.ones(len(cells))]
        for t in self.terms:
            part = np.ones((len(cells), 1))
            for v, df in t.factors:
                if df:
                    b = natural_spline(cells[v].to_numpy(float), df, self.knots[v])[0]
                elif v in self.levels:
                    b = np.column_stack([(cells[v] == x).to_numpy(float) for x in self.levels[v][1:]]) if len(self.levels[v]) > 1 else np.zeros((len(cells), 0))
                else:
                    b = cells[v].to_numpy(float)[:, None]
                part = (part[:, :, None] * b[:, None, :]).reshape(len(cells), -1)
            columns += list(part.T)
        return np.column_stack(columns)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) of each distinct value once."""
    values, at = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in values])[at]


def log_likelihood(family: str, y: np.ndarray, mu: np.ndarray, size: float = 1.0) -> float:
    """Up to terms that depend on the responses alone.  Sizes that are fitted differ between models, so their terms belong to it."""
    mu = np.maximum(mu, 1e-12)
    if family in (Family.NB_SIZE.value, Family.NB.value):
        free = float(np.sum(log_gamma(y + size))) - len(y) * math.lgamma(size) if family == Family.NB.value else 0.0
        return float(np.sum(y * np.log(mu) - (y + size) * np.log(mu + size)) + len(y) * size * math.log(size)) + free
    if family == Family.BINOMIAL.value:
        m = np.clip(mu, 1e-12, 1 - 1e-12)
        return float(np.sum(y * np.log(m) + (1 - y) * np.log(1 - m)))
    rss = float(np.sum((y - mu) ** 2)) / len(y)
    return -0.5 * len(y) * (math.log(2 * math.pi * max(rss, 1e-300)) + 1)


def regress(x: np.ndarray, y: np.ndarray, family: str, size: float = 1.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Coefficients and log-likelihood by iteratively reweighted least squares (least squares for gaussian responses)."""
    counts = family in (Family.NB_SIZE.value, Family.NB.value)
    if not counts and family != Family.BINOMIAL.value:
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        return b, log_likelihood(family, y, x @ b)
    mu = np.maximum(y, 0) + 0.1 if counts else (y + 0.5) / 2
    eta = np.log(mu) if counts else np.log(mu / (1 - mu))
    best, b = -math.inf, np.zeros(x.shape[1])
    for _ in range(steps):
        if counts:
            w, z = mu / (1 + mu / size), eta + (y - mu) / mu
        else:
            w = np.maximum(mu * (1 - mu), 1e-10)
            z = eta + (y - mu) / w
        xw = x * w[:, None]
        b = np.linalg.lstsq(xw.T @ x, xw.T @ z, rcond=None)[0]
        eta = np.clip(x @ b, -30, 30)
        mu = np.exp(eta) if counts else 1 / (1 + np.exp(-eta))
        ll = log_likelihood(family, y, mu, size)
        if abs(ll - best) < 1e-10 * (1 + abs(ll)):
            break
        best = ll
    return b, ll


def _normal_tail(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the normal distribution function at u, and its slope."""
    deep = u < -30
    v = np.where(deep, -30.0, u)
    below = np.array([math.erfc(-a / math.sqrt(2)) / 2 for a in v])
    log_below = np.where(deep, -u * u / 2 - np.log(np.maximum(-u, 1) * math.sqrt(2 * math.pi)), np.log(below))
    slope = np.exp(-u * u / 2 - log_below) / math.sqrt(2 * math.pi)
    return log_below, slope


def censored(x: np.ndarray, y: np.ndarray, limit: float, steps: int = 100) -> tuple[np.ndarray, float, float]:
    """Coefficients, log-likelihood and deviation of a normal response that is only known to lie at or below ``limit`` where ``y`` does.

    Newton's method in coefficients over deviation and one over deviation, in which the likelihood is concave.
    """
    low = y <= limit
    free_x, free_y, low_x = x[~low], y[~low], x[low]
    d = x.shape[1]
    b = np.linalg.lstsq(x, np.where(low, limit, y), rcond=None)[0]
    scale = max(float(np.std(np.where(low, limit, y) - x @ b)), 1e-3)
    at = np.append(b / scale, 1 / scale)

    def value(a: np.ndarray) -> float:
        if a[d] <= 0:
            return -math.inf
        r = a[d] * free_y - free_x @ a[:d]
        return float(len(free_y) * (math.log(a[d]) - 0.5 * math.log(2 * math.pi)) - 0.5 * (r @ r) + _normal_tail(a[d] * limit - low_x @ a[:d])[0].sum())

    best = value(at)
    for _ in range(steps):
        r, u = at[d] * free_y - free_x @ at[:d], at[d] * limit - low_x @ at[:d]
        slope = _normal_tail(u)[1]
        bend = -slope * (u + slope)
        first = np.append(free_x.T @ r - low_x.T @ slope, len(free_y) / at[d] - r @ free_y + limit * slope.sum())
        cross = free_x.T @ free_y - limit * (low_x.T @ bend)
        second = np.zeros((d + 1, d + 1))
        second[:d, :d] = -free_x.T @ free_x + (low_x * bend[:, None]).T @ low_x
        second[:d, d] = second[d, :d] = cross
        second[d, d] = -len(free_y) / at[d] ** 2 - free_y @ free_y + limit * limit * bend.sum()
        step = -np.linalg.lstsq(second, first, rcond=None)[0]
        size = 1.0
        while size > 1e-8 and not value(at + size * step) >= best:
            size /= 2
        new = value(at + size * step)
        if size <= 1e-8 or new - best < 1e-10 * (1 + abs(best)):
            break
        at, best = at + size * step, new
    return at[:d] / at[d], best, 1 / at[d]


def free_size(x: np.ndarray, y: np.ndarray) -> float:
    """Negative binomial size that maximises the profile likelihood, by golden section over its logarithm."""

    def at(logk: float) -> float:
        return regress(x, y, Family.NB.value, math.exp(logk))[1]

    low, high, g = math.log(1e-2), math.log(1e4), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = high - g * (high - low), low + g * (high - low)
        low, high = (low, d) if at(c) > at(d) else (c, high)
    return math.exp((low + high) / 2)


#: Cells whose attributes are broadcast to the fits (under 100 bytes each for a few model terms).
DESIGN_CELLS = 5_000_000
FITS = "gene_id {kind}, status string, family string, coef array<double>, loglik double, df int, size double"


def _covariates(cs: CountSet, names: list[str]) -> pd.DataFrame:
    """Cell attributes of the model terms on the driver: one row of a few numbers a cell, as every fit needs the whole design.

    More than ``DESIGN_CELLS`` cells are an error: use a factor (closed form, any number of cells) or bins of the covariates.
    """
    (n,) = refuse_missing(cs.cells, names, F.count("*"))
    if n > DESIGN_CELLS:
        raise ValueError(f"{n} cells: regressions by gene take {DESIGN_CELLS} at most; use a factor or bin the covariates")
    wanted = ["cell_id", *names, *(["size_factor"] if "size_factor" in cs.cells.columns else [])]
    cells = cs.cells.select(*wanted).toPandas().sort_values("cell_id", ignore_index=True)
    if cs.family.counts and ("size_factor" not in cells or cells["size_factor"].isna().any()):
        raise ValueError(NO_SIZE_FACTORS)
    return cells


def apply_by_gene(cs: CountSet, fn, schema: str, names: list[str], cells: pd.DataFrame | None = None) -> DataFrame:
    """``fn(gene_id, y, cells)`` for every gene with a value: y has the zeros filled in, cells the named attributes."""
    if cells is None:
        cells = _covariates(cs.with_(family=Family.GAUSSIAN) if "size_factor" not in cs.cells.columns else cs, names)
    shared = cs.expr.sparkSession.sparkContext.broadcast(cells)
    kind = cs.expr.schema["gene_id"].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        c = shared.value
        y = np.zeros(len(c))
        at = np.searchsorted(c["cell_id"].to_numpy(), rows["cell_id"].to_numpy())
        y[at] = rows["value"].to_numpy()
        return fn(key[0], y, c)

    return cs.expr.select("gene_id", "cell_id", "value").groupBy("gene_id").applyInPandas(run, schema.replace("{kind}", kind))


def fit_models(cs: CountSet, formula: str, curve: Curve | None = None, cells: pd.DataFrame | None = None) -> DataFrame:
    """One fit per gene: status, coefficients, log-likelihood, degrees of freedom.  ``cells`` are covariates that the caller has at hand."""
    names, family = variables(formula), cs.family.value
    cells = _covariates(cs, names) if cells is None else cells
    design = Design.of(formula, cells)
    limit = math.log10(cs.detection_limit)

    def run(gene, y: np.ndarray, cells: pd.DataFrame) -> pd.DataFrame:
        x, size, raw = design.matrix(cells), 1.0, y
        if family in (Family.NB_SIZE.value, Family.NB.value):
            mean = np.rint(raw).mean()
            y = np.rint(raw / cells["size_factor"].to_numpy())
            size = 1 / (curve.a + curve.e / mean) if curve and mean > 0 else 1.0
            if family == Family.NB.value:
                size = free_size(x, y)
        elif family == Family.TOBIT.value:
            y = np.log10(np.maximum(y, 10.0**limit))
        try:
            if family == Family.TOBIT.value:
                b, ll, size = censored(x, y, limit)
            else:
                b, ll = regress(x, y, family, size)
            ok = np.isfinite(ll) and np.isfinite(b).all()
        except np.linalg.LinAlgError:
            ok = False
        if not ok:
            return pd.DataFrame([(gene, "FAIL", family, None, None, None, None)], columns=["gene_id", "status", "family", "coef", "loglik", "df", "size"])
        return pd.DataFrame([(gene, "OK", family, b.tolist(), ll, int(np.linalg.matrix_rank(x)), size)], columns=["gene_id", "status", "family", "coef", "loglik", "df", "size"])

    return apply_by_gene(cs, run, FITS, names, cells)


def regression_test(cs: CountSet, full: str, reduced: str, curve: Curve | None = None) -> DataFrame:
    """Likelihood-ratio test of two formulas by gene, corrected over the genes that could be fitted."""
    cells = _covariates(cs, variables(full, reduced))
    a = fit_models(cs, full, curve, cells).where("status = 'OK'").select("gene_id", F.col("loglik").alias("l1"), F.col("df").alias("d1"))
    b = fit_models(cs, reduced, curve, cells).where("status = 'OK'").select("gene_id", F.col("loglik").alias("l0"), F.col("df").alias("d0"))
    gap = int(np.linalg.matrix_rank(Design.of(full, cells).matrix(cells)) - np.linalg.matrix_rank(Design.of(reduced, cells).matrix(cells)))
    lr = a.join(b, "gene_id").select("gene_id", F.greatest(F.lit(0.0), 2 * (F.col("l1") - F.col("l0"))).alias("lr"))
    rows = cs.genes.select("gene_id").join(lr, "gene_id", "left")
    rows = rows.select("gene_id", F.when(F.col("lr").isNotNull(), "OK").otherwise("FAIL").alias("status"), F.lit(cs.family.value).alias("family"), "lr", F.coalesce(chi2_tail(F.col("lr"), max(1, gap)), F.lit(1.0)).alias("pval"))
    return bh_adjust(rows, where=F.col("status") == "OK")


def predict(fits: DataFrame, rows: np.ndarray, family: Family) -> DataFrame:
    """(gene_id, grid_idx, value): fitted responses at the rows of a design matrix; null for genes whose fit failed."""
    grid = fits.sparkSession.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "grid_idx int, x array<double>")
    long = fits.select("gene_id", F.when(F.col("status") == "OK", F.col("coef")).alias("coef")).crossJoin(F.broadcast(grid))  # the caller's grid
    eta = F.aggregate(F.zip_with("coef", "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    value = F.exp(eta) if family.counts else 1 / (1 + F.exp(-eta)) if family is Family.BINOMIAL else F.pow(F.lit(10.0), eta) if family is Family.TOBIT else eta
    return long.select("gene_id", "grid_idx", value.alias("value"))


def smooth_curves(cs: CountSet, formula: str, grid: pd.DataFrame, curve: Curve | None = None) -> DataFrame:
    """Fit by gene and evaluate on the grid of covariates."""
    cells = _covariates(cs, variables(formula))
    return predict(fit_models(cs, formula, curve, cells), Design.of(formula, cells).matrix(grid), cs.family)


def fitted_values(cs: CountSet, formula: str, curve: Curve | None = None) -> DataFrame:
    """(gene_id, cell_id, value): fitted mean of every gene in every cell."""
    return residuals(cs, formula, curve, fitted=True)


def residuals(cs: CountSet, formula: str, curve: Curve | None = None, fitted: bool = False) -> DataFrame:
    """(gene_id, cell_id, value): response minus fitted mean, or the fitted mean."""
    names, family = variables(formula), cs.family.value
    covariates = _covariates(cs, names)
    design = Design.of(formula, covariates)
    limit = math.log10(cs.detection_limit)
    kind = cs.expr.schema["cell_id"].dataType.simpleString()

    def run(gene, y: np.ndarray, cells: pd.DataFrame) -> pd.DataFrame:
        x, size = design.matrix(cells), 1.0
        counts = family in (Family.NB_SIZE.value, Family.NB.value)
        if counts:
            mean = np.rint(y).mean()
            size = 1 / (curve.a + curve.e / mean) if curve and mean > 0 else 1.0
            y = np.rint(y / cells["size_factor"].to_numpy())
            size = free_size(x, y) if family == Family.NB.value else size
        elif family == Family.TOBIT.value:
            y = np.log10(np.maximum(y, 10.0**limit))
        b = censored(x, y, limit)[0] if family == Family.TOBIT.value else regress(x, y, family, size)[0]
        mu = np.exp(np.clip(x @ b, -30, 30)) if counts else 1 / (1 + np.exp(-x @ b)) if family == Family.BINOMIAL.value else x @ b
        return pd.DataFrame({"gene_id": gene, "cell_id": cells["cell_id"], "value": mu if fitted else y - mu})

    return apply_by_gene(cs, run, f"gene_id {{kind}}, cell_id {kind}, value double", names, covariates)


def level_count(cells: DataFrame, factor: str) -> Column:
    return cells.select(F.count_distinct(factor)).scalar()
