"""One query per operator over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import store
from ..dataset import CountSet, Family, family_facts, first_per, from_container, pick
from ..functions.stats import bh_adjust
from ..operators import branch, cluster, difftest, dispersion, graph, normalize, plotdata, qc, reduce, trajectory, typing
from ..operators.dispersion import Curve
from ..sources import tenx, views
from ..streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Dispersion coefficients of the oracle queries.
CURVE = Curve(0.1, 1.0)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def v1(spark: SparkSession, sf: str) -> CountSet:
    return views.parts_by_supplier(spark, sf)


def sized(spark: SparkSession, sf: str) -> CountSet:
    return normalize.with_size_factors(v1(spark, sf))


def leading(cs: CountSet, n: int) -> DataFrame:
    """A figure's panel: the n genes with the greatest totals."""
    return cs.expr.groupBy("gene_id").agg(F.sum("value").alias("t")).orderBy(F.col("t").desc(), "gene_id").limit(n).select("gene_id")


@query
def detect_genes(spark, sf):
    return qc.detect(v1(spark, sf), 20.0).genes.select("gene_id", "num_cells_expressed")


@query
def detect_cells(spark, sf):
    return qc.detect(v1(spark, sf), 20.0).cells.select("cell_id", "num_genes_expressed")


@query
def detect_genes_by_order(spark, sf):
    return qc.detect(views.parts_by_order(spark, sf)).genes.select("gene_id", "num_cells_expressed")


@query
def qc_filter_totals(spark, sf):
    return qc.qc_window(v1(spark, sf))


def _sizes(method: str) -> Query:
    def run(spark, sf):
        return normalize.size_factors(v1(spark, sf), method).select("cell_id", r("size_factor"))

    return run


for _name, _method in (("mgmt", normalize.METHODS[0]), ("gmt", normalize.METHODS[1]), ("weighted_median", normalize.METHODS[2]), ("median_geo", normalize.METHODS[3]), ("median", normalize.METHODS[4]), ("mode", normalize.METHODS[5])):
    QUERIES[f"size_factors_{_name}"] = _sizes(_method)


@query
def log_normalized(spark, sf):
    return normalize.normalize(sized(spark, sf), "log").select("gene_id", "cell_id", r("value"))


@query
def tfidf(spark, sf):
    return normalize.tfidf(views.tokens_by_document(spark, sf)).select("gene_id", "cell_id", r("value"))


@query
def vst_exprs(spark, sf):
    return normalize.vst(sized(spark, sf), CURVE.a, CURVE.e).select("gene_id", "cell_id", r("value"), r("baseline"))


@query
def row_scale_clip(spark, sf):
    return normalize.standardized(v1(spark, sf), 3.0).select("gene_id", "cell_id", r("value"), r("baseline"))


@query
def normalized_matrix(spark, sf):
    """What a reduction reads: variance-stabilised values of the ordering genes in all cells, zeros included."""
    cs = sized(spark, sf)
    cs = qc.ordering_filter(cs, cs.genes.where("size > 25"))
    values = normalize.normalize(cs, "vstExprs", coefficients=(CURVE.a, CURVE.e))
    base = normalize.baseline_of(cs.family, "vstExprs", coefficients=(CURVE.a, CURVE.e))
    return normalize.dense(cs.subset(genes=F.col("use_for_ordering")), values, base).select("gene_id", "cell_id", r("value"))


@query
def size_factors_mean_location(spark, sf):
    """Means in place of the medians of the weighted method."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    return normalize.size_factors(v1(spark, sf), normalize.METHODS[2], locfunc=mean).select("cell_id", r("size_factor"))


@query
def tpm(spark, sf):
    return normalize.per_million(v1(spark, sf)).select("gene_id", "cell_id", r("value"))


def _t(cs: CountSet) -> DataFrame:
    return cs.expr.groupBy("cell_id").agg(F.median("value").alias("t"))


@query
def census_num_genes(spark, sf):
    cs = v1(spark, sf)
    return normalize.census(cs, _t(cs)).select("cell_id", r("total_mrna"))


@query
def census_tpm_fraction(spark, sf):
    cs = v1(spark, sf)
    return normalize.census(cs, _t(cs), "tpm_fraction").select("cell_id", r("total_mrna"))


@query
def relative_to_absolute(spark, sf):
    cs = v1(spark, sf)
    return normalize.relative_to_absolute(cs, _t(cs)).select("gene_id", "cell_id", r("value"))


@query
def js_specificity(spark, sf):
    return typing.specificity(v1(spark, sf), "region").select("gene_id", "region", r("specificity"))


@query
def top_markers(spark, sf):
    s = typing.specificity(v1(spark, sf), "region").withColumn("specificity", F.round("specificity", 6))
    return typing.top_markers(s, 10, "region")


def hierarchy() -> typing.Hierarchy:
    h = typing.Hierarchy().add("A", lambda x: x[1] > 30).add("B", lambda x: x[2] > 30).add("A1", lambda x: x[3] > 20, "A")
    return h.add("A2", lambda x: x[4] > 20, "A").add("C", lambda x: (x[5] > 0) & (x[1] < 10))


@query
def classify_cells(spark, sf):
    return typing.classify(v1(spark, sf), hierarchy()).cells.select("cell_id", "CellType")


@query
def classify_cells_grouped(spark, sf):
    return typing.classify(v1(spark, sf), hierarchy(), ["nation"], frequency=0.2).cells.select("cell_id", "nation", "CellType")


@query
def ordering_filter(spark, sf):
    cs = v1(spark, sf)
    return qc.ordering_filter(cs, cs.genes.where("size > 25")).genes.select("gene_id", "use_for_ordering")


@query
def zero_variance_filter(spark, sf):
    return qc.varying(v1(spark, sf)).select("gene_id", r("mean"), r("sd"))


@query
def dispersion_moments(spark, sf):
    return dispersion.moments(sized(spark, sf)).select("gene_id", r("mu"), r("disp"))


@query
def dispersion_table(spark, sf):
    t = dispersion.dispersion_table(dispersion.moments(sized(spark, sf)), CURVE)
    return t.select("gene_id", r("mean_expression"), r("dispersion_fit"), r("dispersion_empirical"))


@query
def dispersion_selection(spark, sf):
    m = dispersion.moments(sized(spark, sf))
    return dispersion.select_genes(m, CURVE, 0.5, 1.0).select("gene_id", r("mean_expression"))


@query
def disp_hint(spark, sf):
    return dispersion.hints(v1(spark, sf), CURVE).select("gene_id", r("hint"))


@query
def dispersion_fit(spark, sf):
    c = dispersion.fit_curve(dispersion.moments(sized(spark, sf)))
    return spark.createDataFrame([(c.a, c.e)], "asympt_disp double, extra_pois double").select(r("asympt_disp"), r("extra_pois"))


def _de(df: DataFrame) -> DataFrame:
    return df.select("gene_id", "status", "family", (F.round("lr", 5) + F.lit(0.0)).alias("lr"), r("pval"), r("qval"))  # no minus zero


@query
def de_nb_region(spark, sf):
    cs = sized(spark, sf)
    return _de(difftest.differential_test(cs, "region", dispersion.hints(cs, CURVE)))


@query
def de_nb_status(spark, sf):
    cs = normalize.with_size_factors(views.parts_by_order(spark, sf))
    return _de(difftest.differential_test(cs, "status", dispersion.hints(cs, CURVE)))


@query
def de_nb_priority(spark, sf):
    cs = normalize.with_size_factors(views.parts_by_order(spark, sf))
    return _de(difftest.differential_test(cs, "priority", dispersion.hints(cs, CURVE)))


@query
def de_gaussian_region(spark, sf):
    return _de(difftest.differential_test(v1(spark, sf).with_(family=Family.GAUSSIAN), "region"))


def _present(spark, sf) -> CountSet:
    cs = views.tokens_by_document(spark, sf)
    return cs.with_(expr=cs.expr.withColumn("value", F.lit(1.0)))


@query
def de_binomial_quality(spark, sf):
    cs = _present(spark, sf)
    return _de(difftest.differential_test(cs.subset(cells=F.col("quality").isNotNull()), "quality"))


@query
def de_binomial_lang(spark, sf):
    return _de(difftest.differential_test(_present(spark, sf).subset(cells=F.col("lang").isNotNull()), "lang"))


@query
def bh_adjust_parts(spark, sf):
    p = views.table(spark, sf, "part").select(F.col("p_partkey").alias("gene_id"), ((F.col("p_partkey") * 7919 % 10007) / 10007.0).alias("pval"))
    return bh_adjust(p).select("gene_id", r("pval"), r("qval"))


@query
def batch_residuals(spark, sf):
    return normalize.batch_residuals(v1(spark, sf), "region").select("gene_id", "cell_id", r("value"), r("baseline"))


@query
def batch_baseline(spark, sf):
    return normalize.batch_baseline(v1(spark, sf), "region").select("gene_id", "region", r("baseline"))


@query
def family_inference(spark, sf):
    a = family_facts(v1(spark, sf).expr).withColumn("view", F.lit("quantity"))
    b = family_facts(views.table(spark, sf, "supplier").select(F.col("s_acctbal").alias("value"))).withColumn("view", F.lit("balance"))
    return a.unionByName(b)


@query
def knn_k5(spark, sf):
    return graph.neighbours(views.points(spark, sf), 5).select("id", "neighbour", F.col("turn").cast("long").alias("turn"), r("d"))


@query
def jaccard_weights(spark, sf):
    return graph.jaccard(graph.neighbours(views.points(spark, sf), 5)).select("id", "neighbour", r("weight"))


@query
def density_rho_delta(spark, sf):
    return cluster.density(views.points(spark, sf), 8.0).select("id", r("rho", 5), r("delta"), "higher")


@query
def density_peaks_assign(spark, sf):
    return cluster.assign(cluster.peaks(cluster.density(views.points(spark, sf), 8.0), num_clusters=8))


def label_centers(spark, sf) -> DataFrame:
    """Mean vector by label."""
    p = views.points(spark, sf).select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    return p.groupBy(F.col("label").cast("long").alias("vertex")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("y"))


@query
def nearest_center(spark, sf):
    return graph.nearest_vertex(views.points(spark, sf), label_centers(spark, sf)).select("id", "vertex", r("d"))


@query
def project_to_segment(spark, sf):
    c = label_centers(spark, sf)
    a, b = c.where("vertex = 0").select(F.col("y").alias("a")), c.where("vertex = 1").select(F.col("y").alias("b"))
    segment = F.broadcast(a.crossJoin(b).withColumn("key", F.lit(1)))  # one row
    return graph.project(views.points(spark, sf).withColumn("key", F.lit(1)), segment).select("id", r("t"), r("d"))


@query
def pairwise_corr_distance(spark, sf):
    cs = v1(spark, sf)
    return cluster.correlation_distance(cs.expr, cs.genes, cs.n_cells()).select("a", "b", r("d"))


@query
def tree_pseudotime(spark, sf):
    return trajectory.tree_pseudotime(views.tree(spark, sf), 1).select("vertex", r("pseudotime"), "depth")


@query
def tree_branch_points(spark, sf):
    return trajectory.degrees(views.tree(spark, sf))


def branch_cells(spark, sf) -> DataFrame:
    ev = views.events(spark, sf)
    return ev.select("cell_id", "branch", "pseudotime", (F.col("pseudotime") < 30).alias("progenitor"))


@query
def branch_stretch(spark, sf):
    cells = branch_cells(spark, sf).withColumn("pseudotime", F.col("pseudotime") * (1 - 0.2 * F.col("branch")))
    return branch.stretch(cells).select("cell_id", "branch", r("pseudotime"))


@query
def sequential_split(spark, sf):
    return branch.sequential_split(branch_cells(spark, sf)).select("cell_id", "original_cell_id", F.col("branch").cast("long").alias("branch"))


@query
def progenitor_duplicate(spark, sf):
    return branch.duplicate(branch_cells(spark, sf)).select("cell_id", "original_cell_id", F.col("branch").cast("long").alias("branch"))


def curves(spark, sf) -> DataFrame:
    return branch.curves_of(views.events(spark, sf), F.col("pseudotime"), 50)


@query
def abc_area(spark, sf):
    return branch.area_between(curves(spark, sf), 2.0).withColumn("abc", F.round("abc", 2))


@query
def ilr_clip(spark, sf):
    return branch.log_ratio(curves(spark, sf)).select("gene_id", F.col("grid_idx").cast("long").alias("grid_idx"), r("ilr"))


@query
def branch_divergence(spark, sf):
    return branch.divergence(branch.log_ratio(curves(spark, sf))).select("gene_id", r("divergence"))


@query
def bifurcation_point(spark, sf):
    return branch.bifurcation_point(branch.log_ratio(curves(spark, sf))).select("gene_id", F.col("point").cast("double").alias("point"))


@query
def positive_cells(spark, sf):
    cs = sized(spark, sf)
    return plotdata.positive_cells(cs, cs.genes, "region", 20.0).select("gene_id", "region", "target", r("percent"))


@query
def jitter_data(spark, sf):
    cs = sized(spark, sf)
    return plotdata.expression(cs, cs.genes, 0.1, True).select("gene_id", "cell_id", "region", r("expression"))


@query
def violin_data(spark, sf):
    cs = sized(spark, sf)
    return plotdata.expression(cs, cs.genes, 0.1, False).select("gene_id", "cell_id", r("expression"))


@query
def jitter_mean(spark, sf):
    cs = sized(spark, sf)
    return plotdata.mean_by_group(cs, cs.genes, "region").select("gene_id", "region", r("mean"), r("low"), r("high"))


@query
def bootstrap_interval(spark, sf):
    cs = sized(spark, sf)
    return plotdata.bootstrap_interval(plotdata.expression(cs, leading(cs, 20), 0.1, True), ["gene_id", "region"])


@query
def coexpression_pairs(spark, sf):
    cs = v1(spark, sf)
    return plotdata.coexpression(cs, leading(cs, 10), leading(cs, 30))


def tree_coords(spark, sf) -> DataFrame:
    return views.table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("vertex"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))


@query
def trajectory_edges(spark, sf):
    return plotdata.trajectory_edges(views.tree(spark, sf), tree_coords(spark, sf)).select("parent", "child", "weight", "x1", "y1", "x2", "y2")


@query
def full_outer_edges(spark, sf):
    return plotdata.tree_edges_full(views.tree(spark, sf), tree_coords(spark, sf)).select("parent", "child", "x", "y")


@query
def branch_minmax_pseudotime(spark, sf):
    return plotdata.unit_pseudotime(branch_cells(spark, sf)).select("cell_id", "branch", r("pseudotime"))


@query
def rotate_coords(spark, sf):
    x, y = plotdata.rotation(F.get("x", F.lit(0)), F.get("x", F.lit(1)), 30.0)
    return views.points(spark, sf).select("id", F.round(x, 6).alias("rx"), F.round(y, 6).alias("ry"))


@query
def heat_matrix(spark, sf):
    c = curves(spark, sf).select("gene_id", "grid_idx", F.col("a").alias("value"))
    return plotdata.heat_matrix(c).select("gene_id", F.col("grid_idx").cast("long").alias("grid_idx"), r("z"))


@query
def branched_heat_matrix(spark, sf):
    c = curves(spark, sf)
    m = plotdata.branched_heat_matrix(c.select("gene_id", "grid_idx", F.col("a").alias("value")), c.select("gene_id", "grid_idx", F.col("b").alias("value")), 50)
    return m.select("gene_id", F.col("grid_idx").cast("long").alias("grid_idx"), r("z"))


@query
def pseudotime_moving_mean(spark, sf):
    return plotdata.moving_mean(views.events(spark, sf)).select("gene_id", "cell_id", r("smooth", 8))


@query
def value_quantiles(spark, sf):
    cs = v1(spark, sf)
    return cs.expr.groupBy("gene_id").agg(*[F.round(F.percentile("value", q), 6).alias(f"q{round(100 * q)}") for q in (0.05, 0.25, 0.5, 0.95)])


@query
def first_gene_per_type(spark, sf):
    return first_per(views.parts(spark, sf), "type", "size", "gene_id").select("type", "gene_id", "size")


@query
def picked_genes(spark, sf):
    return pick(views.parts(spark, sf), "gene_id", [7, 3, 3, 100, -1]).select("position", "gene_id", "brand")


@query
def genes_in_pseudotime(spark, sf):
    """Observed expression beside what an observation of the group's mean would be."""
    cs = sized(spark, sf)
    genes = cs.genes.where("size > 45")
    expected = plotdata.mean_by_group(cs, genes, "region").select("gene_id", "region", F.col("mean").alias("expectation"))
    return plotdata.in_pseudotime(cs, genes, expected, 0.1).select("gene_id", "cell_id", r("expression"), r("expectation"))


@query
def cell_clusters_plot(spark, sf):
    cs = v1(spark, sf)
    coords = cs.cells.select("cell_id", F.col("acctbal").alias("x"), (F.col("cell_id") % 7).cast("double").alias("y"))
    markers = cs.expr.join(leading(cs, 5), "gene_id", "left_semi")
    return plotdata.cell_clusters(coords, cs.cells.select("cell_id", "region"), markers).select("cell_id", "x", "y", "region", "gene_id", r("log_value"))


@query
def classify_cells_enriched(spark, sf):
    """A type where at least as many of a group's cells pass as 1.2 times its share of all cells."""
    return typing.classify(v1(spark, sf), hierarchy(), ["nation"], enrichment=1.2).cells.select("cell_id", "nation", "CellType")


@query
def container_import(spark, sf):
    """Logged values of cells of which the metadata has only those of one region, taken back."""
    cs = v1(spark, sf)
    logged = cs.expr.withColumn("value", F.log2(F.col("value") + 1))
    got = from_container(logged, cs.cells.where("region = 'ASIA'"), logged=True)
    return got.expr.select("gene_id", "cell_id", r("value"))


def _shared(spark: SparkSession) -> str:
    return f"{store.shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query
def matrix_directory_roundtrip(spark, sf):
    """A count set written as the matrix directory of a droplet pipeline, compressed and in the newer layout, and loaded again."""
    cs, path = v1(spark, sf), _shared(spark)
    tenx.write_directory(cs.with_genes(cs.genes.select("gene_id")), path)
    got = tenx.load(spark, path)
    return got.expr.select(F.col("gene_id").cast("long").alias("gene_id"), F.col("cell_id").cast("long").alias("cell_id"), "value")


@query
def sheet_roundtrip(spark, sf):
    path = _shared(spark)
    tenx.write_sheet(v1(spark, sf).cells, path)
    got = tenx.read_sheet(spark, path, "cell_id")
    return got.select(F.col("cell_id").cast("long").alias("cell_id"), "region", "nation", F.col("acctbal").cast("double").alias("acctbal"))


@query
def logged_export_roundtrip(spark, sf):
    cs, path = v1(spark, sf), _shared(spark)
    tenx.write(cs, path, logged=True)
    return tenx.read(spark, path, logged=True).expr.select("gene_id", "cell_id", r("value"))


@query
def spike_in_molecules(spark, sf):
    """Molecules of a kit whose concentrations are those of the parts' sizes."""
    return views.parts(spark, sf).select("gene_id", F.round(normalize.spike_scale(F.col("size").cast("double"), 10.0, 40000.0), 6).alias("molecules"))


@query
def calibration_lines(spark, sf):
    """Each cell's line through its typical value and the kit's line, and its values along it."""
    cs = v1(spark, sf)
    k, b = normalize.calibration_line(F.col("t"), 10.0, -3.65, 2.3)
    rows = cs.expr.join(_t(cs), "cell_id").withColumns({"k": k, "b": b})
    return rows.select("gene_id", "cell_id", r("k"), r("b"), F.round(normalize.along_line(F.col("value"), F.col("k"), F.col("b")), 4).alias("value"))


@query
def marker_test(spark, sf):
    """Types by cell, then the test of the type."""
    types = typing.Hierarchy().add("A", lambda x: x[1] > 0).add("B", lambda x: x[2] > 0)
    return _de(typing.marker_test(sized(spark, sf), types, CURVE))


@query
def compare_models(spark, sf):
    """The likelihoods of two nested gaussian models by closed form, handed over as tables."""
    cs = v1(spark, sf).with_(family=Family.GAUSSIAN)
    lr = difftest.likelihood_ratio(cs, "region")
    full, reduced = lr.select("gene_id", (F.col("lr") / 2).alias("loglik"), F.lit(5).alias("df")), lr.select("gene_id", F.lit(0.0).alias("loglik"), F.lit(1).alias("df"))
    return difftest.compare_models(full, reduced).select("gene_id", "status", r("pval"), r("qval"))


@query
def rho_delta_plot(spark, sf):
    d = cluster.density(views.points(spark, sf), 8.0)
    return plotdata.rho_delta(d, 1.0, 8.0).select("id", r("rho", 5), r("delta"), "peak")


@query
def ordering_genes_plot(spark, sf):
    cs = sized(spark, sf)
    marked = qc.ordering_filter(cs, cs.genes.where("size > 25")).genes
    return plotdata.ordering_genes(dispersion.dispersion_table(dispersion.moments(cs), CURVE), marked).select("gene_id", r("mean_expression"), "use_for_ordering")


@query
def melt_dcast_roundtrip(spark, sf):
    cs = v1(spark, sf)
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = cs.expr.join(cs.cells.select("cell_id", "region"), "cell_id").groupBy("gene_id").pivot("region", regions).sum("value")
    return wide.unpivot(["gene_id"], regions, "region", "value").where("value is not null")


@query
def contingency_fraction(spark, sf):
    cells = v1(spark, sf).cells
    g = cells.groupBy("region", "nation").agg(F.count("*").alias("n"))
    return g.select("region", "nation", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy("region")), 6).alias("share"))


@query
def subset_genes_cells(spark, sf):
    return v1(spark, sf).subset(genes=F.col("brand") == "Brand#11", cells=F.col("region") == "ASIA").expr


@query
def set_operations(spark, sf):
    g = views.parts(spark, sf)
    a, b = g.where("size < 20").select("brand", "type"), g.where("size >= 15").select("brand", "type")
    tag = lambda df, t: df.withColumn("op", F.lit(t))
    return tag(a.union(b).distinct(), "union").union(tag(a.intersect(b), "intersect")).union(tag(a.exceptAll(b).distinct(), "setdiff"))


@query
def export_logged(spark, sf):
    return v1(spark, sf).expr.select("gene_id", "cell_id", F.round(F.log2(F.col("value") + 1), 6).alias("value"))


@query
def event_windows(spark, sf):
    return incremental.windowed_totals(views.table(spark, sf, "events")).select("start", "gene_id", "n", r("total", 4))


@query
def ecdf_at(spark, sf):
    cs = v1(spark, sf)
    return cs.expr.join(_t(cs), "cell_id").groupBy("cell_id").agg(F.round(F.avg((F.col("value") <= F.col("t")).cast("double")), 6).alias("share"))


# Without an oracle ----------------------------------------------------------------------------------------------------


@query
def balanced_downsample(spark, sf):
    return typing.balanced(v1(spark, sf), "region").cells.select("cell_id", "region")


def _event_set(spark, sf) -> CountSet:
    """Daily buckets of events as cells along pseudotime."""
    ev = views.events(spark, sf).withColumn("bucket", F.floor("pseudotime").cast("long") * 2 + F.col("branch"))
    expr = ev.groupBy("gene_id", F.col("bucket").alias("cell_id")).agg(F.sum("value").alias("value"))
    cells = ev.groupBy(F.col("bucket").alias("cell_id")).agg(F.avg("pseudotime").alias("Pseudotime"), F.first(F.col("branch").cast("string")).alias("Branch"))
    return normalize.with_size_factors(CountSet(expr, cells, expr.select("gene_id").distinct()))


@query
def spline_de(spark, sf):
    return difftest.regression_test(_event_set(spark, sf), "~sm.ns(Pseudotime, df=3)", "~1", CURVE)


def _event_tree(spark, sf) -> tuple[CountSet, DataFrame, dict, int]:
    """The event set on a principal tree: vertices 0 to 2 up to pseudotime 30, then 10 to 16 and 20 to 26 by branch."""
    cs = _event_set(spark, sf)
    place = F.least(F.floor(F.col("Pseudotime") / 10), F.lit(9)).cast("long")
    vertex = F.when(place < 3, place).otherwise(place - 3 + F.when(F.col("Branch") == "0", 10).otherwise(20))
    cells = cs.cells.select("cell_id", F.col("Pseudotime").alias("pseudotime"), vertex.alias("vertex"))
    edges = [(0, 1, 1.0), (1, 2, 1.0), (2, 10, 1.0), (2, 20, 1.0), *((10 * k + i, 10 * k + i + 1, 1.0) for k in (1, 2) for i in range(6))]
    return cs, cells, graph.adjacency(edges), 0


def _branches(spark, sf) -> tuple[CountSet, DataFrame]:
    cs, cells, tree, root = _event_tree(spark, sf)
    return cs, branch.branch_cells(cells, tree, root, branch_point=2)


@query
def branch_data_set(spark, sf):
    """The cells of both branches of the tree, progenitors dealt to them, pseudotime stretched."""
    cs, cells = _branches(spark, sf)
    return branch.branch_set(cs, cells).cells.select("cell_id", "original_cell_id", "branch", r("pseudotime"))


@query
def beam(spark, sf):
    cs, cells = _branches(spark, sf)
    return branch.beam(cs, cells, curve=CURVE)


@query
def abc_fitted(spark, sf):
    cs, cells = _branches(spark, sf)
    return branch.areas(cs, cells, 5000, curve=CURVE)


@query
def ilr_fitted(spark, sf):
    cs, cells = _branches(spark, sf)
    return branch.log_ratios(cs, cells, curve=CURVE)


@query
def ilr_stabilized(spark, sf):
    cs, cells = _branches(spark, sf)
    return branch.log_ratios(cs, cells, variance_stabilized=True, curve=CURVE)


@query
def divergences_fitted(spark, sf):
    cs, cells = _branches(spark, sf)
    return branch.divergences(branch.fitted_curves(cs, cells, curve=CURVE))


@query
def bifurcation_fitted(spark, sf):
    cs, cells = _branches(spark, sf)
    ilr = branch.log_ratios(cs, cells, curve=CURVE)
    return branch.bifurcation_point(ilr).join(branch.bifurcation_point(ilr, cross_only=False).withColumnRenamed("point", "above"), "gene_id")


@query
def branched_pseudotime(spark, sf):
    cs, cells = _branches(spark, sf)
    return plotdata.branched_in_pseudotime(cs, cs.genes, cells, CURVE)


def _paths(cs: CountSet) -> tuple[CountSet, dict[str, list]]:
    state = F.when(F.col("Pseudotime") < 30, 1).when(F.col("Branch") == "0", 2).otherwise(3)
    return cs.with_(cells=cs.cells.withColumn("State", state)), {"first": [1, 2], "second": [1, 3]}


@query
def pseudotime_heatmap(spark, sf):
    return plotdata.pseudotime_heatmap(_event_set(spark, sf), CURVE, clusters=3)


@query
def branches_heatmap(spark, sf):
    cs, paths = _paths(_event_set(spark, sf))
    return plotdata.branches_heatmap(cs, paths, CURVE, clusters=3)


@query
def branches_lowess(spark, sf):
    cs, paths = _paths(_event_set(spark, sf))
    return plotdata.branches_in_pseudotime(cs, cs.genes, paths)


@query
def pseudotime_lowess(spark, sf):
    return plotdata.lowess(views.events(spark, sf))


@query
def tobit_test(spark, sf):
    """Totals by bucket as censored responses."""
    cs = _event_set(spark, sf).with_(family=Family.TOBIT, detection_limit=1.0)
    return difftest.regression_test(cs, "~sm.ns(Pseudotime, df=3)", "~1")


@query
def free_size_test(spark, sf):
    return difftest.regression_test(_event_set(spark, sf).with_(family=Family.NB), "~Branch", "~1")


@query
def model_residuals(spark, sf):
    return normalize.model_residuals(_event_set(spark, sf), "~Branch + Pseudotime")


def _clustered(method: str, **more) -> Query:
    def run(spark, sf):
        points = views.points(spark, sf).select("id", "x", "label")
        if method == "DDRTree":
            points = reduce.scores(points, 10)
        cells = points.select(F.col("id").alias("cell_id"))
        empty = spark.createDataFrame([], "gene_id long, cell_id long, value double")
        cs = CountSet(empty, cells, empty.select("gene_id").distinct())
        return cluster.cluster_cells(cs, points, method, **more).cells

    return run


QUERIES["cluster_cells_density"] = _clustered("densityPeak", num_clusters=8)
QUERIES["cluster_cells_louvain"] = _clustered("louvain", k=10)
QUERIES["cluster_cells_tree"] = _clustered("DDRTree", num_clusters=8)


@query
def spike_in_lines(spark, sf):
    """Lines of each supplier through the parts that serve as a kit: the smallest ones, with concentrations by size."""
    cs = v1(spark, sf)
    kit = cs.genes.orderBy("size", "gene_id").limit(92).select("gene_id", (F.col("size") * F.lit(10.0)).alias("concentration"))
    return normalize.spike_in_lines(cs, kit, 10.0, 40000.0)


@query
def uncentred_scores(spark, sf):
    return reduce.uncentred_scores(views.points(spark, sf), 5)


@query
def scaled_tree_pseudotime(spark, sf):
    """Every leaf of a small tree at 100."""
    _, _, tree, root = _event_tree(spark, sf)
    return spark.createDataFrame(sorted(trajectory.scale_pseudotime(trajectory.order(tree, root)).items()), "vertex long, pseudotime double")


@query
def subset_ordered(spark, sf):
    """The cells of one label ordered anew along a spanning tree of their own."""
    points = views.points(spark, sf)
    return trajectory.subset_ordered(spark, reduce.scores(points, 3), points.where("label = 1").select("id"))[0]


@query
def smooth_curves(spark, sf):
    grid = pd.DataFrame({"Pseudotime": np.linspace(0, 100, 50)})
    return difftest.smooth_curves(_event_set(spark, sf), "~sm.ns(Pseudotime, df=3)", grid, CURVE)


@query
def curve_residuals(spark, sf):
    return difftest.residuals(_event_set(spark, sf), "~sm.ns(Pseudotime, df=3)", CURVE)


@query
def pca_scores(spark, sf):
    return reduce.scores(views.points(spark, sf), 5)


@query
def pca_variance(spark, sf):
    v = reduce.variance_explained(views.points(spark, sf), 20)
    return spark.createDataFrame(list(enumerate(v, 1)), "component long, share double")


def _embedding(spark, sf) -> tuple[list, np.ndarray]:
    rows = reduce.scores(views.points(spark, sf), 10).orderBy("id").collect()  # reduced coordinates, as a tree or map of all points needs them together
    return [x["id"] for x in rows], np.array([x["x"] for x in rows]).T


@query
def ddrtree_order(spark, sf):
    ids, m = _embedding(spark, sf)
    fit = reduce.reduce(m)
    cells = spark.createDataFrame([(i, z) for i, z in zip(ids, fit["Z"].T.tolist())], "id long, x array<double>")
    return trajectory.order_cells(spark, cells, fit["Y"], fit["edges"])[0]


def _ordered(method: str, **more) -> Query:
    def run(spark, sf):
        ids, m = _embedding(spark, sf)
        return trajectory.order_reduced(spark, ids, reduce.reduce(m, 2, method), **more)

    return run


QUERIES["order_tree"] = _ordered("DDRTree")
QUERIES["order_ica"] = _ordered("ICA", num_paths=2)


@query
def tree_layout(spark, sf):
    """Places of the vertices of a small tree in a drawing, the root on top."""
    _, _, tree, root = _event_tree(spark, sf)
    parents = trajectory.order(tree, root).parent
    places = plotdata.layout([(p, v) for v, p in parents.items() if p is not None], root)
    return spark.createDataFrame([(v, x, y) for v, (x, y) in sorted(places.items())], "vertex long, x double, y double")


@query
def gene_clusters_plot(spark, sf):
    """Curves with the cluster of their gene."""
    curves = plotdata.pseudotime_heatmap(_event_set(spark, sf), CURVE)
    return plotdata.gene_clusters(curves, cluster.row_clusters(curves, 2))


def _coords(method: str) -> Query:
    def run(spark, sf):
        ids, m = _embedding(spark, sf)
        z = reduce.reduce(m, 2, method)["Z"]
        return spark.createDataFrame([(i, *p) for i, p in zip(ids, z.T.tolist())], "id long, x double, y double")

    return run


QUERIES["tsne"] = _coords("tSNE")
QUERIES["ica"] = _coords("ICA")


@query
def louvain(spark, sf):
    return cluster.louvain_clusters(views.points(spark, sf), 10)


def _gene_distances(spark, sf) -> tuple[list, np.ndarray]:
    cs = v1(spark, sf)
    rows = cluster.correlation_distance(cs.expr, leading(cs, 200), cs.n_cells()).toPandas()  # the pairs of a heat map's genes
    ids = sorted({*rows["a"], *rows["b"]})
    d, at = np.zeros((len(ids), len(ids))), {g: i for i, g in enumerate(ids)}
    i, j = rows["a"].map(at).to_numpy(), rows["b"].map(at).to_numpy()
    d[i, j] = d[j, i] = rows["d"]
    return ids, d


def _labels(make) -> Query:
    def run(spark, sf):
        ids, d = _gene_distances(spark, sf)
        return spark.createDataFrame([(i, int(c)) for i, c in zip(ids, make(d, min(4, len(ids))))], "gene_id long, cluster long")

    return run


QUERIES["pam"] = _labels(lambda d, k: cluster.medoids(d, k)[1])
QUERIES["hclust"] = _labels(cluster.ward)


@query
def mst_edges(spark, sf):
    edges = graph.neighbours(views.points(spark, sf), 10).select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), F.col("d").alias("weight"))
    return graph.boruvka(edges)


@query
def pq_lineages(spark, sf):
    ids, m = _embedding(spark, sf)
    d = graph.Distances(m[:2])
    return trajectory.lineage_order(graph.adjacency(graph.spanning_tree(d)), d, 2).table(spark)


@query
def kde_mode(spark, sf):
    return dispersion.most_frequent(v1(spark, sf))
