import gzip
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.dataset import CountSet, Family, from_container, from_tables, from_wide
from countloom.functions import stats
from countloom.operators import branch, cluster, difftest, dispersion, graph, normalize, plotdata, qc, reduce, trajectory, typing
from countloom.operators.dispersion import Curve
from countloom.sources import tenx


def counts(spark, values, **more):
    """A count set from {gene: [value by cell]}."""
    n = len(next(iter(values.values())))
    rows = [(g, f"c{i}", float(v)) for g, vs in values.items() for i, v in enumerate(vs) if v]
    cells = spark.createDataFrame([(f"c{i}", i % 2) for i in range(n)], "cell_id string, half int")
    genes = spark.createDataFrame([(g,) for g in values], "gene_id string")
    return CountSet(spark.createDataFrame(rows, "gene_id string, cell_id string, value double"), cells, genes, **more)


def test_zeros_count(spark):
    cs = counts(spark, {"a": [1, 2, 3, 0], "b": [0, 0, 0, 5], "none": [0, 0, 0, 0]})
    got = {r["gene_id"]: r["num_cells_expressed"] for r in qc.detect(cs, 1.0).genes.collect()}
    assert got == {"a": 2, "b": 1, "none": 0}
    assert {r["gene_id"]: r["num_cells_expressed"] for r in qc.detect(cs, -1.0).genes.collect()}["a"] == 4
    med = {r["gene_id"]: r["median"] for r in normalize.padded_median(cs.expr, "gene_id", cs.n_cells()).collect()}
    assert med == {"a": 1.5, "b": 0.0}


def test_half_even(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, 3.5)], "x double").select(stats.round_half_even(F.col("x"))).collect()]
    assert got == [0, 2, 2, 4]


def test_size_factors_have_geometric_mean_one_and_skip_empty_cells(spark):
    cs = counts(spark, {"a": [1, 2, 3, 0], "b": [4, 1, 9, 0]})
    f = {r["cell_id"]: r["size_factor"] for r in normalize.size_factors(cs).collect()}
    assert f["c3"] == 1.0
    assert math.isclose(sum(math.log(f[c]) for c in ("c0", "c1", "c2")), 0, abs_tol=1e-9)
    with pytest.raises(ValueError):
        normalize.size_factors(cs, "other")


def test_normalization_matrix(spark):
    cs = normalize.with_size_factors(counts(spark, {"a": [1, 2], "b": [3, 4]}))
    with pytest.raises(ValueError):
        normalize.normalize(cs.with_(family=Family.BINOMIAL), "log")
    with pytest.raises(ValueError):
        normalize.normalize(cs, "vstExprs")
    chosen = qc.ordering_filter(cs, cs.genes.where("gene_id = 'a'"))
    assert {r["gene_id"] for r in normalize.normalize(chosen, "log").collect()} == {"a"}


@pytest.mark.parametrize("df", [1, 2, 3, 4, 5, 8])
def test_chi2_tail(spark, df):
    xs = [0.0, 0.3, 1.0, 4.0, 11.0, 40.0]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(stats.chi2_tail(F.col("x"), df)).collect()]
    at = np.linspace(0, 1, 400_001)[1:]
    for x, p in zip(xs, got):
        # substitution u = x / t^2 over (x, inf)
        t = at
        u = x + (1 - t) / t
        density = u ** (df / 2 - 1) * np.exp(-u / 2) / (2 ** (df / 2) * math.gamma(df / 2)) / t**2
        if x > 0:
            assert math.isclose(p, float(np.trapezoid(density, t)), rel_tol=2e-3, abs_tol=1e-9)
        else:
            assert math.isclose(p, 1.0, abs_tol=1e-9)


def test_bh_replays_printed_values(spark):
    p = [4.505519e-92, 0.02, 0.5]
    got = stats.bh_adjust(spark.createDataFrame(list(enumerate(p)), "i int, pval double")).orderBy("i").collect()
    assert math.isclose(got[0]["qval"], 1.351656e-91, rel_tol=1e-6)
    assert math.isclose(got[1]["qval"], 0.03) and math.isclose(got[2]["qval"], 0.5)


def test_closed_form_equals_regression(spark):
    rng = np.random.default_rng(1)
    cs = counts(spark, {f"g{i}": rng.negative_binomial(2, 0.2, 24) for i in range(4)} | {"zero": [0] * 24})
    cs = normalize.with_size_factors(cs).with_cells(cs.cells.select("cell_id", (F.xxhash64("cell_id") % 3).cast("string").alias("kind")))
    curve = Curve(0.3, 1.0)
    a = difftest.differential_test(cs, "kind", dispersion.hints(cs, curve))
    b = difftest.regression_test(cs, "~kind", "~1", curve)
    rows = a.join(b.select("gene_id", F.col("lr").alias("lr2"), F.col("qval").alias("q2")), "gene_id").collect()
    assert len(rows) == 5
    for r in rows:
        if r["gene_id"] == "zero":
            assert r["status"] == "FAIL" and r["pval"] == 1.0
        else:
            assert math.isclose(r["lr"], r["lr2"], rel_tol=1e-5, abs_tol=1e-6) and math.isclose(r["qval"], r["q2"], rel_tol=1e-4)


def test_formulas():
    terms = difftest.parse_formula("~sm.ns(Pseudotime, df = 4)*Branch + Media")
    assert [t.factors for t in terms] == [(("Pseudotime", 4),), (("Branch", 0),), (("Pseudotime", 4), ("Branch", 0)), (("Media", 0),)]
    assert difftest.parse_formula("~1") == []
    assert difftest.variables("~VGAM::bs(t)", "~x") == ["t", "x"]
    with pytest.raises(ValueError):
        difftest.parse_formula("~log(x)")


def test_model_guards(spark):
    cs = counts(spark, {"a": [1, 2]})
    with pytest.raises(ValueError, match="null, NaN"):
        difftest.fit_models(cs.with_cells(spark.createDataFrame([("c0", 1.0), ("c1", float("nan"))], "cell_id string, t double")), "~t")
    with pytest.raises(ValueError, match="size factors"):
        difftest.fit_models(cs, "~half")


def test_curve_fit_recovers(spark):
    rng = np.random.default_rng(3)
    mu = np.exp(rng.uniform(-1, 4, 800))
    disp = (0.2 + 1.5 / mu) * rng.gamma(20, 1 / 20, 800)
    t = spark.createDataFrame([(i, float(m), float(d)) for i, (m, d) in enumerate(zip(mu, disp))], "gene_id int, mu double, disp double")
    c = dispersion.fit_curve(t)
    assert abs(c.a - 0.2) < 0.03 and abs(c.e - 1.5) < 0.1


def test_typing(spark):
    cs = counts(spark, {"m": [2, 0, 3, 0], "n": [0, 5, 4, 0]})
    h = typing.Hierarchy().add("M", lambda x: x["m"] >= 1).add("N", lambda x: x["n"] >= 1)
    got = {r["cell_id"]: r["CellType"] for r in typing.classify(cs, h).cells.collect()}
    assert got == {"c0": "M", "c1": "N", "c2": "Ambiguous", "c3": "Unknown"}
    with pytest.raises(ValueError, match="already exists"):
        h.add("M", lambda x: x["m"] > 0)
    with pytest.raises(ValueError, match="grouped mode"):
        typing.classify(cs, h, ["half"])
    with pytest.raises(TypeError):
        typing.classify(cs, None)
    grouped = {r["cell_id"]: r["CellType"] for r in typing.classify(cs, h, ["half"], frequency=0.6).cells.collect()}
    assert grouped == {"c0": "M", "c2": "M", "c1": "Unknown", "c3": "Unknown"}
    typed = typing.classify(cs, h)
    assert typing.without(typed).cells.count() == 2
    assert {r["n"] for r in typing.balanced(typed).cells.groupBy("CellType").agg(F.count("*").alias("n")).collect()} == {1}


def test_specificity_of_one_type_is_one(spark):
    cs = counts(spark, {"a": [1, 0, 1, 0], "b": [1, 1, 1, 1], "z": [0, 0, 0, 0]})
    got = {(r["gene_id"], r["half"]): r["specificity"] for r in typing.specificity(cs, "half").collect()}
    assert math.isclose(got["a", 0], 1.0) and math.isclose(got["a", 1], 1 - math.sqrt(math.log10(2)))
    assert math.isclose(got["b", 0], got["b", 1]) and got["z", 0] == 0


def test_spanning_trees_agree(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(25, 3))
    x[7] = x[3]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    prim = sum(w for *_, w in graph.spanning_tree(d))
    rows = [(i, j, float(d[i, j])) for i, j in itertools.combinations(range(25), 2)]
    big = graph.boruvka(spark.createDataFrame(rows, "src long, dst long, weight double")).collect()
    assert len(big) == 24 and math.isclose(sum(r["weight"] for r in big), prim)


def test_neighbours_and_communities(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.3, (15, 2)) for c in (0, 6)])
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {(r["id"], r["turn"]): r["neighbour"] for r in graph.neighbours(pts, 3).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert all(got[i, 1] == np.argsort(d[i])[1] for i in range(30))
    found = {r["id"]: r["cluster"] for r in cluster.louvain_clusters(pts, 8).collect()}
    assert not {found[i] for i in range(15)} & {found[i] for i in range(15, 30)}
    with pytest.raises(ValueError, match="smaller than the total"):
        graph.neighbours(pts, 29)


def test_clusters_of_small_matrices():
    x = np.array([0, 0.1, 0.2, 5, 5.1, 5.3])
    d = np.abs(x[:, None] - x)
    for labels in (cluster.medoids(d, 2)[1], cluster.ward(d, 2)):
        assert len(set(labels[:3])) == 1 and len(set(labels[3:])) == 1 and labels[0] != labels[3]


def y_shape():
    t = np.linspace(0, 1, 20)
    arms = [np.c_[np.zeros(20), -t], np.c_[t, t], np.c_[-t, t]]
    return np.vstack(arms).T + np.random.default_rng(0).normal(0, 0.01, (2, 60))


def test_principal_tree_and_order(spark):
    x = y_shape()
    fit = reduce.principal_tree(x, 2, 12, sigma=0.01, lam=1.0)
    assert all(b <= a + 1e-6 * abs(a) for a, b in zip(fit["objective"], fit["objective"][1:]))
    assert len(fit["edges"]) == 11
    cells = spark.createDataFrame([(i, z) for i, z in enumerate(fit["Z"].T.tolist())], "id long, x array<double>")
    placed, ordering = trajectory.order_cells(spark, cells, fit["Y"], fit["edges"])
    rows = placed.collect()
    assert len(rows) == 60 and ordering.pseudotime[ordering.root] == 0 and all(r["pseudotime"] >= 0 for r in rows)


def test_states_change_after_branch_points():
    tree = graph.adjacency([(0, 1, 1.0), (1, 2, 1.0), (1, 3, 2.0), (3, 4, 1.0)])
    o = trajectory.order(tree, 0)
    assert o.pseudotime == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4} and o.branch_points == [1]
    assert o.state[0] == o.state[1] and len({o.state[1], o.state[2], o.state[3]}) == 3 and o.state[3] == o.state[4]
    assert trajectory.select_root(tree) in (0, 4)
    d = np.array([[abs(i - j) for j in range(5)] for i in range(5)], float)
    line = graph.adjacency([(i, i + 1, 1.0) for i in range(4)])
    assert list(trajectory.lineage_order(line, d).pseudotime) in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0])
    assert branch.branch_paths(tree, 0, branch_point=1) == [[0, 1, 2], [0, 1, 3, 4]]


def test_reductions():
    with pytest.raises(ValueError, match="unrecognized"):
        reduce.reduce(y_shape(), method="L1-graph")
    assert reduce.centers(1000) == 120
    assert reduce.reduce(y_shape(), method=lambda m: m[:2, :10])["kind"] == "function_passed"
    rng = np.random.default_rng(2)
    s = np.vstack([rng.uniform(-1, 1, 400), np.sign(rng.normal(size=400))])
    found, *_ = reduce.ica(np.array([[1, 0.5], [0.3, 1]]) @ s, 2)
    c = np.abs(np.corrcoef(np.vstack([s, found]))[:2, 2:])
    assert (c.max(1) > 0.97).all()
    assert reduce.tsne(rng.normal(size=(30, 4)), steps=50).shape == (30, 2)


def test_branch_copies(spark):
    cs = counts(spark, {"a": [1, 2, 3, 4]})
    cells = spark.createDataFrame([("c0", 0.0, 0, True), ("c1", 1.0, 0, True), ("c2", 2.0, 0, False), ("c3", 5.0, 1, False)], "cell_id string, pseudotime double, branch int, progenitor boolean")
    both = branch.branch_set(cs, cells, "duplicate")
    assert both.cells.count() == 6 and both.expr.count() == 6
    split = branch.branch_set(cs, cells, "sequential_split")
    assert split.cells.count() == 5 and {r["pseudotime"] for r in split.cells.where("cell_id in ('c2', 'c3')").collect()} == {100.0}


@pytest.mark.parametrize("layout", [2, 3])
def test_matrix_directories(spark, tmp_path, layout):
    genes = ["ENSG1\tA\tGene Expression", "ENSG1\tB\tGene Expression", "AB1\tC\tAntibody Capture", "ENSG2\tD\tGene Expression"]
    files = {"barcodes.tsv": "AA-1\nCC-1\nGG-1\n", "matrix.mtx": "%%MatrixMarket matrix coordinate integer general\n%\n4 3 4\n1 1 2\n2 1 1\n3 2 7\n4 3 5\n"}
    root = tmp_path / "outs" / ("filtered_feature_bc_matrix" if layout == 3 else "filtered_gene_bc_matrices/hg19")
    root.mkdir(parents=True)
    files |= {"features.tsv": "\n".join(genes) + "\n"} if layout == 3 else {"genes.tsv": "\n".join(g.rsplit("\t", 1)[0] for g in genes) + "\n"}
    for name, text in files.items():
        if layout == 3:
            gzip.open(root / f"{name}.gz", "wt").write(text)
        else:
            (root / name).write_text(text)
    cs = tenx.load(spark, str(tmp_path), None if layout == 3 else "hg19").validate()
    assert cs.genes.count() == (3 if layout == 3 else 4) and cs.cells.count() == 3 and cs.detection_limit == 0.5
    assert {(r["gene_id"], r["cell_id"], r["value"]) for r in cs.expr.collect()} >= {("ENSG1", "AA-1", 2.0), ("ENSG1.1", "AA-1", 1.0), ("ENSG2", "GG-1", 5.0)}
    if layout == 2:
        with pytest.raises(ValueError):
            tenx.load(spark, str(tmp_path), "donkey")
    with pytest.raises(ValueError):
        tenx.load(spark, str(tmp_path / "absent"))
    tenx.write(cs, str(tmp_path / "out"), logged=True)
    again = tenx.read(spark, str(tmp_path / "out"), logged=True)
    assert again.family is Family.NB_SIZE and again.expr.agg(F.sum("value")).first()[0] == cs.expr.agg(F.sum("value")).first()[0]


def test_construction(spark):
    wide = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.5, 2.0)], "gene_id string, x double, y double")
    cs = from_wide(wide)
    assert cs.expr.count() == 3 and cs.cells.count() == 2 and cs.family is Family.TOBIT
    with pytest.raises(ValueError, match="lacks"):
        from_tables(cs.expr, genes=cs.genes.where("gene_id = 'a'")).validate()
    assert cs.subset(genes=F.col("gene_id") == "b").expr.count() == 2
    assert plotdata.layout([(0, 1), (0, 2)], 0)[0] == (0.5, 0.0) and plotdata.color_ramp(3) == ["#0000ff", "#00ff00", "#ff0000"]


def test_stream_totals(spark, tmp_path):
    from countloom.streaming import incremental

    ev = spark.createDataFrame([(1, "2024-01-01 01:00:00", "a", 1.0), (2, "2024-01-01 02:00:00", "a", 2.0), (3, "2024-01-03 02:00:00", "b", 4.0)], "event_id int, t string, event_type string, value double")
    ev.select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "ev"))
    static = spark.read.parquet(str(tmp_path / "ev"))
    q = incremental.windowed_totals(spark.readStream.schema(static.schema).parquet(str(tmp_path / "ev"))).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, incremental.windowed_totals(static).collect()))


def test_spike_ins_recover_the_line(spark):
    rng = np.random.default_rng(4)
    conc = np.array([1.0, 4.0, 16.0, 64.0, 256.0, 1024.0])
    molecules = conc * 10 * 1e-3 / 40000 * 1e-18 * 6.02214129e23
    values = {f"s{i}": (m * 2.0 * (1 + rng.normal(0, 0.01, 3))).tolist() for i, m in enumerate(molecules)}
    values["s2"][0] *= 50  # an outlier
    cs = counts(spark, values)
    spikes = spark.createDataFrame([(f"s{i}", float(c)) for i, c in enumerate(conc)], "gene_id string, concentration double")
    lines = normalize.spike_in_lines(cs, spikes, 10, 40000)
    for r in lines.collect():
        assert abs(r["slope"] - 1) < 0.08 and abs(r["intercept"] + math.log10(2)) < 0.2
    assert normalize.by_spike_ins(cs, lines).count() == 18
    with pytest.raises(ValueError, match="between"):
        normalize.spike_in_lines(cs, spikes, 10, 40000, threshold=9000)


def test_marker_test(spark):
    cs = counts(spark, {"m": [2, 0, 3, 0, 5, 0], "n": [0, 5, 0, 2, 0, 4], "x": [9, 1, 8, 2, 9, 1]})
    cs = normalize.with_size_factors(cs)
    h = typing.Hierarchy().add("M", lambda x: x["m"] >= 1).add("N", lambda x: x["n"] >= 1)
    closed = {r["gene_id"]: r["lr"] for r in typing.marker_test(cs, h, Curve(0.1, 1.0)).collect()}
    fitted = {r["gene_id"]: r["lr"] for r in typing.marker_test(cs, h, Curve(0.1, 1.0), "~half").collect()}
    assert set(closed) == set(fitted) == {"m", "n", "x"} and closed["x"] > 1


def test_inverse_embedding_keeps_the_scale():
    raw = np.random.default_rng(8).gamma(2.0, 3.0, (4, 50))
    fit = reduce.principal_tree(raw, 2, 10)
    x = reduce.inverse(fit["W"], fit["Z"], raw)
    assert x.shape == raw.shape and x.min() >= 0 and np.allclose(x.max(1), np.quantile(raw, 0.99, axis=1))


def test_tests_refuse_missing_levels(spark):
    cs = normalize.with_size_factors(counts(spark, {"a": [1, 2, 3, 4], "b": [2, 2, 1, 5]}))
    cs = cs.with_cells(spark.createDataFrame([("c0", "x"), ("c1", "x"), ("c2", "y")], "cell_id string, level string"))
    with pytest.raises(ValueError, match="null, NaN"):
        difftest.differential_test(cs, "level", dispersion.hints(cs, Curve(0.1, 1.0)))
    kept = cs.subset(cells=F.col("level").isNotNull())
    assert difftest.differential_test(kept, "level", dispersion.hints(kept, Curve(0.1, 1.0))).count() == 2


@pytest.mark.parametrize("seed", range(4))
def test_free_size_likelihoods_are_comparable(seed):
    """Each model's likelihood is complete, so a model with more terms never has less of it."""
    rng = np.random.default_rng(seed)
    y = rng.negative_binomial(2, 0.3, 80).astype(float)
    one, two = np.ones((80, 1)), np.column_stack([np.ones(80), np.arange(80) % 2])
    fits = []
    for x in (one, two):
        k = difftest.free_size(x, y)
        b, ll = difftest.regress(x, y, Family.NB.value, k)
        mu = np.exp(x @ b)
        plain = sum(math.lgamma(v + k) - math.lgamma(k) + k * math.log(k / (k + m)) + v * math.log(m / (k + m)) for v, m in zip(y, mu))
        assert abs(ll - plain) < 1e-6
        fits.append(ll)
    assert 0 <= 2 * (fits[1] - fits[0]) < 12


@pytest.mark.parametrize("seed", range(3))
def test_censored_fit_maximises_the_likelihood(seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.ones(400), rng.normal(size=400)])
    y = np.maximum(x @ [0.3, 0.8] + 0.7 * rng.normal(size=400), 0.0)
    b, ll, sd = difftest.censored(x, y, 0.0)
    assert abs(b[0] - 0.3) < 0.15 and abs(b[1] - 0.8) < 0.15 and abs(sd - 0.7) < 0.1

    def value(b0, b1, s):
        m = b0 + b1 * x[:, 1]
        return sum(-0.5 * ((v - u) / s) ** 2 - math.log(s) - 0.5 * math.log(2 * math.pi) if v > 0 else math.log(math.erfc(u / s / math.sqrt(2)) / 2) for v, u in zip(y, m))

    assert abs(ll - value(*b, sd)) < 1e-6
    for step in itertools.product((-0.01, 0, 0.01), repeat=3):
        assert value(b[0] + step[0], b[1] + step[1], sd + step[2]) <= ll + 1e-9
    assert np.linalg.norm(np.linalg.lstsq(x, y, rcond=None)[0] - [0.3, 0.8]) > np.linalg.norm(b - [0.3, 0.8])


def test_failed_fits_predict_nulls(spark):
    fits = spark.createDataFrame([("a", "OK", [1.0, 2.0]), ("b", "FAIL", None)], "gene_id string, status string, coef array<double>")
    got = {(r["gene_id"], r["grid_idx"]): r["value"] for r in difftest.predict(fits, np.array([[1.0, 0.0], [1.0, 1.0]]), Family.GAUSSIAN).collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 3.0, ("b", 0): None, ("b", 1): None}


def test_zeros_have_their_values(spark):
    """The whole matrix from entries and baselines equals a plain one."""
    m = np.array([[1, 2, 0, 0], [0, 0, 5, 1], [3, 0, 0, 4]], float)
    cs = normalize.with_size_factors(counts(spark, {g: row.tolist() for g, row in zip("abc", m)}))
    f = np.array([r["size_factor"] for r in cs.cells.orderBy("cell_id").collect()])
    table = lambda df: np.array([[x["value"] for x in rows] for _, rows in itertools.groupby(sorted(df.collect(), key=lambda r: (r["gene_id"], r["cell_id"])), key=lambda r: r["gene_id"])])
    q = m / f
    a, e = 0.1, 1.0
    want = np.log2((1 + e + 2 * a * q + 2 * np.sqrt(a * q * (1 + e + a * q))) / (4 * a))
    got = normalize.dense(cs, normalize.normalize(cs, "vstExprs", coefficients=(a, e)), normalize.baseline_of(cs.family, "vstExprs", coefficients=(a, e)))
    assert np.allclose(table(got), want)
    assert np.allclose(table(normalize.dense(cs, normalize.normalize(cs, "none", 0.5), normalize.baseline_of(cs.family, "none", 0.5))), q + 0.5)
    assert np.allclose(table(normalize.dense(cs, normalize.normalize(cs, "log", 2.0), normalize.baseline_of(cs.family, "log", 2.0))), np.log2(q + 2))
    z = normalize.standardized(cs, 1.0)
    base = z.select("gene_id", "baseline").distinct()
    assert np.allclose(table(normalize.dense(cs, z, base)), np.clip((m - m.mean(1, keepdims=True)) / m.std(1, ddof=1, keepdims=True), -1, 1))
    x = np.column_stack([np.ones(4), np.arange(4) % 2])
    b = np.linalg.lstsq(x, m.T, rcond=None)[0]
    want = m - (x[:, 1:] @ b[1:]).T
    assert np.allclose(table(normalize.dense(cs, normalize.batch_residuals(cs, "half"), normalize.batch_baseline(cs, "half"))), want)
    assert np.allclose(table(normalize.model_residuals(cs, "~half")), want)


def plain_lowess(x, y, span=2 / 3, rounds=3):
    """Every point from its own nearest neighbours, one at a time."""
    n, near = len(x), max(2, int(span * len(x) + 1e-7))
    robust = [1.0] * n
    for turn in range(rounds + 1):
        fit = []
        for i in range(n):
            reach = sorted(abs(v - x[i]) for v in x)[near - 1]
            w = [(1 - (abs(v - x[i]) / reach) ** 3) ** 3 * r if abs(v - x[i]) < 0.999 * reach else 0.0 for v, r in zip(x, robust)]
            a = np.array([[sum(w), sum(p * v for p, v in zip(w, x))], [sum(p * v for p, v in zip(w, x)), sum(p * v * v for p, v in zip(w, x))]])
            b = np.linalg.solve(a, [sum(p * v for p, v in zip(w, y)), sum(p * u * v for p, u, v in zip(w, x, y))])
            fit.append(b[0] + b[1] * x[i])
        off = [abs(u - v) for u, v in zip(y, fit)]
        scale = 6 * float(np.median(off))
        robust = [(1 - (o / scale) ** 2) ** 2 if o < 0.999 * scale else 0.0 for o in off]
    return np.array(fit)


def test_local_lines_equal_a_plain_version(spark):
    rng = np.random.default_rng(5)
    x = np.sort(rng.uniform(0, 10, 60))
    y = np.sin(x) + 0.1 * rng.normal(size=60)
    y[20] = 9.0  # an outlier that the robust rounds take out
    got = plotdata.local_lines(x, y, step=0.0)
    assert np.allclose(got, plain_lowess(x.tolist(), y.tolist()), atol=0.02)
    once = plotdata.local_lines(x, y, rounds=0, step=0.0)
    assert np.allclose(once, plain_lowess(x.tolist(), y.tolist(), rounds=0), atol=1e-6) and abs(got[20]) < abs(once[20])
    assert np.allclose(plotdata.local_lines(x, y), got, atol=0.05)
    df = spark.createDataFrame([("g", k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "gene_id string, cell_id int, pseudotime double, value double")
    assert np.allclose([r["smooth"] for r in plotdata.lowess(df).orderBy("cell_id").collect()], plotdata.local_lines(x, y))


def test_orders_of_p_nodes_are_the_cheapest():
    rng = np.random.default_rng(9)
    points = rng.uniform(size=(14, 2))
    d = np.sqrt(((points[:, None] - points) ** 2).sum(2))
    node = trajectory.Node("P", [0, 1, trajectory.Node("Q", [2, 3, 4]), 5, trajectory.Node("Q", [6, 7])])
    cost = lambda seq: sum(d[a, b] for a, b in zip(seq, seq[1:]))
    parts = [[[0]], [[1]], [[2, 3, 4], [4, 3, 2]], [[5]], [[6, 7], [7, 6]]]
    want = min(cost([leaf for part in way for leaf in part]) for order in itertools.permutations(parts) for way in itertools.product(*order))
    assert abs(cost(trajectory.best_order(node, d)) - want) < 1e-9
    big = trajectory.Node("P", list(range(10)))
    assert cost(trajectory.best_order(big, d)) <= cost(trajectory.best_order(big, d, exact=2)) + 1e-9


def test_scaled_pseudotime_ends_at_100():
    tree = graph.adjacency([(0, 1, 1.0), (1, 2, 1.0), (1, 3, 4.0), (3, 4, 1.0)])
    got = trajectory.scale_pseudotime(trajectory.order(tree, 0))
    assert got[0] == 0 and got[2] == got[4] == 100 and got[1] < got[3] < 100


def test_clustering_entry_point(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=2) * 0.3 + 6 * np.array([i % 3 == 1, i % 3 == 2])).tolist()) for i in range(60)]
    points = spark.createDataFrame(rows, "id long, x array<double>")
    empty = spark.createDataFrame([], "gene_id long, cell_id long, value double")
    cs = CountSet(empty, points.select(F.col("id").alias("cell_id")), empty.select("gene_id").distinct())
    for method, more in (("densityPeak", {"num_clusters": 3}), ("louvain", {"k": 8}), ("DDRTree", {"num_clusters": 3})):
        out = cluster.cluster_cells(cs, points, method, **more)
        got = {}
        for r in out.cells.collect():
            got.setdefault(r["cell_id"] % 3, set()).add(r["Cluster"])
        if method == "DDRTree":  # a tree's vertices share the cells out, whatever groups there are
            assert out.cells.where("Cluster is null").isEmpty() and 1 <= len(set().union(*got.values())) <= 3
        else:
            assert all(not got[a] & got[b] for a in got for b in got if a < b), method
        if method == "densityPeak":
            again = cluster.cluster_cells(out, points, rho=0.0, delta=1e9, reuse=True)
            assert again.cells.select("Cluster").distinct().count() == 1
    with pytest.raises(ValueError, match="reuse"):
        cluster.cluster_cells(cs, points, reuse=True)
    with pytest.raises(ValueError, match="unknown clustering"):
        cluster.cluster_cells(cs, points, "other")


def test_gene_clusters_leave_out_missing_rows():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(2, 30))
    m = np.vstack([base[k % 2] + 0.1 * rng.normal(size=30) for k in range(10)])
    m[3, 4] = np.nan
    got = cluster.gene_clusters(m, 2)
    assert got["rows"].tolist() == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    assert len({(int(r) % 2, int(c)) for r, c in zip(got["rows"], got["labels"])}) == 2
    own = cluster.gene_clusters(m, 2, method=lambda x: np.sqrt(((x[:, None] - x) ** 2).sum(2)))
    assert len(own["medoids"]) == 2


def test_branch_flow(spark):
    """A gene that follows its branch is found, and its curves part."""
    rng = np.random.default_rng(1)
    rows, cells = [], []
    for i in range(120):
        t, side = i / 1.2, i % 2
        cells.append((f"c{i:03d}", t, 0 if t < 30 else 10 * (1 + side)))
        for g, mean in (("flat", 10.0), ("apart", 10.0 if t < 30 or side == 0 else 40.0)):
            rows.append((g, f"c{i:03d}", float(rng.poisson(mean))))
    cells = spark.createDataFrame(cells, "cell_id string, pseudotime double, vertex long")
    genes = spark.createDataFrame([("flat", "F"), ("apart", "A")], "gene_id string, gene_short_name string")
    cs = CountSet(spark.createDataFrame(rows, "gene_id string, cell_id string, value double").where("value > 0"), cells.select("cell_id").withColumn("size_factor", F.lit(1.0)), genes)
    tree = graph.adjacency([(0, 10, 1.0), (0, 20, 1.0), (0, 1, 1.0)])
    of = branch.branch_cells(cells, tree, 1, branch_point=0)
    curve = Curve(0.01, 0.01)
    got = {r["gene_id"]: r for r in branch.beam(cs, of, curve=curve).collect()}
    assert got["apart"]["qval"] < 1e-6 < got["flat"]["pval"] and got["flat"]["gene_short_name"] == "F"
    area = {r["gene_id"]: abs(r["abc"]) for r in branch.areas(cs, of, 500, curve=curve).collect()}
    assert area["apart"] > 5 * area["flat"]
    ilr = {r["gene_id"]: r["divergence"] for r in branch.divergence(branch.log_ratios(cs, of, curve=curve)).collect()}
    assert ilr["apart"] > 1 > ilr["flat"]
    plain = branch.branch_test(cs.with_cells(cells.select("cell_id", F.col("pseudotime").alias("Pseudotime"))), of, "~Pseudotime", "~1", curve)
    assert plain.count() == 2


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([("g", k % 2, float(k)) for k in range(200)], "gene_id string, side int, expression double")
    for r in plotdata.bootstrap_interval(df, ["gene_id", "side"]).collect():
        assert r["low"] < r["mean"] < r["high"] and abs(r["mean"] - 99.5) <= 0.5 and 18 < r["high"] - r["low"] < 28


def test_container_import_keeps_side_data(spark):
    raw = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "z", 1.5)], "gene_id string, cell_id string, value double")
    meta = spark.createDataFrame([("x",), ("y",)], "cell_id string")
    got = from_container(raw, meta, import_all=True, reduction="r")
    assert got.expr.count() == 2 and got.family is Family.NB_SIZE and got.side == {"reduction": "r"} and got.genes.count() == 2
    assert from_container(raw, meta, reduction="r").side == {}


def test_uncentred_scores(spark):
    x = np.random.default_rng(3).normal(size=(40, 3)) + 5
    got = np.array([r["x"] for r in reduce.uncentred_scores(spark.createDataFrame(list(enumerate(x.tolist())), "id int, x array<double>"), 3).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u * s), atol=1e-8)


def _peak(work):
    """Result and most memory in bytes that numpy and Python held meanwhile."""
    import tracemalloc

    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_trees_of_points_hold_no_distance_matrix():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2, 3000))
    x[:, 10:20] = x[:, :1]  # coincident points
    d = np.sqrt(((x[:, :, None] - x[:, None]) ** 2).sum(0))
    assert graph.spanning_tree(graph.Distances(x)) == graph.spanning_tree(d)
    m = np.vstack([x, rng.normal(size=(3, 3000))])
    fit, most = _peak(lambda: reduce.reduce(m, 2, "ICA"))
    assert len(fit["edges"]) == 2999 and most < 3000 * 3000 * 8 / 4


def test_order_by_lineages_is_that_of_the_distance_matrix():
    x = np.random.default_rng(6).normal(size=(2, 400))
    d = np.sqrt(((x[:, :, None] - x[:, None]) ** 2).sum(0))
    tree = graph.adjacency(graph.spanning_tree(graph.Distances(x)))
    assert trajectory.lineage_order(tree, graph.Distances(x), 2) == trajectory.lineage_order(tree, d, 2)


def test_tsne_of_many_rows():
    """Linear memory; forces and result as with all pairs."""
    rng = np.random.default_rng(7)
    for dims, scale in ((1, 5.0), (2, 1e-4), (2, 5.0), (2, 20.0)):
        y = rng.normal(scale=scale, size=(500, dims))
        q = 1 / (1 + ((y[:, None] - y) ** 2).sum(2)) - np.eye(500)
        want = ((q**2)[:, :, None] * (y[:, None] - y)).sum(1) / q.sum()
        for got in (reduce._grid_repulsion(y), reduce._row_repulsion(y)):
            assert np.abs(got - want).max() < 0.02 * np.abs(want).max()
    x = np.vstack([rng.normal(size=(60, 5)) + 20 * k for k in range(4)])
    y = reduce.tsne(x, exact=0, steps=300)
    own = np.repeat(range(4), 60)
    d = ((y[:, None] - y) ** 2).sum(2) + np.diag(np.full(240, np.inf))
    assert (own[d.argmin(1)] == own).mean() > 0.99
    assert reduce.tsne(x[:50], dims=3, exact=0, steps=20).shape == (50, 3)
    many = rng.normal(size=(4000, 5))
    y, most = _peak(lambda: reduce.tsne(many, steps=2))
    assert y.shape == (4000, 2) and most < 4000 * 4000 * 8 / 2


@pytest.mark.parametrize("name", ["jitter_data", "violin_data", "normalized_matrix", "genes_in_pseudotime"])
def test_genes_times_cells_are_not_joined_by_a_shuffle(spark, name):
    import re

    from checks import DATA
    from countloom.plans.queries import QUERIES

    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join (LeftOuter|Inner), \(?\(+gene_id#\d+L? = gene_id#\d+L?\) AND \(cell_id", plan)


def test_everywhere(spark):
    from countloom.dataset import everywhere

    genes = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n")], "gene_id long, name string")
    cells = spark.createDataFrame([(c, c % 2) for c in range(10)] + [(None, 5)], "cell_id long, side long")
    entries = spark.createDataFrame([(1, 3, 2.5), (2, 4, 1.0), (2, 9, None), (7, 1, 1.0), (None, 1, 1.0), (1, None, 1.0)], "gene_id long, cell_id long, value double")
    want = genes.crossJoin(cells).join(entries, ["gene_id", "cell_id"], "left")
    got = everywhere(genes, cells, entries)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 44
