"""The same queries in SQL, written apart from the DataFrame code."""

from __future__ import annotations

V1 = """expr AS (SELECT l_partkey AS gene_id, l_suppkey AS cell_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
cells AS (SELECT s_suppkey AS cell_id, r_name AS region, n_name AS nation, s_acctbal AS acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
genes AS (SELECT p_partkey AS gene_id, p_name AS gene_short_name, p_brand AS brand, p_type AS type, p_size AS size FROM part),
nn AS (SELECT (SELECT count(*) FROM cells)::DOUBLE AS n)"""
V2 = """expr AS (SELECT l_partkey AS gene_id, l_orderkey AS cell_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
cells AS (SELECT o_orderkey AS cell_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
genes AS (SELECT p_partkey AS gene_id FROM part), nn AS (SELECT (SELECT count(*) FROM cells)::DOUBLE AS n)"""
SF = """tot AS (SELECT c.cell_id, coalesce(sum(round_even(value, 0)::DOUBLE), 0) AS total FROM cells c LEFT JOIN expr USING (cell_id) GROUP BY ALL),
sf AS (SELECT cell_id, CASE WHEN total > 0 THEN total / exp((SELECT avg(ln(total)) FROM tot WHERE total > 0)) ELSE 1 END AS size_factor FROM tot)"""
DOCS = """w AS (SELECT doc_id AS cell_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS gene_id FROM documents),
expr AS (SELECT gene_id, cell_id, count(*)::DOUBLE AS value FROM w WHERE gene_id <> '' GROUP BY ALL), genes AS (SELECT DISTINCT gene_id FROM expr)"""
EV = """span AS (SELECT min(epoch_us(ts)) / 1e6 AS lo, max(epoch_us(ts)) / 1e6 AS hi FROM events),
ev AS (SELECT event_type AS gene_id, event_id AS cell_id, value, 100 * (epoch_us(ts) / 1e6 - lo) / (hi - lo) AS pseudotime, user_id % 2 AS branch FROM events, span)"""
CURVES = EV + """,
curves AS (SELECT * FROM (SELECT gene_id, least(49, floor(pseudotime * 50 / 100))::BIGINT AS grid_idx, avg(value) FILTER (WHERE branch = 0) AS a, avg(value) FILTER (WHERE branch = 1) AS b
  FROM ev GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL)"""
PTS = "pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings)"
PAIRS = PTS + ", prs AS (SELECT p.id AS a, q.id AS b, list_distance(p.x, q.x) AS d FROM pts p JOIN pts q ON p.id <> q.id)"
KNN = PAIRS + ", knn AS (SELECT * FROM (SELECT a AS id, b AS neighbour, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS turn FROM prs) WHERE turn <= 5)"
TREE = "tree AS (SELECT p_partkey // 2 AS parent, p_partkey AS child, p_size::DOUBLE AS weight FROM part WHERE p_partkey > 1)"
COORDS = "coords AS (SELECT p_partkey AS vertex, p_retailprice AS x, p_size::DOUBLE AS y FROM part WHERE p_size > 10)"
BC = EV + ", bc AS (SELECT cell_id, branch, pseudotime, pseudotime < 30 AS progenitor FROM ev)"
MED = "t AS (SELECT cell_id, median(value) AS t FROM expr GROUP BY cell_id)"
# zero-padded median of each gene over all cells
PAD = "pm AS (SELECT gene_id, quantile_cont(coalesce(value, 0), 0.5) AS median FROM (SELECT gene_id, cell_id FROM genes, cells) LEFT JOIN expr USING (gene_id, cell_id) GROUP BY gene_id)"
SPEC = """sizes AS (SELECT region, count(*) AS n FROM cells GROUP BY region),
mean AS (SELECT gene_id, region, coalesce(s, 0) / n AS m FROM (SELECT gene_id, region, n FROM genes, sizes) LEFT JOIN (SELECT gene_id, region, sum(value) AS s FROM expr JOIN cells USING (cell_id) GROUP BY ALL) USING (gene_id, region)),
sh AS (SELECT *, m / nullif(sum(m) OVER (PARTITION BY gene_id), 0) AS p FROM mean),
hh AS (SELECT gene_id, region, p, sum(CASE WHEN p > 0 THEN -p * log10(p) ELSE 0 END) OVER (PARTITION BY gene_id) AS h,
  sum(CASE WHEN p > 0 THEN -(p / 2) * log10(p / 2) ELSE 0 END) OVER (PARTITION BY gene_id) - (CASE WHEN p > 0 THEN -(p / 2) * log10(p / 2) ELSE 0 END) - ((p + 1) / 2) * log10((p + 1) / 2) AS hm FROM sh),
spec AS (SELECT gene_id, region, CASE WHEN p IS NULL THEN 0 ELSE 1 - sqrt(greatest(0, hm - h / 2)) END AS specificity FROM hh)"""
MOM = """y AS (SELECT gene_id, cell_id, round_even(value, 0)::DOUBLE AS r, round_even(value, 0)::DOUBLE / size_factor AS y FROM expr JOIN sf USING (cell_id)),
inv AS (SELECT avg(1 / size_factor) AS xi FROM sf),
m0 AS (SELECT gene_id, count(*) FILTER (WHERE r > 0.1) AS k, sum(y) AS s, sum(y * y) AS ss FROM y GROUP BY gene_id),
mom AS (SELECT gene_id, s / n AS mu, greatest(0, (ss / n - (s / n) * (s / n) - xi * s / n) / ((s / n) * (s / n))) AS disp FROM m0, nn, inv WHERE k > 1)"""
GATES = """g AS (SELECT cell_id, nation, coalesce(sum(value) FILTER (WHERE gene_id = 1), 0) AS m1, coalesce(sum(value) FILTER (WHERE gene_id = 2), 0) AS m2, coalesce(sum(value) FILTER (WHERE gene_id = 3), 0) AS m3,
  coalesce(sum(value) FILTER (WHERE gene_id = 4), 0) AS m4, coalesce(sum(value) FILTER (WHERE gene_id = 5), 0) AS m5 FROM cells LEFT JOIN expr USING (cell_id) GROUP BY ALL),
gt AS (SELECT cell_id, nation, m1 > 30 AS a, m2 > 30 AS b, m3 > 20 AS a1, m4 > 20 AS a2, m5 > 0 AND m1 < 10 AS c FROM g)"""
TYPE = """CASE WHEN a::INT + b::INT + c::INT = 0 THEN 'Unknown' WHEN a::INT + b::INT + c::INT > 1 THEN 'Ambiguous' WHEN a THEN
  CASE WHEN a1 AND a2 THEN 'Ambiguous' WHEN a1 THEN 'A1' WHEN a2 THEN 'A2' ELSE 'A' END WHEN b THEN 'B' ELSE 'C' END"""
LEAD = "led AS (SELECT gene_id, row_number() OVER (ORDER BY sum(value) DESC, gene_id) AS k FROM expr GROUP BY gene_id)"
GRID = "grid AS (SELECT gene_id, cell_id, region, coalesce(value, 0) / size_factor AS x FROM (SELECT gene_id, cell_id, region FROM genes, cells) LEFT JOIN expr USING (gene_id, cell_id) JOIN sf USING (cell_id))"
DENS = PAIRS + """, rho AS (SELECT a AS id, round(sum(exp(-(d / 8.0) * (d / 8.0))), 9) AS rho, max(d) AS farthest FROM prs GROUP BY a),
up AS (SELECT p.a AS id, p.d, p.b, row_number() OVER (PARTITION BY p.a ORDER BY p.d, p.b) AS k FROM prs p JOIN rho x ON x.id = p.a JOIN rho y ON y.id = p.b WHERE y.rho > x.rho OR y.rho = x.rho AND p.b < p.a),
dens AS (SELECT r.id, r.rho, coalesce(up.d, r.farthest) AS delta, up.b AS higher FROM rho r LEFT JOIN up ON up.id = r.id AND up.k = 1)"""
CENTERS = """cen AS (SELECT label::BIGINT AS vertex, list(v ORDER BY i) AS y FROM (SELECT label, i, avg(x[i]) AS v FROM pts, range(1, 65) AS u(i) GROUP BY ALL) GROUP BY label)"""
XLY = "CASE WHEN {x} = 0 THEN 0 ELSE {x} * ln(greatest({y}, 1e-300)) END"
BH = """, bh AS (SELECT *, row_number() OVER (ORDER BY pval, gene_id) AS rk, count(*) OVER () AS nt FROM pv WHERE status = 'OK'),
q AS (SELECT *, least(1, min(pval * nt / rk) OVER (ORDER BY pval DESC, gene_id DESC ROWS UNBOUNDED PRECEDING)) AS qval FROM bh)
SELECT pv.gene_id, pv.status, pv.family, round(pv.lr, 5) + 0.0::DOUBLE AS lr, round(pv.pval, 6) AS pval, round(coalesce(q.qval, 1), 6) AS qval FROM pv LEFT JOIN q USING (gene_id)"""
# 1 - erf by its series; beyond z = 6 it is under 1e-16
ERFC = "CASE WHEN lr IS NULL THEN NULL WHEN lr <= 0 THEN 1 WHEN lr > 72 THEN 0 ELSE greatest(0, 1 - exp(-lr / 2) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(sqrt(lr / 2)) - lgamma(k + 1.5))))) END"
TAIL = {1: ERFC, 2: "exp(-lr / 2)", 3: f"({ERFC}) + sqrt(2 * lr / pi()) * exp(-lr / 2)", 4: "exp(-lr / 2) * (1 + lr / 2)"}


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def nb_test(view: str, factor: str, df: int) -> str:
    return with_(view, SF) + f""", hint AS (SELECT gene_id, 1 / (0.1 + 1.0 / (sum(round_even(value, 0)::DOUBLE) / any_value(n))) AS k FROM expr, nn GROUP BY gene_id HAVING sum(value) > 0),
yy AS (SELECT gene_id, {factor} AS lv, sum(round_even(value / size_factor, 0)::DOUBLE) AS s FROM expr JOIN sf USING (cell_id) JOIN cells USING (cell_id) GROUP BY ALL),
sz AS (SELECT {factor} AS lv, count(*)::DOUBLE AS nj FROM cells GROUP BY ALL),
mm AS (SELECT gene_id, lv, nj, k, coalesce(s, 0) / nj AS m FROM (SELECT gene_id, k, lv, nj FROM hint, sz) LEFT JOIN yy USING (gene_id, lv)),
ll AS (SELECT gene_id, sum(nj * ({XLY.format(x="m", y="m")} - (m + k) * ln(m + k))) AS l1, sum(nj) AS nt, sum(nj * m) / sum(nj) AS m0, any_value(k) AS k FROM mm GROUP BY gene_id),
lr AS (SELECT gene_id, greatest(0, 2 * (l1 - nt * ({XLY.format(x="m0", y="m0")} - (m0 + k) * ln(m0 + k)))) AS lr FROM ll),
pv AS (SELECT g.gene_id, CASE WHEN lr IS NULL THEN 'FAIL' ELSE 'OK' END AS status, 'negbinomial.size' AS family, lr, coalesce({TAIL[df]}, 1) AS pval FROM genes g LEFT JOIN lr USING (gene_id))""" + BH


def binomial_test(cells: str, factor: str, tail: str) -> str:
    return with_(DOCS, cells) + f""", sz AS (SELECT {factor} AS lv, count(*)::DOUBLE AS nj FROM cells GROUP BY ALL),
yy AS (SELECT gene_id, {factor} AS lv, count(*)::DOUBLE AS s FROM expr JOIN cells USING (cell_id) GROUP BY ALL),
seen AS (SELECT DISTINCT gene_id FROM yy),
mm AS (SELECT gene_id, lv, nj, coalesce(s, 0) / nj AS m FROM (SELECT * FROM seen, sz) LEFT JOIN yy USING (gene_id, lv)),
ll AS (SELECT gene_id, sum(nj * ({XLY.format(x="m", y="m")} + {XLY.format(x="(1 - m)", y="1 - m")})) AS l1, sum(nj) AS nt, sum(nj * m) / sum(nj) AS m0 FROM mm GROUP BY gene_id),
lr AS (SELECT gene_id, greatest(0, 2 * (l1 - nt * ({XLY.format(x="m0", y="m0")} + {XLY.format(x="(1 - m0)", y="1 - m0")}))) AS lr FROM ll),
pv AS (SELECT g.gene_id, CASE WHEN lr IS NULL THEN 'FAIL' ELSE 'OK' END AS status, 'binomialff' AS family, lr, coalesce({tail}, 1) AS pval FROM genes g LEFT JOIN lr USING (gene_id))""" + BH


ILR = CURVES + ", ilr AS (SELECT gene_id, grid_idx, greatest(-3, least(3, log2((a + 1) / (b + 1)))) AS ilr FROM curves)"
HEAT = "SELECT gene_id, grid_idx, round(greatest(-3, least(3, (v - m) / s)), 6) AS z FROM (SELECT *, avg(v) OVER w AS m, stddev_samp(v) OVER w AS s FROM hv WINDOW w AS (PARTITION BY gene_id)) WHERE s > 0"

ORACLES: dict[str, str] = {
    "detect_genes": with_(V1) + "SELECT g.gene_id, count(*) FILTER (WHERE value > 20) AS num_cells_expressed FROM genes g LEFT JOIN expr USING (gene_id) GROUP BY ALL",
    "detect_cells": with_(V1) + "SELECT c.cell_id, count(*) FILTER (WHERE value > 20) AS num_genes_expressed FROM cells c LEFT JOIN expr USING (cell_id) GROUP BY ALL",
    "detect_genes_by_order": with_(V2) + "SELECT g.gene_id, count(*) FILTER (WHERE value > 0.1) AS num_cells_expressed FROM genes g LEFT JOIN expr USING (gene_id) GROUP BY ALL",
    "qc_filter_totals": with_(V1) + """, t AS (SELECT cell_id, sum(value) AS total FROM expr GROUP BY cell_id HAVING sum(value) < 1e6 AND sum(value) > 0),
m AS (SELECT avg(log10(total)) AS m, stddev_samp(log10(total)) AS s FROM t) SELECT cell_id, total FROM t, m WHERE total > pow(10, m - 2 * s) AND total < pow(10, m + 2 * s)""",
    "size_factors_mgmt": with_(V1, SF) + "SELECT cell_id, round(size_factor, 6) AS size_factor FROM sf",
    "size_factors_gmt": with_(V1, SF) + "SELECT cell_id, round(CASE WHEN total > 0 THEN ln(total) / (SELECT avg(ln(total)) FROM tot WHERE total > 0) ELSE 1 END, 6) AS size_factor FROM tot",
    "size_factors_weighted_median": with_(V1, PAD) + """, wt AS (SELECT gene_id, count(*) / any_value(n) AS w FROM expr, nn WHERE value > 0 GROUP BY gene_id),
f AS (SELECT cell_id, exp(avg(w * (ln(value) - ln(median)))) AS f FROM expr JOIN pm USING (gene_id) JOIN wt USING (gene_id) WHERE value > 0 AND median > 0 GROUP BY cell_id)
SELECT cell_id, round(coalesce(f, 1), 6) AS size_factor FROM cells LEFT JOIN f USING (cell_id)""",
    "size_factors_median_geo": with_(V1) + """, full_genes AS (SELECT gene_id, avg(ln(value)) AS g FROM expr, nn WHERE value > 0 GROUP BY gene_id HAVING count(*) = any_value(n)),
f AS (SELECT cell_id, exp(median(ln(value) - g)) AS f FROM expr JOIN full_genes USING (gene_id) GROUP BY cell_id)
SELECT cell_id, round(coalesce(f, 1), 6) AS size_factor FROM cells LEFT JOIN f USING (cell_id)""",
    "size_factors_median": with_(V1, PAD) + """SELECT cell_id, round(median(coalesce(value, 0) - median), 6) AS size_factor FROM (SELECT cell_id, gene_id, median FROM cells, pm) LEFT JOIN expr USING (gene_id, cell_id) GROUP BY cell_id""",
    "log_normalized": with_(V1, SF) + "SELECT gene_id, cell_id, round(log2(value / size_factor + 1), 6) AS value FROM expr JOIN sf USING (cell_id)",
    "tfidf": with_(DOCS) + "SELECT gene_id, cell_id, round(ln(1 + (SELECT count(*) FROM documents)::DOUBLE / count(*) OVER (PARTITION BY gene_id)), 6) AS value FROM expr",
    "vst_exprs": with_(V1, SF) + """SELECT gene_id, cell_id, round(log2((2.0 + 0.2 * q + 2 * sqrt(0.1 * q * (2.0 + 0.1 * q))) / 0.4), 6) AS value, round(log2(2.0 / 0.4), 6) AS baseline
FROM (SELECT gene_id, cell_id, round_even(value / size_factor, 0)::DOUBLE AS q FROM expr JOIN sf USING (cell_id))""",
    "row_scale_clip": with_(V1) + """, s AS (SELECT gene_id, sum(value) / any_value(n) AS m, sqrt((sum(value * value) - any_value(n) * (sum(value) / any_value(n)) * (sum(value) / any_value(n))) / (any_value(n) - 1)) AS sd FROM expr, nn GROUP BY gene_id)
SELECT gene_id, cell_id, round(greatest(-3, least(3, (value - m) / sd)), 6) AS value, round(greatest(-3, least(3, -m / sd)), 6) AS baseline FROM expr JOIN s USING (gene_id) WHERE sd > 0""",
    "tpm": with_(V1) + "SELECT gene_id, cell_id, round(value / sum(value) OVER (PARTITION BY cell_id) * 1e6, 6) AS value FROM expr",
    "census_num_genes": with_(V1, MED) + """, f AS (SELECT cell_id, count(*) AS n0, count(*) FILTER (WHERE value <= t) AS low FROM expr JOIN t USING (cell_id) WHERE value > 0.1 GROUP BY cell_id)
SELECT cell_id, round(CASE WHEN low > 0 THEN n0 / 0.25::DOUBLE END, 6) AS total_mrna FROM cells LEFT JOIN f USING (cell_id)""",
    "census_tpm_fraction": with_(V1, MED) + """, f AS (SELECT cell_id, count(*) FILTER (WHERE value <= t) AS low, sum(value) AS s, coalesce(sum(value) FILTER (WHERE value < t), 0) AS below FROM expr JOIN t USING (cell_id) WHERE value > 0.1 GROUP BY cell_id)
SELECT cell_id, round(CASE WHEN below > 0 THEN low / (below / s) / 0.25::DOUBLE END, 6) AS total_mrna FROM cells LEFT JOIN f USING (cell_id)""",
    "relative_to_absolute": with_(V1) + "SELECT gene_id, cell_id, round(value / sum(value) OVER (PARTITION BY cell_id) * (count(*) OVER (PARTITION BY cell_id) / 0.25::DOUBLE), 6) AS value FROM expr",
    "js_specificity": with_(V1, SPEC) + "SELECT gene_id, region, round(specificity, 6) AS specificity FROM spec",
    "top_markers": with_(V1, SPEC) + """SELECT gene_id, region, specificity FROM (SELECT *, rank() OVER (PARTITION BY region ORDER BY specificity DESC) AS k FROM (SELECT gene_id, region, round(specificity, 6) AS specificity FROM spec)) WHERE k <= 10""",
    "classify_cells": with_(V1, GATES) + f'SELECT cell_id, {TYPE} AS "CellType" FROM gt',
    "classify_cells_grouped": with_(V1, GATES) + f""", s AS (SELECT nation, avg(a::INT) > 0.2 AS a, avg(b::INT) > 0.2 AS b, avg(a1::INT) > 0.2 AS a1, avg(a2::INT) > 0.2 AS a2, avg(c::INT) > 0.2 AS c FROM gt GROUP BY nation),
ty AS (SELECT nation, {TYPE} AS "CellType" FROM s) SELECT cell_id, nation, "CellType" FROM cells JOIN ty USING (nation)""",
    "ordering_filter": "SELECT p_partkey AS gene_id, p_size > 25 AS use_for_ordering FROM part",
    "zero_variance_filter": with_(V1) + """SELECT gene_id, round(m, 6) AS mean, round(sd, 6) AS sd FROM (SELECT gene_id, sum(value) / any_value(n) AS m, sqrt(greatest(0, sum(value * value) / any_value(n) - (sum(value) / any_value(n)) * (sum(value) / any_value(n)))) AS sd FROM expr, nn GROUP BY gene_id) WHERE sd > 0""",
    "dispersion_moments": with_(V1, SF, MOM) + "SELECT gene_id, round(mu, 6) AS mu, round(disp, 6) AS disp FROM mom",
    "dispersion_table": with_(V1, SF, MOM) + "SELECT gene_id, round(mu, 6) AS mean_expression, round(0.1 + 1.0 / mu, 6) AS dispersion_fit, round(disp, 6) AS dispersion_empirical FROM mom",
    "dispersion_selection": with_(V1, SF, MOM) + "SELECT gene_id, round(mu, 6) AS mean_expression FROM mom WHERE mu >= 0.5 AND disp >= 0.1 + 1.0 / mu",
    "disp_hint": with_(V1) + "SELECT gene_id, round(0.1 + 1.0 / (sum(round_even(value, 0)::DOUBLE) / any_value(n)), 6) AS hint FROM expr, nn GROUP BY gene_id HAVING sum(value) > 0",
    "de_nb_region": nb_test(V1, "region", 4),
    "de_nb_status": nb_test(V2, "status", 2),
    "de_nb_priority": nb_test(V2, "priority", 4),
    "de_gaussian_region": with_(V1) + f""", sz AS (SELECT region, count(*)::DOUBLE AS nj FROM cells GROUP BY region),
yy AS (SELECT gene_id, region, sum(value) AS s, sum(value * value) AS ss FROM expr JOIN cells USING (cell_id) GROUP BY ALL),
a AS (SELECT gene_id, sum(ss) AS ss, sum(s) AS s, sum(s * s / nj) AS bt FROM yy JOIN sz USING (region) GROUP BY gene_id),
lr AS (SELECT gene_id, greatest(0, n * ln((ss - s * s / n) / (ss - bt))) AS lr FROM a, nn WHERE ss - bt > 1e-12),
pv AS (SELECT g.gene_id, CASE WHEN lr IS NULL THEN 'FAIL' ELSE 'OK' END AS status, 'uninormal' AS family, lr, coalesce({TAIL[4]}, 1) AS pval FROM genes g LEFT JOIN lr USING (gene_id))""" + BH,
    "bh_adjust_parts": """WITH p AS (SELECT p_partkey AS gene_id, (p_partkey * 7919 % 10007) / 10007.0::DOUBLE AS pval FROM part), k AS (SELECT *, row_number() OVER (ORDER BY pval, gene_id) AS rk, count(*) OVER () AS n FROM p)
SELECT gene_id, round(pval, 6) AS pval, round(least(1, min(pval * n / rk) OVER (ORDER BY pval DESC, gene_id DESC ROWS UNBOUNDED PRECEDING)), 6) AS qval FROM k""",
    "batch_residuals": with_(V1) + """, sz AS (SELECT region, count(*) AS nj FROM cells GROUP BY region), m AS (SELECT gene_id, region, sum(value) / any_value(nj) AS m FROM expr JOIN cells USING (cell_id) JOIN sz USING (region) GROUP BY ALL),
b AS (SELECT gene_id, m AS base FROM m WHERE region = (SELECT min(region) FROM cells))
SELECT gene_id, cell_id, round(value - m + coalesce(base, 0), 6) AS value, round(coalesce(base, 0) - m, 6) AS baseline FROM expr JOIN cells USING (cell_id) JOIN m USING (gene_id, region) LEFT JOIN b USING (gene_id)""",
    "family_inference": with_(V1) + """, a AS (SELECT 'quantity' AS view, bool_and(value = floor(value)) AS all_whole, bool_or(value < 0) AS any_negative FROM expr UNION ALL
SELECT 'balance', bool_and(s_acctbal = floor(s_acctbal)), bool_or(s_acctbal < 0) FROM supplier)
SELECT *, CASE WHEN all_whole THEN 'negbinomial.size' WHEN any_negative THEN 'uninormal' ELSE 'Tobit' END AS family FROM a""",
    "knn_k5": with_(KNN) + "SELECT id, neighbour, turn, round(d, 6) AS d FROM knn",
    "jaccard_weights": with_(KNN) + """, l AS (SELECT id, list(neighbour) AS own FROM knn GROUP BY id),
w AS (SELECT k.id, k.neighbour, CASE WHEN u > 0 THEN u / (10.0::DOUBLE - u) ELSE 1 END AS w FROM (SELECT knn.id, knn.neighbour, len(list_intersect(a.own, b.own)) AS u FROM knn JOIN l a ON a.id = knn.id JOIN l b ON b.id = knn.neighbour) k)
SELECT id, neighbour, round(w / (SELECT max(w) FROM w), 6) AS weight FROM w""",
    "density_rho_delta": with_(DENS) + "SELECT id, round(rho, 5) AS rho, round(delta, 6) AS delta, higher FROM dens",
    "density_peaks_assign": "WITH RECURSIVE " + DENS + """, pk AS (SELECT id, higher, rho > 0 AND delta > (SELECT min(delta) - 1e-9 FROM (SELECT delta FROM dens ORDER BY delta DESC, id LIMIT 8)) OR higher IS NULL AS peak FROM dens),
walk AS (SELECT id, CASE WHEN peak THEN id ELSE higher END AS at FROM pk UNION SELECT w.id, CASE WHEN p.peak THEN p.id ELSE p.higher END FROM walk w JOIN pk p ON p.id = w.at)
SELECT w.id, w.at AS cluster FROM walk w JOIN pk p ON p.id = w.at AND p.peak""",
    "nearest_center": with_(PTS, CENTERS) + "SELECT id, vertex, round(d, 6) AS d FROM (SELECT id, vertex, list_distance(x, y) AS d, row_number() OVER (PARTITION BY id ORDER BY list_distance(x, y), vertex) AS k FROM pts, cen) WHERE k = 1",
    "project_to_segment": with_(PTS, CENTERS) + """, s AS (SELECT a.y AS a, b.y AS b FROM cen a, cen b WHERE a.vertex = 0 AND b.vertex = 1),
v AS (SELECT id, x, a, list_transform(list_zip(b, a), lambda z: z[1] - z[2]) AS ab, list_transform(list_zip(x, a), lambda z: z[1] - z[2]) AS ap FROM pts, s),
tt AS (SELECT *, greatest(0, least(1, list_dot_product(ap, ab) / list_dot_product(ab, ab))) AS t FROM v)
SELECT id, round(t, 6) AS t, round(list_distance(x, list_transform(list_zip(a, ab), lambda z: z[1] + t * z[2])), 6) AS d FROM tt""",
    "pairwise_corr_distance": with_(V1) + """, st AS (SELECT gene_id, sum(value) / any_value(n) AS m, sum(value * value) AS q, any_value(n) AS n FROM expr, nn GROUP BY gene_id),
dp AS (SELECT p.gene_id AS a, q.gene_id AS b, sum(p.value * q.value) AS ab FROM expr p JOIN expr q ON p.cell_id = q.cell_id AND p.gene_id < q.gene_id GROUP BY ALL)
SELECT x.gene_id AS a, y.gene_id AS b, round((1 - (coalesce(ab, 0) - x.n * x.m * y.m) / sqrt((x.q - x.n * x.m * x.m) * (y.q - y.n * y.m * y.m))) / 2, 6) AS d
FROM st x JOIN st y ON x.gene_id < y.gene_id LEFT JOIN dp ON dp.a = x.gene_id AND dp.b = y.gene_id""",
    "tree_pseudotime": "WITH RECURSIVE " + TREE + ", t(vertex, pseudotime, depth) AS (SELECT 1::BIGINT, 0::DOUBLE, 0::BIGINT UNION ALL SELECT child, pseudotime + weight, depth + 1 FROM t JOIN tree ON parent = vertex) SELECT vertex, round(pseudotime, 6) AS pseudotime, depth FROM t",
    "tree_branch_points": with_(TREE) + "SELECT vertex, count(*) AS degree, count(*) > 2 AS branch_point FROM (SELECT parent AS vertex FROM tree UNION ALL SELECT child FROM tree) GROUP BY vertex",
    "branch_stretch": with_(BC) + """, b AS (SELECT cell_id, branch, progenitor, pseudotime * (1 - 0.2::DOUBLE * branch) AS pseudotime FROM bc), st AS (SELECT branch, max(pseudotime) AS stop FROM b GROUP BY branch), sp AS (SELECT max(pseudotime) AS s FROM b WHERE progenitor), lo AS (SELECT max(stop) AS l FROM st)
SELECT cell_id, branch, round(100 * CASE WHEN progenitor OR stop <= s THEN pseudotime ELSE s + (pseudotime - s) * (l - s) / (stop - s) END / l, 6) AS pseudotime FROM b JOIN st USING (branch), sp, lo""",
    "sequential_split": with_(BC) + """, p AS (SELECT cell_id, row_number() OVER (ORDER BY pseudotime, cell_id) AS k FROM bc WHERE progenitor)
SELECT cell_id::VARCHAR AS cell_id, cell_id AS original_cell_id, branch::BIGINT AS branch FROM bc WHERE NOT progenitor UNION ALL SELECT cell_id::VARCHAR, cell_id, (k - 1) % 2 FROM p UNION ALL SELECT 'duplicate_root', cell_id, 1 FROM p WHERE k = 1""",
    "progenitor_duplicate": with_(BC) + """SELECT cell_id::VARCHAR AS cell_id, cell_id AS original_cell_id, branch::BIGINT AS branch FROM bc WHERE NOT progenitor
UNION ALL SELECT 'duplicate_' || b || '_' || cell_id, cell_id, b FROM bc, range(0, 2) AS u(b) WHERE progenitor""",
    "abc_area": with_(CURVES) + "SELECT gene_id, round(round(sum((x + nx) / 2 * 2.0), 3), 2) AS abc FROM (SELECT gene_id, a - b AS x, lead(a - b) OVER (PARTITION BY gene_id ORDER BY grid_idx) AS nx FROM curves) GROUP BY gene_id",
    "ilr_clip": with_(ILR) + "SELECT gene_id, grid_idx, round(ilr, 6) AS ilr FROM ilr",
    "branch_divergence": with_(ILR) + "SELECT gene_id, round(max(abs(ilr)), 6) AS divergence FROM ilr GROUP BY gene_id",
    "bifurcation_point": with_(ILR) + """, t AS (SELECT *, lead(ilr) OVER (PARTITION BY gene_id ORDER BY grid_idx) AS nx FROM ilr),
m AS (SELECT gene_id, sign(sum(ilr)) AS sg FROM ilr GROUP BY gene_id), tp AS (SELECT gene_id, grid_idx AS top FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY abs(ilr) DESC, grid_idx) AS k FROM ilr) WHERE k = 1)
SELECT gene_id, (max(grid_idx) FILTER (WHERE ilr * nx <= 0 AND grid_idx < top) * any_value(sg))::DOUBLE AS point FROM t JOIN m USING (gene_id) JOIN tp USING (gene_id) GROUP BY gene_id""",
    "positive_cells": with_(V1, SF, GRID) + "SELECT gene_id, region, count(*) FILTER (WHERE round_even(x, 0)::DOUBLE > 20) AS target, round(100.0::DOUBLE * count(*) FILTER (WHERE round_even(x, 0)::DOUBLE > 20) / count(*), 6) AS percent FROM grid GROUP BY ALL",
    "jitter_data": with_(V1, SF, GRID) + "SELECT gene_id, cell_id, region, round(greatest(0.1, round_even(x, 0)::DOUBLE), 6) AS expression FROM grid",
    "violin_data": with_(V1, SF, GRID) + "SELECT gene_id, cell_id, round(greatest(0.1, x), 6) AS expression FROM grid",
    "jitter_mean": with_(V1, SF, GRID) + """, e AS (SELECT gene_id, region, avg(x) AS m, coalesce(stddev_samp(x) / sqrt(count(*)), 0) AS se FROM (SELECT gene_id, region, greatest(0.1, round_even(x, 0)::DOUBLE) AS x FROM grid) GROUP BY ALL)
SELECT gene_id, region, round(m, 6) AS mean, round(m - 1.96 * se, 6) AS low, round(m + 1.96 * se, 6) AS high FROM e""",
    "coexpression_pairs": with_(V1, LEAD) + """, gr AS (SELECT gene_id, k, cell_id, coalesce(value, 0) AS v FROM (SELECT gene_id, k, cell_id FROM led, cells WHERE k <= 30) LEFT JOIN expr USING (gene_id, cell_id))
SELECT p.cell_id, p.gene_id AS row_gene, p.v AS row_value, q.gene_id AS column_gene, q.v AS column_value FROM gr p JOIN gr q USING (cell_id) WHERE p.k <= 10 AND (p.v > 0.1 OR q.v > 0.1)""",
    "trajectory_edges": with_(TREE, COORDS) + "SELECT parent, child, weight, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM tree LEFT JOIN coords a ON a.vertex = parent LEFT JOIN coords b ON b.vertex = child",
    "full_outer_edges": with_(TREE, COORDS) + "SELECT coalesce(parent, vertex) AS parent, child, x, y FROM tree FULL JOIN coords ON vertex = parent",
    "branch_minmax_pseudotime": with_(BC) + "SELECT cell_id, branch, round(100 * (pseudotime - min(pseudotime) OVER w) / (max(pseudotime) OVER w - min(pseudotime) OVER w), 6) AS pseudotime FROM bc WINDOW w AS (PARTITION BY branch)",
    "rotate_coords": with_(PTS) + "SELECT id, round(x[1] * cos(radians(30)) - x[2] * sin(radians(30)), 6) AS rx, round(x[1] * sin(radians(30)) + x[2] * cos(radians(30)), 6) AS ry FROM pts",
    "heat_matrix": with_(CURVES) + ", hv AS (SELECT gene_id, grid_idx, log10(a + 1) AS v FROM curves) " + HEAT,
    "branched_heat_matrix": with_(CURVES) + ", hv AS (SELECT gene_id, 49 - grid_idx AS grid_idx, log10(a + 1) AS v FROM curves UNION ALL SELECT gene_id, 50 + grid_idx, log10(b + 1) FROM curves) " + HEAT,
    "pseudotime_moving_mean": with_(EV) + "SELECT gene_id, cell_id, round(avg(value) OVER (PARTITION BY gene_id ORDER BY pseudotime, cell_id ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING), 8) AS smooth FROM ev",
    "rho_delta_plot": with_(DENS) + "SELECT id, round(rho, 5) AS rho, round(delta, 6) AS delta, rho >= 1 AND delta >= 8 AS peak FROM dens",
    "ordering_genes_plot": with_(V1, SF, MOM) + "SELECT gene_id, round(mu, 6) AS mean_expression, size > 25 AS use_for_ordering FROM mom JOIN genes USING (gene_id)",
    "melt_dcast_roundtrip": with_(V1) + "SELECT gene_id, region, sum(value) AS value FROM expr JOIN cells USING (cell_id) GROUP BY ALL",
    "contingency_fraction": with_(V1) + "SELECT region, nation, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY region), 6) AS share FROM cells GROUP BY region, nation",
    "subset_genes_cells": with_(V1) + "SELECT expr.* FROM expr JOIN genes USING (gene_id) JOIN cells USING (cell_id) WHERE brand = 'Brand#11' AND region = 'ASIA'",
    "set_operations": """WITH a AS (SELECT p_brand AS brand, p_type AS type FROM part WHERE p_size < 20), b AS (SELECT p_brand AS brand, p_type AS type FROM part WHERE p_size >= 15)
SELECT *, 'union' AS op FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT *, 'intersect' FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT DISTINCT *, 'setdiff' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""",
    "export_logged": with_(V1) + "SELECT gene_id, cell_id, round(log2(value + 1), 6) AS value FROM expr",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS gene_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "ecdf_at": with_(V1, MED) + "SELECT cell_id, round(avg((value <= t)::INT), 6) AS share FROM expr JOIN t USING (cell_id) GROUP BY cell_id",
    "normalized_matrix": with_(V1, SF) + """SELECT gene_id, cell_id, round(log2((2.0 + 0.2 * q + 2 * sqrt(0.1 * q * (2.0 + 0.1 * q))) / 0.4), 6) AS value
FROM (SELECT gene_id, cell_id, coalesce(value, 0) / size_factor AS q FROM (SELECT gene_id, cell_id FROM genes, cells WHERE size > 25) LEFT JOIN expr USING (gene_id, cell_id) JOIN sf USING (cell_id))""",
    "size_factors_mean_location": with_(V1) + """, wt AS (SELECT gene_id, count(*) / any_value(n) AS w, ln(sum(round_even(value, 0)::DOUBLE) / any_value(n)) AS lm FROM expr, nn WHERE value > 0 GROUP BY gene_id),
f AS (SELECT cell_id, exp(avg(w * (ln(round_even(value, 0)::DOUBLE) - lm))) AS f FROM expr JOIN wt USING (gene_id) GROUP BY cell_id)
SELECT cell_id, round(coalesce(f, 1), 6) AS size_factor FROM cells LEFT JOIN f USING (cell_id)""",
    "batch_baseline": with_(V1) + """, m AS (SELECT gene_id, region, coalesce(sum(value), 0) / any_value(nj) AS m FROM (SELECT gene_id, region, nj FROM (SELECT DISTINCT gene_id FROM expr), (SELECT region, count(*) AS nj FROM cells GROUP BY region))
LEFT JOIN (SELECT gene_id, region, value FROM expr JOIN cells USING (cell_id)) USING (gene_id, region) GROUP BY ALL)
SELECT m.gene_id, m.region, round(b.m - m.m, 6) AS baseline FROM m JOIN m b ON b.gene_id = m.gene_id AND b.region = (SELECT min(region) FROM cells)""",
    "value_quantiles": with_(V1) + "SELECT gene_id, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{round(100 * q)}" for q in (0.05, 0.25, 0.5, 0.95)) + " FROM expr GROUP BY gene_id",
    "first_gene_per_type": "SELECT p_type AS type, p_partkey AS gene_id, p_size AS size FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) = 1",
    "picked_genes": "SELECT position, gene_id, p_brand AS brand FROM (VALUES (0, 7), (1, 3), (2, 3), (3, 100), (4, -1)) AS w(position, gene_id) LEFT JOIN part ON p_partkey = gene_id",
    "genes_in_pseudotime": with_(V1, SF, GRID) + """, e AS (SELECT gene_id, cell_id, region, greatest(0.1, round_even(x, 0)::DOUBLE) AS x FROM grid JOIN genes USING (gene_id) WHERE size > 45)
SELECT gene_id, cell_id, round(x, 6) AS expression, round(avg(x) OVER (PARTITION BY gene_id, region), 6) AS expectation FROM e""",
    "cell_clusters_plot": with_(V1, LEAD) + "SELECT cell_id, acctbal AS x, (cell_id % 7)::DOUBLE AS y, region, gene_id, round(log10(value + 0.1), 6) AS log_value FROM cells JOIN expr USING (cell_id) JOIN led USING (gene_id) WHERE k <= 5",
    "classify_cells_enriched": with_(V1, GATES) + f""", o AS (SELECT avg(a::INT) AS oa, avg(b::INT) AS ob, avg(a1::INT) AS oa1, avg(a2::INT) AS oa2, avg(c::INT) AS oc FROM gt),
s AS (SELECT nation, avg(a::INT) > least(1, 1.2 * any_value(oa)) AS a, avg(b::INT) > least(1, 1.2 * any_value(ob)) AS b, avg(a1::INT) > least(1, 1.2 * any_value(oa1)) AS a1,
  avg(a2::INT) > least(1, 1.2 * any_value(oa2)) AS a2, avg(c::INT) > least(1, 1.2 * any_value(oc)) AS c FROM gt, o GROUP BY nation),
ty AS (SELECT nation, {TYPE} AS "CellType" FROM s) SELECT cell_id, nation, "CellType" FROM cells JOIN ty USING (nation)""",
    "container_import": with_(V1) + "SELECT gene_id, cell_id, round(value, 6) AS value FROM expr JOIN cells USING (cell_id) WHERE region = 'ASIA'",
    "matrix_directory_roundtrip": with_(V1) + "SELECT gene_id, cell_id, value::DOUBLE AS value FROM expr",
    "sheet_roundtrip": with_(V1) + "SELECT cell_id, region, nation, acctbal::DOUBLE AS acctbal FROM cells",
    "logged_export_roundtrip": with_(V1) + "SELECT gene_id, cell_id, round(value, 6) AS value FROM expr",
    "spike_in_molecules": "SELECT p_partkey AS gene_id, round(p_size * 10.0::DOUBLE * 1e-3 / 40000.0 * 1e-18 * 6.02214129e23, 6) AS molecules FROM part",
    "calibration_lines": with_(V1, MED) + """, l AS (SELECT cell_id, (log10(10) - 2.3::DOUBLE) / (log10(t) - 3.65::DOUBLE) AS k FROM t)
SELECT gene_id, cell_id, round(k, 6) AS k, round(2.3::DOUBLE - 3.65::DOUBLE * k, 6) AS b, round(pow(10, k * log10(value) + 2.3::DOUBLE - 3.65::DOUBLE * k), 4) AS value FROM expr JOIN l USING (cell_id)""",
    "marker_test": with_(V1, SF) + f""", gm AS (SELECT cell_id, coalesce(sum(value) FILTER (WHERE gene_id = 1), 0) > 0 AS a, coalesce(sum(value) FILTER (WHERE gene_id = 2), 0) > 0 AS b FROM cells LEFT JOIN expr USING (cell_id) GROUP BY cell_id),
ce AS (SELECT cell_id, CASE WHEN a THEN 'A' ELSE 'B' END AS ty FROM gm WHERE a <> b), nc AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT ty) AS lv FROM ce),
hint AS (SELECT gene_id, 1 / (0.1 + 1.0 / (sum(round_even(value, 0)::DOUBLE) / any_value(nc.n))) AS k FROM expr JOIN ce USING (cell_id), nc GROUP BY gene_id HAVING sum(value) > 0),
yy AS (SELECT gene_id, ty, sum(round_even(value / size_factor, 0)::DOUBLE) AS s FROM expr JOIN sf USING (cell_id) JOIN ce USING (cell_id) GROUP BY ALL),
sz AS (SELECT ty, count(*)::DOUBLE AS nj FROM ce GROUP BY ty),
mm AS (SELECT gene_id, ty, nj, k, coalesce(s, 0) / nj AS m FROM (SELECT gene_id, k, ty, nj FROM hint, sz) LEFT JOIN yy USING (gene_id, ty)),
ll AS (SELECT gene_id, sum(nj * ({XLY.format(x="m", y="m")} - (m + k) * ln(m + k))) AS l1, sum(nj) AS nt, sum(nj * m) / sum(nj) AS m0, any_value(k) AS k FROM mm GROUP BY gene_id),
lr AS (SELECT gene_id, greatest(0, 2 * (l1 - nt * ({XLY.format(x="m0", y="m0")} - (m0 + k) * ln(m0 + k)))) AS lr FROM ll),
pv AS (SELECT g.gene_id, CASE WHEN lr IS NULL THEN 'FAIL' ELSE 'OK' END AS status, 'negbinomial.size' AS family, lr, coalesce({TAIL[1]}, 1) AS pval FROM genes g LEFT JOIN lr USING (gene_id))""" + BH,
    "de_binomial_quality": binomial_test("cells AS (SELECT doc_id AS cell_id, quality FROM labels SEMI JOIN documents USING (doc_id) WHERE quality IS NOT NULL)", "quality", TAIL[1]),
    "de_binomial_lang": binomial_test("cells AS (SELECT doc_id AS cell_id, lang FROM documents WHERE lang IS NOT NULL)", "lang", TAIL[3]),
    "compare_models": with_(V1) + f""", sz AS (SELECT region, count(*)::DOUBLE AS nj FROM cells GROUP BY region), yy AS (SELECT gene_id, region, sum(value) AS s, sum(value * value) AS ss FROM expr JOIN cells USING (cell_id) GROUP BY ALL),
a AS (SELECT gene_id, sum(ss) AS ss, sum(s) AS s, sum(s * s / nj) AS bt FROM yy JOIN sz USING (region) GROUP BY gene_id),
lr AS (SELECT gene_id, greatest(0, n * ln((ss - s * s / n) / (ss - bt))) AS lr FROM a, nn WHERE ss - bt > 1e-12),
pv AS (SELECT gene_id, 'OK' AS status, {TAIL[4]} AS pval FROM lr), rk AS (SELECT *, row_number() OVER (ORDER BY pval, gene_id) AS rk, count(*) OVER () AS nt FROM pv)
SELECT gene_id, status, round(pval, 6) AS pval, round(least(1, min(pval * nt / rk) OVER (ORDER BY pval DESC, gene_id DESC ROWS UNBOUNDED PRECEDING)), 6) AS qval FROM rk""",
    "balanced_downsample": with_(V1) + """, k AS (SELECT cell_id, region, row_number() OVER (PARTITION BY region ORDER BY md5(cell_id::VARCHAR || '|2016'), cell_id) AS k FROM cells)
SELECT cell_id, region FROM k WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM cells GROUP BY region))""",
    "branch_data_set": with_(EV) + """, bk AS (SELECT floor(pseudotime)::BIGINT * 2 + branch AS cell_id, avg(pseudotime) AS pseudotime, any_value(branch) AS branch FROM ev GROUP BY ALL),
c AS (SELECT cell_id, pseudotime, branch, least(floor(pseudotime / 10), 9) < 3 AS progenitor FROM bk),
st AS (SELECT branch, max(pseudotime) AS stop FROM (SELECT pseudotime, CASE WHEN progenitor THEN 0 ELSE branch END AS branch FROM c) GROUP BY branch), sp AS (SELECT max(pseudotime) AS s FROM c WHERE progenitor), lo AS (SELECT max(stop) AS l FROM st),
t AS (SELECT cell_id, c.branch, progenitor, c.pseudotime AS raw, 100 * CASE WHEN progenitor OR stop <= s THEN c.pseudotime ELSE s + (c.pseudotime - s) * (l - s) / (stop - s) END / l AS pseudotime
  FROM c JOIN st ON st.branch = CASE WHEN progenitor THEN 0 ELSE c.branch END, sp, lo),
p AS (SELECT *, row_number() OVER (ORDER BY pseudotime, cell_id) AS k FROM t WHERE progenitor)
SELECT cell_id::VARCHAR AS cell_id, cell_id AS original_cell_id, branch::VARCHAR AS branch, round(pseudotime, 6) AS pseudotime FROM t WHERE NOT progenitor
UNION ALL SELECT cell_id::VARCHAR, cell_id, ((k - 1) % 2)::VARCHAR, round(pseudotime, 6) FROM p UNION ALL SELECT 'duplicate_root', cell_id, '1', round(pseudotime, 6) FROM p WHERE k = 1""",
    "scaled_tree_pseudotime": """WITH v(vertex, d) AS (SELECT k::BIGINT, k FROM range(0, 3) AS r(k) UNION ALL SELECT 10 * b + k, 3 + k FROM range(1, 3) AS s(b), range(0, 7) AS r(k))
SELECT vertex, d * 100.0::DOUBLE / 9 AS pseudotime FROM v""",
}


def _fisher(table: str, name: str, a: str, e: str, first: str, steps: int = 11) -> str:
    """Steps of the curve's regression over ``table`` (mu, disp) from (a, e) of ``first``; a step that no longer moves stays."""
    out = f"{name}0 AS (SELECT {a} AS a, {e} AS e, false AS done, {a} AS a0, {e} AS e0 FROM {first})"
    for k in range(steps):
        out += f""",
{name}s{k} AS (SELECT any_value(a) AS pa, any_value(e) AS pe, any_value(done) AS pd, any_value(a0) AS pa0, any_value(e0) AS pe0, sum(1 / (f * f)) AS s0, sum(1 / (f * f) / mu) AS s1, sum(1 / (f * f) / mu / mu) AS s2, sum(disp / (f * f)) AS s3, sum(disp / (f * f) / mu) AS s4
  FROM (SELECT mu, disp, a, e, done, a0, e0, a + e / mu AS f FROM {table}, {name}{k}) WHERE disp / f > 1e-6 AND disp / f < 1e4),
{name}n{k} AS (SELECT *, greatest((s2 * s3 - s1 * s4) / (s0 * s2 - s1 * s1), 1e-6) AS na, (s0 * s4 - s1 * s3) / (s0 * s2 - s1 * s1) AS ne FROM {name}s{k}),
{name}{k + 1} AS (SELECT CASE WHEN pd THEN pa ELSE na END AS a, CASE WHEN pd THEN pe ELSE ne END AS e, pd OR pow(ln(na / pa), 2) + pow(ln(greatest(ne, 1e-300) / greatest(pe, 1e-300)), 2) < 1e-6 AS done,
  CASE WHEN pd THEN pa0 ELSE pa END AS a0, CASE WHEN pd THEN pe0 ELSE pe END AS e0 FROM {name}n{k})"""
    return out


#: ``a0`` and ``e0`` are the curve of the last step that was made, whose rows are the last good set.
ORACLES["dispersion_fit"] = with_(V1, SF, MOM) + ", pos AS (SELECT mu, disp FROM mom WHERE disp > 0), one AS (SELECT 0.1::DOUBLE AS a, 1.0::DOUBLE AS e), " + _fisher("pos", "f", "a", "e", "one") + """,
w AS (SELECT mu, disp, a + e / mu AS f, disp / (a0 + e0 / mu) > 1e-6 AND disp / (a0 + e0 / mu) < 1e4 AS good, count(*) OVER () AS n, sum(1 / pow(a + e / mu, 2)) OVER () AS s0, sum(1 / pow(a + e / mu, 2) / mu) OVER () AS s1, sum(1 / pow(a + e / mu, 2) / mu / mu) OVER () AS s2 FROM pos, f11),
h AS (SELECT *, 1 / (f * f) * (s2 - 2 / mu * s1 + s0 / mu / mu) / (s0 * s2 - s1 * s1) AS hat FROM w),
kept AS (SELECT mu, disp FROM h WHERE good AND pow((disp - f) / f, 2) * hat / (2 * pow(1 - hat, 2)) <= 4.0::DOUBLE / n), """ + _fisher("kept", "g", "a", "e", "f11") + """
SELECT round(a, 6) AS asympt_disp, round(e, 6) AS extra_pois FROM g11"""
