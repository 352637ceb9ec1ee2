"""Kernels against published values, operators against plain numpy and pandas."""

import math

import numpy as np
import pandas as pd
import pytest

import fixtures
from statspark.functions import signal, special
from statspark.model import ROW_ID
from statspark.operators import cluster, describe
from statspark.plans.order import with_row_id
from statspark.runner import run_operation


def run(spark, key, pdf=None, slots=None, params=None):
    pdf = fixtures.build() if pdf is None else pdf
    base = fixtures.CASES[key]
    return run_operation(spark.createDataFrame(pdf).coalesce(1), fixtures.request(key, slots or base[0], base[1] if params is None else params, pdf))


def test_distribution_functions_match_published_values():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert special.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert 2 * special.t_sf(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert special.f_sf(4.9646027437307145, 1, 10) == pytest.approx(0.05, abs=1e-10)
    assert special.norm_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-10)
    assert special.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-9)
    assert special.poisson_sf(2, 3.0) == pytest.approx(1 - math.exp(-3) * (1 + 3 + 4.5), abs=1e-10)
    assert special.chi2_sf(4.0, 2) == pytest.approx(math.exp(-2), abs=1e-14)


def test_shapiro_matches_a_published_example():
    weights = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float)
    w, p = special.shapiro(weights)
    assert w == pytest.approx(0.79, abs=5e-3) and p == pytest.approx(0.007, abs=2e-3)


def test_shapiro_beyond_what_the_driver_takes(spark, monkeypatch):
    values = np.round(np.random.default_rng(5).gamma(9.0, size=60_001), 2)
    found = run(spark, "normality_test.shapiro", pd.DataFrame({"height": values}), {"x_columns": ["height"]}, {}).table("normality_test").rows()[0]
    w, p = special.shapiro(values)
    assert found["sample_count"] == 60_001 and found["statistic"] == pytest.approx(w, rel=1e-10) and found["p_value"] == pytest.approx(p, rel=1e-6)
    monkeypatch.setattr(describe, "SHAPIRO_ROWS", 5)
    for n in (6, 7, 11, 12, 40):
        few = pd.DataFrame({"height": [*values[:n], None, np.inf]})
        found = run(spark, "normality_test.shapiro", few, {"x_columns": ["height"]}, {}).table("normality_test").rows()[0]
        assert (found["statistic"], found["p_value"]) == pytest.approx(special.shapiro(values[:n]), rel=1e-9)


def test_kendall_counts_and_exact_p():
    rng = np.random.default_rng(0)
    y, w = rng.integers(0, 9, 60), rng.integers(1, 4, 60)
    brute = sum(int(w[i] * w[j]) for i in range(60) for j in range(i + 1, 60) if y[i] > y[j])
    assert special.weighted_inversions(y, w) == brute
    assert special.kendall_exact_p(4, 0, "two_sided") == pytest.approx(2 / 24)
    assert special.kendall_exact_p(5, 10, "less") == pytest.approx(1 / 120)


def test_filters_keep_constants_and_low_tones():
    flat = np.full(300, 3.5)
    ripple = 10 ** (-signal.RIPPLE_DB / 10)  # an even order passes constants at the foot of its ripple, twice
    assert np.allclose(signal.filtered(flat, 4, "iir", True), 3.5 * ripple, atol=1e-6)
    assert np.allclose(signal.filtered(flat, 4, "fir", True)[50:-50], 3.5, atol=1e-9)
    tone = np.sin(2 * np.pi * np.arange(600) / 60)
    assert np.abs(signal.filtered(tone, 4, "iir", True)[60:-60] - tone[60:-60]).max() < 0.02
    fast = np.sin(2 * np.pi * np.arange(600) / 4.1)
    assert np.abs(signal.filtered(fast, 4, "iir", True)[60:-60]).max() < 1e-2


def test_descriptive_statistics_match_pandas(spark):
    pdf = fixtures.build()
    rows = run(spark, "descriptive_statistics.basic", params={"statistics": ["count", "mean", "std", "variance", "q1", "median", "q3", "skewness", "kurtosis", "iqr", "standard_error"], "round_digits": 10}).table("descriptive_statistics").rows()
    for r in rows:
        x = pdf[r["field"]]
        expected = {"mean": x.mean(), "std": x.std(), "variance": x.var(), "q1": x.quantile(0.25), "median": x.median(), "q3": x.quantile(0.75), "skewness": x.skew(), "kurtosis": x.kurt(), "standard_error": x.sem()}
        for k, v in expected.items():
            assert r[k] == pytest.approx(v, abs=1e-9), k


def test_histograms_count_every_value_once(spark):
    pdf = fixtures.build().assign(acid=2.0)
    result = run(spark, "descriptive_statistics.basic", pdf, {"x_columns": ["height", "sugar", "acid"]})
    assert [sum(c.data["counts"]) for c in result.charts] == [fixtures.N] * 3
    x = pdf["height"]
    bins = len(result.charts[0].data["counts"])
    assert result.charts[0].data["counts"] == np.histogram(x, bins)[0].tolist() and bins == len(np.histogram_bin_edges(x, "auto")) - 1
    assert [w.code for w in result.warnings] == ["CONSTANT_COLUMN"]


def test_infinities_and_nans_count_as_missing(spark):
    pdf = fixtures.build()
    pdf.loc[0, "sugar"], pdf.loc[1, "sugar"] = float("inf"), float("nan")
    row = run(spark, "descriptive_statistics.basic", pdf, {"x_columns": ["sugar"]}).table("descriptive_statistics").rows()[0]
    assert (row["count"], row["missing"]) == (fixtures.N - 2, 2)


def test_least_squares_match_numpy(spark):
    pdf = fixtures.build()
    result = run(spark, "linear_regression.ols")
    x = np.column_stack([np.ones(fixtures.N), pdf["height"], pdf["girth"], *(pdf["bed"] == b for b in fixtures.BEDS[1:])]).astype(float)
    beta, rss, *_ = np.linalg.lstsq(x, pdf["yield_kg"], rcond=None)
    error = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (fixtures.N - 6))
    rows = result.table("coefficients").rows()
    assert [r["feature"] for r in rows] == ["intercept", "height", "girth", "bed=north", "bed=south", "bed=west"]
    assert np.allclose([r["coefficient"] for r in rows], beta, atol=1e-8)
    assert np.allclose([r["standard_error"] for r in rows], error, atol=1e-8)
    residual = pdf["yield_kg"] - x @ beta
    assert result.metadata["durbin_watson"] == pytest.approx((np.diff(residual) ** 2).sum() / (residual**2).sum(), abs=1e-8)
    z = np.linalg.lstsq(x, residual**2, rcond=None)[0]
    r2 = 1 - ((residual**2 - x @ z) ** 2).sum() / ((residual**2 - (residual**2).mean()) ** 2).sum()
    assert result.metadata["breusch_pagan"] == pytest.approx(fixtures.N * r2, abs=1e-6)


@pytest.mark.parametrize("intercept", [True, False])
@pytest.mark.parametrize("scaled", [True, False])
def test_ridge_matches_the_closed_form(spark, intercept, scaled):
    pdf = fixtures.build()
    result = run(spark, "ridge_regression.fixed_alpha", slots={"y_column": ["yield_kg"], "x_columns": ["height", "sugar"]}, params={"alpha": 2.5, "include_intercept": intercept, "standardize_x": scaled})
    x, y = pdf[["height", "sugar"]].to_numpy(), pdf["yield_kg"].to_numpy()
    if scaled:
        x = (x - x.mean(0)) / x.std(0)
    xc, yc = (x - x.mean(0), y - y.mean()) if intercept else (x, y)
    w = np.linalg.solve(xc.T @ xc + 2.5 * np.eye(2), xc.T @ yc)
    b = y.mean() - x.mean(0) @ w if intercept else 0.0
    assert np.allclose([r["coefficient"] for r in result.table("ridge_coefficients").rows()], w, atol=1e-8)
    assert result.metric("training_mse") == pytest.approx(((y - x @ w - b) ** 2).mean(), abs=1e-8)


@pytest.mark.parametrize("intercept", [True, False])
def test_fold_errors_from_moments_match_direct_ones(spark, intercept):
    pdf = fixtures.build()
    result = run(spark, "ridge_regression.cross_validated", params={"alpha_grid": [0.5], "cv_folds": 3, "include_intercept": intercept, "standardize_x": True})
    from pyspark.sql import functions as F

    folds = np.array([r[0] for r in spark.range(fixtures.N).select(F.pmod(F.xxhash64("id", F.lit(42)), F.lit(3))).collect()])
    x = np.column_stack([pdf["height"], pdf["girth"], *(pdf["bed"] == b for b in fixtures.BEDS[1:])]).astype(float)
    x, y = (x - x.mean(0)) / x.std(0), pdf["yield_kg"].to_numpy()
    errors = []
    for f in range(3):
        xt, yt = x[folds != f], y[folds != f]
        xm, ym = (xt.mean(0), yt.mean()) if intercept else (0.0, 0.0)
        w = np.linalg.solve((xt - xm).T @ (xt - xm) + 0.5 * np.eye(5), (xt - xm).T @ (yt - ym))
        errors.append(((y[folds == f] - ym - (x[folds == f] - xm) @ w) ** 2).mean())
    assert result.table("cv_curve").rows()[0]["mean_mse"] == pytest.approx(np.mean(errors), abs=1e-8)


def test_components_match_an_eigenproblem(spark):
    pdf = fixtures.build()
    x = pdf[["height", "girth", "sugar", "acid"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    result = run(spark, "principal_component_analysis.fixed_components", params={"n_components": 4})
    assert np.allclose([r["eigenvalue"] for r in result.table("explained_variance").rows()], values, atol=1e-9)
    scores = np.array([[r[f"PC{i}"] for i in range(1, 5)] for r in result.table("component_scores").rows()])
    assert np.allclose(np.cov(scores.T), np.diag(values), atol=1e-8)


def test_kappa_and_correlations_match_direct_sums(spark):
    pdf = fixtures.build()
    grid = pd.crosstab(pdf["judge_1"], pdf["judge_2"]).to_numpy(float)
    po, pe = np.trace(grid) / fixtures.N, (grid.sum(0) @ grid.sum(1)) / fixtures.N**2
    cohen = run(spark, "kappa_agreement.cohen", slots={"rater_columns": ["judge_1", "judge_2"]}, params={})
    assert cohen.metric("kappa") == pytest.approx((po - pe) / (1 - pe), abs=1e-10)
    rows = {(r["variable_1"], r["variable_2"]): r for r in run(spark, "correlation_analysis.pearson").tables[0].rows()}
    assert rows["sugar", "height"]["coefficient"] == pytest.approx(np.corrcoef(pdf["sugar"], pdf["height"])[0, 1], abs=1e-10)
    ranks = pdf["sugar"].rank(), pdf["grade"].map({v: i for i, v in enumerate(fixtures.GRADES)}).rank()
    spearman = {(r["variable_1"], r["variable_2"]): r for r in run(spark, "correlation_analysis.spearman").tables[0].rows()}
    assert spearman["sugar", "grade"]["coefficient"] == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=1e-10)


def brute_labels(x, eps, least, metric):
    """Density labels by all pairs."""
    gaps = np.abs(x[:, None] - x[None])
    d = gaps.sum(-1) if metric == "manhattan" else gaps.max(-1) if metric == "chebyshev" else np.sqrt((gaps * gaps).sum(-1))
    near = d <= eps
    core = near.sum(1) >= least
    label, k = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], k
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[j] = k
                    stack.append(j)
            k += 1
    for i in np.flatnonzero(~core):
        held = near[i] & core
        label[i] = label[held].min() if held.any() else -1
    return label, int(core.sum())


@pytest.mark.parametrize("width,eps,least,metric", [(2, 0.11, 6, "euclidean"), (1, 0.004, 3, "manhattan"), (2, 0.12, 5, "chebyshev"), (4, 0.5, 5, "euclidean"), (3, 0.45, 4, "manhattan")])
def test_density_labels_match_all_pairs(spark, width, eps, least, metric):
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.normal(0, 0.3, (300, width)), rng.normal(1.5, 0.2, (150, width)), rng.uniform(-2, 3, (100, width)), np.repeat(rng.uniform(-2, 3, (3, width)), 20, axis=0), np.round(rng.normal(0, 1, (60, width)), 1)])
    x = rng.permutation(x)
    rows = with_row_id(spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").coalesce(1))
    labels, cores = cluster.dbscan_labels(rows, eps, least, metric, width)
    expected, core = brute_labels(x, eps, least, metric)
    assert cores == core and [r["label"] for r in labels.orderBy(ROW_ID).collect()] == expected.tolist()


def test_density_work_grows_with_cells_not_with_pairs(spark):
    x = np.random.default_rng(3).normal(size=(4000, 2))
    rows = with_row_id(spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").coalesce(1))
    placed, cells = cluster.cells_of(rows, 1.0, "euclidean", 2)
    near = cluster.cell_pairs(cells, 1.0, "euclidean", 2).count()
    core, border = cluster.core_points(placed, cells, cluster.cell_pairs(cells, 1.0, "euclidean", 2), 1.0, 5, "euclidean")
    pairs = int((np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 1.0).sum())
    assert near <= 25 * cells.count() and 500 * near < pairs and core.count() + border.select(ROW_ID).distinct().count() <= 4000


def test_components_on_the_driver_and_beyond(spark, monkeypatch):
    edges = [(1, 5), (5, 9), (2, 3), (9, 4), (7, 7), (8, 6), (6, 2)]
    frame = spark.createDataFrame(edges + [(j, i) for i, j in edges], "i long, j long")
    nodes = spark.createDataFrame([(i,) for i in range(11)], "id long")
    for most in (100, 0):
        monkeypatch.setattr(cluster, "DRIVER_EDGES", most)
        got = dict(tuple(r) for r in cluster.connected(frame, nodes).collect())
        assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 1, 5: 1, 6: 2, 7: 7, 8: 2, 9: 1, 10: 10}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_touching_sets(metric):
    rng = np.random.default_rng(8)
    a, b = rng.uniform(0, 1, (900, 2)), rng.uniform(0, 1, (700, 2)) + [1.02, 0.3]
    gaps = np.abs(a[:, None] - b[None])
    least = {"manhattan": gaps.sum(-1), "chebyshev": gaps.max(-1)}.get(metric, np.sqrt((gaps * gaps).sum(-1))).min()
    assert cluster.touching(a, b, least, metric) and not cluster.touching(a, b, least * (1 - 1e-12), metric)


def test_poisson_statistic_and_density_labels(spark):
    result = run(spark, "poisson_goodness_of_fit.chi_square")
    rows = result.table("poisson_fit").rows()
    total = sum(r["observed"] for r in rows)
    assert sum(r["expected"] for r in rows) == pytest.approx(total, rel=1e-9)
    assert result.metric("chi_square") == pytest.approx(sum((r["observed"] - r["expected"]) ** 2 / r["expected"] for r in rows))
    pdf = pd.DataFrame({"height": [0.0, 0.1, 0.2, 5.0, 5.1, 5.2, 9.9], "girth": [0.0] * 3 + [5.0] * 3 + [0.5]})
    found = run(spark, "dbscan_clustering.standard", pdf, params={"eps": 0.5, "min_samples": 2, "standardize": False})
    assert [r["cluster_dbscan"] for r in found.data.orderBy("height").collect()] == [0, 0, 0, 1, 1, 1, -1]
    assert found.metric("noise_count") == 1


def test_silhouette_matches_pairwise_distances(spark):
    result = run(spark, "kmeans_clustering.standard", slots={"x_columns": ["height", "girth"]}, params={"n_init": 1})
    pdf = result.data.toPandas()
    x = pdf[["height", "girth"]].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    label = pdf["cluster_kmeans"].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    scores = []
    for i in range(len(x)):
        own = d[i, label == label[i]].sum() / ((label == label[i]).sum() - 1)
        other = min(d[i, label == c].mean() for c in set(label) - {label[i]})
        scores.append((other - own) / max(other, own))
    assert result.metric("silhouette") == pytest.approx(np.mean(scores), abs=1e-6)


def test_silhouette_shuffles_rows_and_not_sums(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, label = rng.normal(size=(900, 6)), rng.integers(0, 5, 900)
    x[label == 2] += 1.5
    points = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], f"{ROW_ID} long, x array<double>, label int").repartition(30)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    means = np.array([[d[i][label == c].sum() / ((label == c).sum() - (label[i] == c)) for c in range(5)] for i in range(900)])
    inside = means[np.arange(900), label].copy()
    means[np.arange(900), label] = np.inf
    expected = ((means.min(1) - inside) / np.maximum(means.min(1), inside)).mean()
    monkeypatch.setattr(cluster, "TASK_ROWS", 100)
    asked = []
    grouped = type(points).groupBy
    monkeypatch.setattr(type(points), "groupBy", lambda self, *c: (asked.append(c), grouped(self, *c))[1])
    for most in (None, 400):
        assert cluster.silhouette(points, 5, most) == pytest.approx(expected, abs=1e-9)
    assert ("query", "c") not in asked


def test_silhouette_takes_every_row(spark):
    from statspark.model import ROW_ID
    from statspark.operators.cluster import silhouette

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (2990, 2)), rng.normal(6, 1, (10, 2))])  # more rows than were once sampled, ten of them a cluster
    label = np.repeat([0, 1], [2990, 10])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    sums = np.stack([d[:, label == c].sum(1) for c in (0, 1)], 1)
    size, rows = np.array([2990, 10]), np.arange(len(x))
    own, other = sums[rows, label] / (size[label] - 1), sums[rows, 1 - label] / size[1 - label]
    exact = ((other - own) / np.maximum(own, other)).mean()
    points = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], f"{ROW_ID} long, x array<double>, label int").repartition(3)
    assert silhouette(points, 2) == pytest.approx(exact, abs=1e-12)
    assert silhouette(points, 2, query_rows=700) == pytest.approx(exact, abs=1e-12)


def test_average_precision_keeps_unlike_scores_apart(spark):
    from pyspark.sql import functions as F

    from statspark.operators.classify import CURVE_POINTS, curves

    n, top = 510_000, 100  # scores closer than 1e-5, the greatest ones positive
    scored = spark.range(n).select((F.col("id") * 1e-9).alias("s"), (F.col("id") >= n - top).alias("y"))
    roc, pr, ap = curves(scored, "s", F.col("y"))
    assert ap == pytest.approx(1.0, abs=1e-12)
    assert len(pr) == CURVE_POINTS and roc[-1] == [1.0, 1.0] and pr[-1] == pytest.approx([1.0, top / n])
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 50, 400) / 50, rng.integers(0, 2, 400)
    _, _, ap = curves(spark.createDataFrame(pd.DataFrame({"s": s, "y": y})), "s", F.col("y") == 1)
    expected, before = 0.0, 0.0
    for v in sorted(set(s), reverse=True):
        recall = y[s >= v].sum() / y.sum()
        expected, before = expected + (recall - before) * y[s >= v].mean(), recall
    assert ap == pytest.approx(expected, abs=1e-12)


def test_grey_forecast_follows_a_geometric_series(spark):
    forecast = run(spark, "grey_forecast_gm11.basic").table("gm11_forecast").rows()
    for i, r in enumerate(forecast):
        assert r["forecast"] == pytest.approx(40 * 1.01 ** (fixtures.N + i), rel=2e-3)
