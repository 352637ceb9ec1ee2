"""Linear models, grey forecast and principal components, from distributed second moments."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.columns import all_present, col
from ..functions.linalg import Gram, fixed_signs, varimax
from ..model import ROW_ID, Chart, Metric, Result, Table, data_error
from ..plans.cores import moments, pooled
from ..plans.features import Design, complete, design
from ..plans.order import order_keys, shifted, with_position
from ..plans.registry import ANY, BOTH, CATEGORICAL, DISCRETE, NUMERIC, ORDERING, QUANTITATIVE, Constraint, Run, Slot, disjoint, operator

MODULE = "statistical_models"
PREDICTIONS, SCORES, CHART_ROWS = 500, 1000, 1000
_Y = Slot("y_column", NUMERIC, QUANTITATIVE, 1, 1)
_X = Slot("x_columns", DISCRETE, BOTH)
_INTERCEPT = {"include_intercept": {"type": "boolean", "default": True}}
_LEVEL = {"confidence_level": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 1, "default": 0.95}}
_APART = (disjoint("y_column", "x_columns"),)


def fit_ols(gram: Gram, names: list[str], level: float = 0.95) -> dict[str, Any]:
    """Coefficient table and overall statistics of ordinary least squares."""
    k = len(names) + gram.intercept
    if gram.n <= k:
        raise data_error("too few rows for the parameters", rows=int(gram.n), parameters=k)
    w, b = gram.solve(names=names)
    rss = gram.residual_square(w)
    dof = int(gram.n - k)
    tss = gram.yy
    error = np.sqrt(np.diag(gram.inverse()) * rss / dof)
    beta = np.concatenate([[b], w]) if gram.intercept else w
    labels = (["intercept"] if gram.intercept else []) + names
    half = special.t_ppf(0.5 + level / 2, dof)
    rows = []
    for name, v, e in zip(labels, beta, error, strict=True):
        t = v / e if e else math.inf
        rows.append({"feature": name, "coefficient": float(v), "standard_error": float(e), "t_statistic": float(t), "p_value": special.t_tail(t, dof, "two_sided"), "confidence_lower": float(v - half * e), "confidence_upper": float(v + half * e)})
    model_dof = k - gram.intercept
    r2 = 1 - rss / tss if tss else math.nan
    f = ((tss - rss) / model_dof) / (rss / dof) if model_dof and rss else math.nan
    return {"rows": rows, "beta": w, "intercept": b, "rss": rss, "dof": dof, "r_squared": r2, "adjusted": 1 - (1 - r2) * (gram.n - gram.intercept) / dof, "f": f, "f_p": special.f_sf(f, model_dof, dof) if math.isfinite(f) else None, "n": int(gram.n)}


def linear(columns: list[Column], w: np.ndarray, b: float) -> Column:
    out = F.lit(float(b))
    for c, v in zip(columns, w, strict=True):
        out = out + c * F.lit(float(v))
    return out


def diagnostics(frame: DataFrame, made: Design, y: Column, predicted: Column, intercept: bool) -> dict[str, Any]:
    """Durbin-Watson in row order, Jarque-Bera and Breusch-Pagan of the residuals."""
    rows = frame.select(*(c.alias(f"f{i}") for i, c in enumerate(made.columns)), (y - predicted).alias("e"), ROW_ID)
    placed = shifted(with_position(rows, None), ["e"], [1])
    got = placed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col("e__1") - F.col("e"), 2)).alias("d"), F.sum(F.col("e") * F.col("e")).alias("s"), F.skewness("e").alias("g1"), F.kurtosis("e").alias("g2")).first()
    out: dict[str, Any] = {"durbin_watson": got["d"] / got["s"] if got["s"] else None}
    if got["g1"] is not None:
        jb = got["n"] / 6 * (got["g1"] ** 2 + got["g2"] ** 2 / 4)
        out |= {"jarque_bera": jb, "jarque_bera_p": math.exp(-jb / 2)}
    if intercept and got["s"]:
        square = moments(rows, [*(F.col(f"f{i}") for i in range(len(made.columns))), F.col("e") * F.col("e")])
        gram = Gram(square, True)
        w, _ = gram.solve()
        r2 = 1 - gram.residual_square(w) / gram.yy if gram.yy else 0.0
        out |= {"breusch_pagan": got["n"] * r2, "breusch_pagan_p": special.chi2_sf(got["n"] * r2, len(made.columns))}
    return out


def _model_frame(run: Run, y: str, xs: list[str]) -> tuple[DataFrame, int, Design]:
    df, dropped = complete(run, [y, *xs])
    if df.where(F.abs(col(y).cast("double")) == float("inf")).limit(1).count():
        raise data_error("column has infinite values", column=y)
    return df, dropped, design(run, df, xs)


def _scaling(found: Any, on: bool) -> tuple[np.ndarray, np.ndarray]:
    p = len(found.mean) - 1
    if not on:
        return np.ones(p), np.zeros(p)
    sd = np.sqrt(np.maximum(np.diag(found.cross)[:-1], 0) / found.n)
    return np.where(sd > 0, sd, 1.0), found.mean[:-1]


@operator("linear_regression.ols", MODULE, [_Y, _X], {**_INTERCEPT, "standardize_x": {"type": "boolean", "default": False}, **_LEVEL}, constraints=_APART)
def ols(run: Run) -> Result:
    """Least squares with inference and residual diagnostics."""
    y, p = run.column("y_column"), run.params
    df, dropped, made = _model_frame(run, y, run.columns("x_columns"))
    target = col(y).cast("double")
    found = moments(df, [*made.columns, target])
    scale, centre = _scaling(found, p["standardize_x"])
    columns = [(c - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(made.columns, centre, scale, strict=True)] if p["standardize_x"] else made.columns
    fit = fit_ols(Gram(found, p["include_intercept"]).scaled(scale, centre), made.names, p["confidence_level"])
    predicted = linear(columns, fit["beta"], fit["intercept"])
    table = df.select(F.col(ROW_ID).cast("string").alias("row_index"), target.alias("actual"), predicted.alias("predicted"), (target - predicted).alias("residual"), ROW_ID).orderBy(ROW_ID).drop(ROW_ID)
    metrics = [Metric("r_squared", fit["r_squared"]), Metric("adjusted_r_squared", fit["adjusted"]), Metric("f_statistic", fit["f"]), Metric("f_p_value", fit["f_p"])]
    checks = diagnostics(df, Design(made.names, columns, made.encoding, made.owner), target, predicted, p["include_intercept"])
    chart = [list(r) for r in table.select("predicted", "residual").limit(CHART_ROWS).collect()]
    return Result(metrics, [Table("coefficients", fit["rows"]), Table("predictions", table, limit=PREDICTIONS)], [Chart("residual_plot", "scatter", chart)], metadata={"sample_count": fit["n"], "dropped_rows": dropped, "categorical_encoding": made.encoding, **checks})


def _ridge(run: Run, alphas: list[float] | None) -> Result:
    y, p = run.column("y_column"), run.params
    df, dropped, made = _model_frame(run, y, run.columns("x_columns"))
    target = col(y).cast("double")
    curve: list[dict] = []
    if alphas is None:
        found = moments(df, [*made.columns, target])
        alpha = float(p["alpha"])
    else:
        folds = p["cv_folds"]
        by_fold = moments(df, [*made.columns, target], F.pmod(F.xxhash64(ROW_ID, F.lit(run.context.random_seed)), F.lit(folds)))
        found = pooled(list(by_fold.values()))
        if len(by_fold) < folds or found.n < 2 * folds:
            raise data_error("too few rows for the folds", rows=int(found.n))
        scale, centre = _scaling(found, p["standardize_x"])
        for a in alphas:
            errors = []
            for fold, held in by_fold.items():
                rest = Gram(pooled([m for f, m in by_fold.items() if f != fold]), p["include_intercept"]).scaled(scale, centre)
                w, b = rest.solve(a)
                raw = Gram(held, False).scaled(scale, centre)
                bias = raw.n * (b * b - 2 * b * raw.mean[-1] + 2 * b * float(w @ raw.mean[:-1]))
                errors.append((raw.residual_square(w) + bias) / raw.n)
            curve.append({"alpha": float(a), "mean_mse": float(np.mean(errors)), "std_mse": float(np.std(errors, ddof=1))})
        alpha = min(curve, key=lambda r: r["mean_mse"])["alpha"]
    scale, centre = _scaling(found, p["standardize_x"])
    gram = Gram(found, p["include_intercept"]).scaled(scale, centre)
    w, b = gram.solve(alpha, made.names)
    rss = gram.residual_square(w)
    total = float(found.cross[-1, -1])
    metrics = [Metric("alpha", alpha), Metric("training_mse", rss / gram.n), Metric("training_r_squared", 1 - rss / total if total else None)]
    rows = [{"feature": n, "coefficient": float(v)} for n, v in zip(made.names, w, strict=True)]
    return Result(metrics, [Table("ridge_coefficients", rows), Table("cv_curve", curve, ["alpha", "mean_mse", "std_mse"])], metadata={"intercept": b, "sample_count": int(gram.n), "dropped_rows": dropped, "categorical_encoding": made.encoding})


_RIDGE = {**_INTERCEPT, "standardize_x": {"type": "boolean", "default": True}}
operator("ridge_regression.fixed_alpha", MODULE, [_Y, _X], {"alpha": {"type": "number", "minimum": 0, "default": 1}, **_RIDGE}, constraints=_APART)(lambda run: _ridge(run, None))
operator("ridge_regression.cross_validated", MODULE, [_Y, _X], {"alpha_grid": {"type": "array", "items": {"type": "number", "minimum": 0}, "minItems": 1, "uniqueItems": True, "default": [0.01, 0.1, 1, 10, 100]}, "cv_folds": {"type": "integer", "minimum": 2, "maximum": 20, "default": 5}, **_RIDGE}, constraints=_APART)(lambda run: _ridge(run, run.params["alpha_grid"]))


@operator("hierarchical_regression.blockwise_ols", MODULE, [_Y, Slot("block_1", DISCRETE, BOTH), Slot("block_2", DISCRETE, BOTH), *(Slot(f"block_{i}", DISCRETE, BOTH, 0) for i in (3, 4, 5))], _INTERCEPT, constraints=(disjoint("y_column", *(f"block_{i}" for i in range(1, 6))),))
def hierarchical(run: Run) -> Result:
    """Cumulative blocks of predictors, all from one cross-product matrix."""
    y = run.column("y_column")
    blocks = [b for i in range(1, 6) if (b := run.columns(f"block_{i}"))]
    df, dropped, made = _model_frame(run, y, [c for b in blocks for c in b])
    target = col(y).cast("double")
    gram = Gram(moments(df, [*made.columns, target]), run.params["include_intercept"])
    models, coefficients, before, used = [], [], None, []
    for i, block in enumerate(blocks):
        used += block
        keep = [k for k, owner in enumerate(made.owner) if owner in used]
        fit = fit_ols(gram.subset(keep), [made.names[k] for k in keep])
        added = len(keep) - (before[1] if before else 0)
        delta = fit["r_squared"] - (before[0]["r_squared"] if before else 0.0)
        change = (delta / added) / ((1 - fit["r_squared"]) / fit["dof"]) if added and fit["r_squared"] < 1 else math.nan
        models.append({"block": i + 1, "added_fields": ", ".join(block), "r_squared": fit["r_squared"], "adjusted_r_squared": fit["adjusted"], "delta_r_squared": delta, "f_change": change, "f_change_p": special.f_sf(change, added, fit["dof"]) if math.isfinite(change) else None})
        coefficients += [{"block": i + 1, "feature": r["feature"], "coefficient": r["coefficient"], "p_value": r["p_value"]} for r in fit["rows"]]
        before = fit, len(keep)
    final, keep_all = before[0], list(range(len(made.names)))
    assert len(keep_all) == len(final["beta"])
    checks = diagnostics(df, made, target, linear(made.columns, final["beta"], final["intercept"]), False)
    return Result([Metric("final_r_squared", final["r_squared"]), Metric("block_count", len(blocks))], [Table("hierarchical_models", models), Table("hierarchical_coefficients", coefficients)], metadata={"sample_count": final["n"], "dropped_rows": dropped, "categorical_encoding": made.encoding, "durbin_watson": checks["durbin_watson"]})


#: Longest series of the grey model, which is meant for short ones.
GREY_ROWS, GREY_STEPS = 100_000, 100_000


def grey_model(series: np.ndarray, steps: int, coefficient: float, translate: bool) -> dict[str, Any]:
    """GM(1,1): fitted and forecast values of a positive series, moved up first if its level ratios are out of bounds."""
    n = len(series)
    low, high = math.exp(-2 / (n + 1)), math.exp(2 / (n + 1))

    def admissible(x: np.ndarray) -> bool:
        if (x <= 0).any():
            return False
        ratio = x[:-1] / x[1:]
        return bool((ratio > low).all() and (ratio < high).all())

    shift = 0.0
    if not admissible(series):
        if not translate:
            raise data_error("level ratios are out of bounds")
        start = max(0.0, -float(series.min()) + 1e-8)
        step = 0.1 * max(float(series.std()), 1.0)
        for k in range(GREY_STEPS):
            if admissible(series + start + k * step):
                shift = start + k * step
                break
        else:
            raise data_error("no shift makes the level ratios fit")
    x = series + shift
    total = np.cumsum(x)
    background = coefficient * total[1:] + (1 - coefficient) * total[:-1]
    design_matrix = np.column_stack([-background, np.ones(n - 1)])
    (a, u), *_ = np.linalg.lstsq(design_matrix, x[1:], rcond=None)
    k = np.arange(n + steps)
    if abs(a) < 1e-12:
        level = x[0] + u * k
    else:
        level = (x[0] - u / a) * np.exp(-a * k) + u / a
    restored = np.concatenate([[x[0]], np.diff(level)]) - shift
    return {"a": float(a), "u": float(u), "shift": shift, "fitted": restored[:n], "forecast": restored[n:]}


@operator("grey_forecast_gm11.basic", MODULE, [Slot("y_column", NUMERIC, QUANTITATIVE, 1, 1, allow_missing=False, finite_only=True), Slot("time_column", ORDERING, CATEGORICAL, 0, 1, unique_values=True)], {"forecast_steps": {"type": "integer", "minimum": 1, "maximum": 1000, "default": 1}, "background_value_coefficient": {"type": "number", "minimum": 0, "maximum": 1, "default": 0.5}, "translation_mode": {"type": "string", "enum": ["auto", "none"], "default": "auto"}}, constraints=(disjoint("y_column", "time_column"), Constraint("min_rows", value=4)))
def grey(run: Run) -> Result:
    """Grey forecast of a short ordered series, on the driver."""
    y, time, p = run.column("y_column"), run.optional("time_column"), run.params
    rows = run.df.select(col(y).cast("double").alias("y"), (col(time) if time else F.col(ROW_ID)).alias("t"), ROW_ID, *([col(time)] if time else [])).orderBy(*order_keys(time)).limit(GREY_ROWS + 1).collect()
    if len(rows) > GREY_ROWS:
        raise data_error("series is too long for a grey model", most=GREY_ROWS)
    actual = np.array([r["y"] for r in rows])
    g = grey_model(actual, p["forecast_steps"], p["background_value_coefficient"], p["translation_mode"] == "auto")
    residual = actual - g["fitted"]
    relative = np.abs(residual) / np.maximum(np.abs(actual), np.finfo(float).eps)
    sd = float(actual.std(ddof=1))
    fit = [{"time": r["t"], "actual": float(v), "fitted": float(f), "residual": float(e), "relative_error": float(q)} for r, v, f, e, q in zip(rows, actual, g["fitted"], residual, relative, strict=True)]
    result = Result(
        [Metric("development_coefficient", g["a"]), Metric("grey_action", g["u"]), Metric("posterior_ratio", float(residual.std(ddof=1)) / sd if sd else math.inf), Metric("small_error_probability", float(np.mean(np.abs(residual - residual.mean()) < 0.6745 * sd))), Metric("mean_relative_error", float(relative.mean()))],
        [Table("gm11_fit", fit), Table("gm11_forecast", [{"step": i + 1, "forecast": float(v)} for i, v in enumerate(g["forecast"])])],
        [Chart("gm11_series", "line", {"actual": actual.tolist(), "fitted": g["fitted"].tolist(), "forecast": g["forecast"].tolist()})],
        metadata={"translation": g["shift"], "sample_count": len(rows)},
    )
    if time is None:
        result.warn("ROW_ORDER_USED", "no time column is given; the current row order is used")
    if g["shift"]:
        result.warn("SEQUENCE_TRANSLATED", "the series was moved up before fitting", translation=g["shift"])
    return result


def components_of(found: Any, standardize: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (of columns scaled by their population deviation, with n - 1 below), vectors and scales."""
    if (np.diag(found.cross) <= 0).any():
        raise data_error("a column is constant")
    scale = np.sqrt(np.diag(found.cross) / found.n) if standardize else np.ones(len(found.mean))
    values, vectors = np.linalg.eigh(found.cross / (found.n - 1) / np.outer(scale, scale))
    order = np.argsort(values)[::-1]
    return np.maximum(values[order], 0.0), fixed_signs(vectors[:, order]), scale


def _pca(run: Run, threshold: bool) -> Result:
    xs, index, p = run.columns("x_columns"), run.optional("row_index"), run.params
    df = run.df
    if p["missing"] == "listwise":
        df = df.where(all_present(*xs))
        values = {c: col(c).cast("double") for c in xs}
    else:
        means = df.agg(*(F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(xs))).first()
        if any(m is None for m in means):
            raise data_error("a column has no values")
        values = {c: F.coalesce(col(c).cast("double"), F.lit(float(means[i]))) for i, c in enumerate(xs)}
    found = moments(df, [values[c] for c in xs])
    if found.n < 3:
        raise data_error("too few complete rows", count=int(found.n))
    eigen, vectors, scale = components_of(found, p["standardize"])
    k = max(1, int((eigen >= p["eigenvalue_threshold"]).sum())) if threshold else p["n_components"]
    if k > min(len(xs), found.n):
        raise data_error("more components than columns", components=k)
    weights, loadings = vectors[:, :k], vectors[:, :k] * np.sqrt(eigen[:k])
    if p["rotation"] == "varimax" and k > 1:
        loadings, rotation = varimax(loadings)
        weights = weights @ rotation
    ratio = eigen / eigen.sum()
    variance = [{"component": f"PC{i + 1}", "eigenvalue": float(eigen[i]), "explained_variance_ratio": float(ratio[i]), "cumulative_ratio": float(ratio[: i + 1].sum())} for i in range(k)]
    loading_rows = [{"variable": c} | {f"PC{j + 1}": float(loadings[i, j]) for j in range(k)} for i, c in enumerate(xs)]
    centred = [(values[c] - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(xs, found.mean, scale, strict=True)]
    label = col(index).cast("string") if index else F.col(ROW_ID).cast("string")
    scores = df.select(label.alias("row_index"), *(linear(centred, weights[:, j], 0.0).alias(f"PC{j + 1}") for j in range(k)), ROW_ID).orderBy(ROW_ID).drop(ROW_ID)
    result = Result([Metric("component_count", k), Metric("cumulative_explained_ratio", float(ratio[:k].sum()))], [Table("explained_variance", variance), Table("component_loadings", loading_rows), Table("component_scores", scores, limit=SCORES)], [Chart("scree_plot", "line", eigen.tolist())], metadata={"sample_count": int(found.n), "rotation": p["rotation"]})
    if found.n < 10 * len(xs):
        result.warn("LIMITED_SAMPLE_SIZE", "fewer than ten rows a column", count=int(found.n))
    return result


_PCA = {"missing": {"type": "string", "enum": ["listwise", "mean_impute"], "default": "listwise"}, "standardize": {"type": "boolean", "default": True}, "rotation": {"type": "string", "enum": ["none", "varimax"], "default": "none"}}
_PCA_SLOTS = [Slot("x_columns", NUMERIC, QUANTITATIVE, 2), Slot("row_index", ANY, CATEGORICAL, 0, 1)]
_PCA_APART = (disjoint("x_columns", "row_index"),)
operator("principal_component_analysis.fixed_components", MODULE, _PCA_SLOTS, {"n_components": {"type": "integer", "minimum": 1, "default": 2}, **_PCA}, constraints=_PCA_APART)(lambda run: _pca(run, False))
operator("principal_component_analysis.eigenvalue_threshold", MODULE, _PCA_SLOTS, {"eigenvalue_threshold": {"type": "number", "exclusiveMinimum": 0, "default": 1}, **_PCA}, constraints=_PCA_APART)(lambda run: _pca(run, True))
