"""Classifiers: logistic regression, naive Bayes and gradient-boosted trees, with one metric block."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical_text, col
from ..model import ROW_ID, Chart, Metric, Result, Table, data_error, parameter_error
from ..plans.cores import moments, ranked_counts, running_totals
from ..plans.features import Design, complete, design
from ..plans.order import POSITION, with_position
from ..plans.registry import BOTH, CATEGORICAL, DISCRETE, NUMERIC, QUANTITATIVE, Constraint, Run, Slot, disjoint, operator
from ..plans.storage import settled

MODULE = "ml_classification"
CURVE_POINTS, MOST_CLASSES = 1000, 1000
_Y = Slot("y_column", DISCRETE, CATEGORICAL, 1, 1, least_unique=2)
_APART = (disjoint("y_column", "x_columns"),)
_SPLIT = {"train_ratio": {"type": "number", "minimum": 0.5, "maximum": 0.95, "default": 0.8}}
_SHUFFLE = {"shuffle": {"type": "boolean", "default": True}}


def class_counts(df: DataFrame, label: Column) -> dict[str, int]:
    rows = df.groupBy(label.alias("y")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise data_error("too many classes", most=MOST_CLASSES)
    return {r["y"]: r["n"] for r in sorted(rows, key=lambda r: r["y"])}


def split(df: DataFrame, label: Column, ratio: float, seed: int, shuffle: bool = True) -> tuple[DataFrame, list[str]]:
    """``df`` with ``y`` (class place) and ``train``: stratified by rank of a row hash, or by order.

    The same rows are chosen for any partitioning, as ranks follow hash and row identity only.
    """
    counts = class_counts(df, label)
    classes, n = list(counts), sum(counts.values())
    if len(classes) < 2 or min(counts.values()) < 2:
        raise data_error("every class needs two rows", classes=len(classes))
    place = F.element_at(F.create_map(*(F.lit(v) for i, c in enumerate(classes) for v in (c, i))), label)
    coded = df.withColumn("y", place.cast("int"))
    if shuffle:
        take = {c: min(max(1, round(k * ratio)), k - 1) for c, k in counts.items()}
        draw = F.xxhash64(ROW_ID, F.lit(seed))
        share = F.element_at(F.create_map(*(F.lit(v) for i, c in enumerate(classes) for v in (i, take[c]))), F.col("y"))
        # Rank in the class: hash buckets are counted first, so that only one bucket is ranked in a window.
        buckets = max(1, n // 100_000)
        keyed = coded.withColumns({"__draw": draw, "__bucket": F.floor((draw.cast("double") / float(2**64) + 0.5) * buckets).cast("int")})
        sizes = keyed.groupBy("y", "__bucket").agg(F.count(F.lit(1)).alias("k"))
        before = sizes.withColumn("__before", F.coalesce(F.sum("k").over(Window.partitionBy("y").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
        rank = F.row_number().over(Window.partitionBy("y", "__bucket").orderBy("__draw", ROW_ID))
        ranked = keyed.withColumn("__rank", rank).join(before, ["y", "__bucket"]).withColumn("train", F.col("__before") + F.col("__rank") <= share)
        out = ranked.drop("__draw", "__bucket", "__rank", "__before")
        train_n = sum(take.values())
    else:
        train_n = min(max(1, int(n * ratio)), n - 1)
        out = with_position(coded, None).withColumn("train", F.col(POSITION) < train_n).drop(POSITION)
        seen = out.where("train").select("y").distinct().count()
        if seen < len(classes):
            raise data_error("the first rows miss a class; shuffle them")
    if train_n < len(classes) or n - train_n < len(classes):
        raise data_error("too few rows for the split", rows=n)
    return out, classes


def auc(scored: DataFrame, score: str, positive: Column) -> float | None:
    """Mann-Whitney area from mid-ranks of score counts."""
    rows = scored.select(F.col(score).alias("__v"), positive.cast("long").alias("p"))
    by_score = rows.groupBy("__v").agg(F.count(F.lit(1)).alias("__n"), F.sum("p").alias("p"))
    ranked = ranked_counts(by_score)
    got = ranked.agg(F.sum(F.col("__rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("__n").alias("n")).first()
    pos, neg = got["p"] or 0, (got["n"] or 0) - (got["p"] or 0)
    return None if not pos or not neg else (got["r"] - pos * (pos + 1) / 2) / (pos * neg)


def curves(scored: DataFrame, score: str, positive: Column) -> tuple[list, list, float | None]:
    """ROC and precision-recall points (thinned evenly beyond ``CURVE_POINTS``) and average precision over all distinct scores."""
    by_score = scored.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(positive.cast("long")).alias("p"))
    m, n, pos = by_score.agg(F.count(F.lit(1)), F.sum("n"), F.sum("p")).first()
    pos, neg = pos or 0, (n or 0) - (pos or 0)
    if not pos or not neg:
        return [], [], None
    upto = running_totals(by_score.withColumn("i", F.lit(1)), "s", ["p", "n", "i"], descending=True)
    table = upto.select("s", "p", F.col("p__upto").alias("tp"), F.col("n__upto").alias("k"), F.col("i__upto").alias("i"))
    ap = table.agg(F.sum(F.col("p") / pos * F.col("tp") / F.col("k"))).first()[0]
    if m > CURVE_POINTS:
        table = table.where(F.col("i").isin([int(i) + 1 for i in np.unique(np.linspace(0, m - 1, CURVE_POINTS).astype(int))]))
    points = table.orderBy("i").toPandas()
    roc = [[0.0, 0.0]] + [[float((k - tp) / neg), float(tp / pos)] for tp, k in zip(points["tp"], points["k"], strict=True)]
    pr = [[float(tp / pos), float(tp / k)] for tp, k in zip(points["tp"], points["k"], strict=True)]
    return roc, pr, ap


def confusion(predicted: DataFrame, k: int) -> np.ndarray:
    grid = np.zeros((k, k), np.int64)
    for r in predicted.groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n")).collect():
        grid[int(r["y"]), int(r["prediction"])] = r["n"]
    return grid


def report(grid: np.ndarray, classes: list[str]) -> list[dict[str, Any]]:
    """Precision, recall, F1 and support by class, then macro and weighted means."""
    hit, actual, said = np.diag(grid), grid.sum(1), grid.sum(0)
    precision = np.divide(hit, said, out=np.zeros(len(hit)), where=said > 0)
    recall = np.divide(hit, actual, out=np.zeros(len(hit)), where=actual > 0)
    f1 = np.divide(2 * precision * recall, precision + recall, out=np.zeros(len(hit)), where=precision + recall > 0)
    rows = [{"class": c, "precision": float(p), "recall": float(r), "f1": float(f), "support": int(n)} for c, p, r, f, n in zip(classes, precision, recall, f1, actual, strict=True)]
    weight = actual / actual.sum()
    for name, w in (("macro avg", np.full(len(hit), 1 / len(hit))), ("weighted avg", weight)):
        rows.append({"class": name, "precision": float(w @ precision), "recall": float(w @ recall), "f1": float(w @ f1), "support": int(actual.sum())})
    return rows


def evaluate(predicted: DataFrame, classes: list[str]) -> Result:
    """The metric block of a classifier from (y, prediction, probability array)."""
    k = len(classes)
    grid = confusion(predicted, k)
    if not grid.sum():
        raise data_error("no test rows")
    rows = report(grid, classes)
    chosen = rows[1] if k == 2 else rows[-1]
    result = Result([Metric("accuracy", float(np.trace(grid) / grid.sum())), Metric("precision", chosen["precision"]), Metric("recall", chosen["recall"]), Metric("f1", chosen["f1"])])
    result.tables = [Table("confusion_matrix", [{"actual": a, "predicted": b, "count": int(grid[i, j])} for i, a in enumerate(classes) for j, b in enumerate(classes)]), Table("classification_report", rows)]
    if k == 2:
        scored = predicted.select("y", F.get("probability", 1).alias("s"))
        roc, pr, _ = curves(scored, "s", F.col("y") == 1)
        result.metrics.append(Metric("roc_auc", auc(scored, "s", F.col("y") == 1)))
        result.charts = [Chart("roc_curve", "line", roc), Chart("pr_curve", "line", pr)]
    else:
        areas = [auc(predicted.select("y", F.get("probability", i).alias("s")), "s", F.col("y") == i) for i in range(k)]
        support = grid.sum(1)
        held = [(a, n) for a, n in zip(areas, support, strict=True) if a is not None]
        result.metrics.append(Metric("roc_auc_ovr_weighted", sum(a * n for a, n in held) / sum(n for _, n in held) if len(held) == k else None))
    return result


def _frame(run: Run) -> tuple[DataFrame, int, Column]:
    y = run.column("y_column")
    df, dropped = complete(run, [y, *run.columns("x_columns")])
    return df, dropped, canonical_text(col(y), df.schema[y].dataType)


def logistic_fit(train: DataFrame, n: int, regularization: str, c: float, max_iter: int):
    """C sum log-loss + penalty, as Spark's mean loss with weight 1 / (C n) on the penalty."""
    weight = 0.0 if regularization == "none" else 1 / (c * n)
    return LogisticRegression(featuresCol="features", labelCol="y", maxIter=max_iter, tol=1e-9, regParam=weight, elasticNetParam=1.0 if regularization == "l1" else 0.0, standardization=False, family="binomial").fit(train)


def _scaled(df: DataFrame, made: Design, run: Run, on: bool) -> list[Column]:
    """Quantitative columns scaled by the training rows."""
    if not on:
        return made.columns
    found = moments(df.where("train"), made.columns)
    sd = np.sqrt(np.maximum(np.diag(found.cross), 0) / found.n)
    return [(c - F.lit(float(m))) / F.lit(float(s) or 1.0) if not run.is_categorical(o) else c for c, o, m, s in zip(made.columns, made.owner, found.mean, sd, strict=True)]


@operator("logistic_regression.binary_gradient_descent", MODULE, [Slot("y_column", DISCRETE, CATEGORICAL, 1, 1, least_unique=2, most_unique=2), Slot("x_columns", DISCRETE, BOTH)], {**_SPLIT, **_SHUFFLE, "cv_folds": {"type": "integer", "enum": [0, 3, 4, 5], "default": 0}, "standardize_numeric": {"type": "boolean", "default": True}, "regularization": {"type": "string", "enum": ["none", "l1", "l2"], "default": "l2"}, "c": {"type": "number", "exclusiveMinimum": 0, "default": 1}, "max_iter": {"type": "integer", "minimum": 100, "maximum": 100000, "default": 1000}}, constraints=(*_APART, Constraint("exact_category_count", ("y_column",), 2)))
def logistic(run: Run) -> Result:
    """Two-class logistic regression with a held-out part and optional folds."""
    p = run.params
    df, dropped, label = _frame(run)
    made = design(run, df, run.columns("x_columns"))
    rows, classes = split(df, label, p["train_ratio"], run.context.random_seed, p["shuffle"])
    rows = settled(rows)
    columns = _scaled(rows, made, run, p["standardize_numeric"])
    vectors = rows.select("y", "train", array_to_vector(F.array(*columns)).alias("features")).persist()
    train = vectors.where("train")
    model = logistic_fit(train, train.count(), p["regularization"], p["c"], p["max_iter"])
    test = model.transform(vectors.where("not train")).select("y", F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability").alias("probability"))
    result = evaluate(settled(test), classes)
    vectors.unpersist()
    weights = [("intercept", float(model.intercept)), *zip(made.names, (float(v) for v in model.coefficients), strict=True)]
    result.tables.append(Table("coefficients", [{"feature": n, "coefficient": v, "odds_ratio": math.exp(min(v, 700))} for n, v in weights]))
    if p["cv_folds"]:
        result.tables.append(Table("cross_validation", _folds(run, rows, made, classes)))
    result.metadata = {"classes": classes, "positive_class": classes[1], "dropped_rows": dropped, "categorical_encoding": made.encoding}
    return result


def _folds(run: Run, rows: DataFrame, made: Design, classes: list[str]) -> list[dict[str, Any]]:
    """Accuracy of hash folds on unscaled features."""
    p, k = run.params, run.params["cv_folds"]
    plain = rows.select("y", array_to_vector(F.array(*made.columns)).alias("features"), F.pmod(F.xxhash64(ROW_ID, F.lit(run.context.random_seed + 7)), F.lit(k)).alias("fold")).persist()
    out = []
    for fold in range(k):
        train, test = plain.where(F.col("fold") != fold), plain.where(F.col("fold") == fold)
        if train.select("y").distinct().count() < len(classes) or not test.limit(1).count():
            raise data_error("a fold misses a class", fold=fold + 1)
        model = logistic_fit(train, train.count(), p["regularization"], p["c"], p["max_iter"])
        out.append({"fold": fold + 1, "accuracy": model.transform(test).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]})
    plain.unpersist()
    return out


def normalised_scores(logs: list[Column]) -> Column:
    """Class probabilities from log scores, shifted by the greatest."""
    scores = F.array(*logs)
    top = F.array_max(scores)
    raised = F.transform(scores, lambda v: F.exp(v - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raised, lambda v: v / total)


def _predicted(rows: DataFrame, logs: list[Column]) -> DataFrame:
    test = rows.where("not train").select("y", F.array(*logs).alias("logs"), normalised_scores(logs).alias("probability"))
    return settled(test.select("y", (F.array_position("logs", F.array_max("logs")) - 1).cast("int").alias("prediction"), "probability"))


def gaussian_parts(rows: DataFrame, columns: list[str]) -> dict[int, dict[str, Any]]:
    """n, mean and population variance by class of the training rows."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        aggs += [F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}"), F.var_samp(v).alias(f"s{i}")]
    return {r["y"]: r.asDict() for r in rows.where("train").groupBy("y").agg(*aggs).collect()}


def gaussian_logs(parts: dict[int, dict[str, Any]], columns: list[str], k: int, extra: float, sample_variance: bool = False, priors: list[float] | None = None) -> list[Column]:
    total = sum(p["n"] for p in parts.values())
    logs = []
    for y in range(k):
        p = parts[y]
        score = F.lit(priors[y] if priors else math.log(p["n"] / total))
        for i, c in enumerate(columns):
            var = (p[f"s{i}"] if sample_variance else p[f"v{i}"]) + extra
            score = score + F.lit(-0.5 * math.log(2 * math.pi * var)) - F.lit(0.5 / var) * F.pow(col(c).cast("double") - F.lit(p[f"m{i}"]), 2)
        logs.append(score)
    return logs


@operator("naive_bayes_classification.gaussian", MODULE, [_Y, Slot("x_columns", NUMERIC, QUANTITATIVE)], {**_SPLIT, **_SHUFFLE, "var_smoothing": {"type": "number", "exclusiveMinimum": 0, "default": 1e-9}}, constraints=_APART)
def gaussian(run: Run) -> Result:
    """Gaussian naive Bayes from class means and variances."""
    xs, p = run.columns("x_columns"), run.params
    df, dropped, label = _frame(run)
    design(run, df, xs)
    rows, classes = split(df, label, p["train_ratio"], run.context.random_seed, p["shuffle"])
    rows = settled(rows)
    parts = gaussian_parts(rows, xs)
    spread = rows.where("train").agg(*(F.var_pop(col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(xs))).first()
    extra = p["var_smoothing"] * max(spread)
    if extra <= 0:
        raise data_error("all columns are constant in the training rows")
    result = evaluate(_predicted(rows, gaussian_logs(parts, xs, len(classes), extra)), classes)
    result.tables.append(Table("condition_summary", [{"class": cls, "feature": c, "mean": parts[y][f"m{i}"], "variance": parts[y][f"v{i}"] + extra} for y, cls in enumerate(classes) for i, c in enumerate(xs)]))
    result.metadata = {"classes": classes, "dropped_rows": dropped}
    return result


def category_logs(rows: DataFrame, columns: list[str], k: int, alpha: float) -> tuple[dict[str, Column], list[dict], dict[int, int]]:
    """Smoothed log-probabilities of categories as literal maps; all categories of the frame count."""
    sizes = {r["y"]: r["n"] for r in rows.where("train").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    maps, table = {}, []
    for c in columns:
        text = canonical_text(col(c), rows.schema[c].dataType)
        levels = sorted(r[0] for r in rows.select(text.alias("v")).distinct().limit(10_001).collect())
        if len(levels) > 10_000:
            raise data_error("too many categories", column=c)
        counts = {(r["y"], r["v"]): r["n"] for r in rows.where("train").groupBy("y", text.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}
        cells = []
        for v in levels:
            logs = []
            for y in range(k):
                share = (counts.get((y, v), 0) + alpha) / (sizes.get(y, 0) + alpha * len(levels))
                logs.append(F.lit(math.log(share) if share > 0 else -1e10))
                table.append({"class": y, "feature": c, "category": v, "probability": share})
            cells += [F.lit(v), F.array(*logs)]
        maps[c] = F.element_at(F.create_map(*cells), text)
    return maps, table, sizes


@operator("naive_bayes_classification.categorical", MODULE, [_Y, Slot("x_columns", DISCRETE, CATEGORICAL)], {**_SPLIT, **_SHUFFLE, "alpha": {"type": "number", "minimum": 0, "default": 1}}, constraints=_APART)
def categorical(run: Run) -> Result:
    """Categorical naive Bayes with additive smoothing."""
    xs, p = run.columns("x_columns"), run.params
    df, dropped, label = _frame(run)
    rows, classes = split(df, label, p["train_ratio"], run.context.random_seed, p["shuffle"])
    rows = settled(rows)
    maps, _, sizes = category_logs(rows, xs, len(classes), float(p["alpha"]))
    total = sum(sizes.values())
    logs = [sum((F.get(maps[c], y) for c in xs), F.lit(math.log(sizes[y] / total))) for y in range(len(classes))]
    result = evaluate(_predicted(rows, logs), classes)
    result.metadata = {"classes": classes, "dropped_rows": dropped}
    return result


@operator("naive_bayes_classification.mixed", MODULE, [_Y, Slot("x_columns", DISCRETE, BOTH, 2)], {**_SPLIT, "alpha": {"type": "number", "minimum": 0, "default": 1}, "var_smoothing": {"type": "number", "exclusiveMinimum": 0, "default": 1e-9}}, constraints=_APART)
def mixed(run: Run) -> Result:
    """Naive Bayes over quantitative and categorical columns together."""
    xs, p = run.columns("x_columns"), run.params
    numeric, labels = [c for c in xs if not run.is_categorical(c)], [c for c in xs if run.is_categorical(c)]
    if not numeric or not labels:
        raise parameter_error("both kinds of columns are needed")
    df, dropped, label = _frame(run)
    rows, classes = split(df, label, p["train_ratio"], run.context.random_seed)
    rows = settled(rows)
    k, alpha = len(classes), float(p["alpha"])
    parts = gaussian_parts(rows, numeric)
    if min(q["n"] for q in parts.values()) < 2:
        raise data_error("every class needs two training rows")
    total = sum(q["n"] for q in parts.values())
    priors = [math.log((parts[y]["n"] + alpha) / (total + alpha * k)) for y in range(k)]
    maps, shares, _ = category_logs(rows, labels, k, alpha)
    logs = gaussian_logs(parts, numeric, k, p["var_smoothing"], True, priors)
    logs = [sum((F.get(maps[c], y) for c in labels), v) for y, v in enumerate(logs)]
    result = evaluate(_predicted(rows, logs), classes)
    table = [{"class": cls, "feature": c, "category": None, "mean": parts[y][f"m{i}"], "variance": parts[y][f"s{i}"] + p["var_smoothing"], "probability": None} for y, cls in enumerate(classes) for i, c in enumerate(numeric)]
    table += [{"class": classes[r["class"]], "feature": r["feature"], "category": r["category"], "mean": None, "variance": None, "probability": r["probability"]} for r in shares]
    result.tables.append(Table("condition_summary", table))
    result.metadata = {"classes": classes, "dropped_rows": dropped}
    return result


@operator("lightgbm_classification.standard", "lightgbm_classification", [_Y, Slot("x_columns", DISCRETE, BOTH)], {
    "objective": {"type": "string", "enum": ["auto", "binary", "multiclass"], "default": "auto"}, **_SPLIT, "n_estimators": {"type": "integer", "minimum": 1, "maximum": 10000, "default": 200}, "learning_rate": {"type": "number", "exclusiveMinimum": 0, "maximum": 1, "default": 0.05},
    "num_leaves": {"type": "integer", "minimum": 2, "maximum": 4096, "default": 31}, "max_depth": {"type": "integer", "minimum": -1, "maximum": 100, "default": -1}, "min_child_samples": {"type": "integer", "minimum": 1, "default": 20}, "subsample": {"type": "number", "exclusiveMinimum": 0, "maximum": 1, "default": 1},
    "colsample_bytree": {"type": "number", "exclusiveMinimum": 0, "maximum": 1, "default": 1}, "reg_alpha": {"type": "number", "minimum": 0, "default": 0}, "reg_lambda": {"type": "number", "minimum": 0, "default": 0}, "n_jobs": {"type": "integer", "minimum": 1, "maximum": 64, "default": 1},
}, constraints=_APART)
def boosted(run: Run) -> Result:
    """Gradient-boosted trees: one binary booster, or one for each class against the rest.

    Trees grow by level to the depth that holds ``num_leaves``; ``reg_alpha``, ``reg_lambda`` and ``n_jobs`` have no counterpart and are reported as unused.
    """
    p = run.params
    df, dropped, label = _frame(run)
    made = design(run, df, run.columns("x_columns"), drop_first=False)
    rows, classes = split(df, label, p["train_ratio"], run.context.random_seed)
    k = len(classes)
    if p["objective"] == "binary" and k != 2 or p["objective"] == "multiclass" and k < 3:
        raise parameter_error("objective does not fit the number of classes", classes=k)
    depth = math.ceil(math.log2(p["num_leaves"]))
    depth = min(30, depth if p["max_depth"] <= 0 else min(depth, p["max_depth"]))
    vectors = settled(rows.select(ROW_ID, "y", "train", F.array(*made.columns).alias("x"))).withColumn("features", array_to_vector("x")).persist()
    margins, importance = vectors.where("not train"), np.zeros(len(made.names))
    splits = np.zeros(len(made.names))
    targets = [1] if k == 2 else list(range(k))
    for y in targets:
        train = vectors.where("train").withColumn("target", (F.col("y") == y).cast("double"))
        model = GBTClassifier(featuresCol="features", labelCol="target", maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=depth, minInstancesPerNode=p["min_child_samples"], subsamplingRate=p["subsample"], featureSubsetStrategy="all" if p["colsample_bytree"] >= 1 else str(p["colsample_bytree"]), seed=run.context.random_seed, predictionCol="said").setRawPredictionCol("raw").setProbabilityCol("prob").fit(train)
        importance += model.featureImportances.toArray()
        splits += _split_counts(model, len(made.names))
        margins = model.transform(margins).withColumn(f"p{y}", F.get(vector_to_array("prob"), 1)).drop("raw", "prob", "said")
    if k == 2:
        probability = F.array(1 - F.col("p1"), F.col("p1"))
    else:
        total = sum((F.col(f"p{y}") for y in range(1, k)), F.col("p0"))
        probability = F.array(*(F.col(f"p{y}") / total for y in range(k)))
    test = settled(margins.select(ROW_ID, "y", probability.alias("probability")).withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("int")))
    vectors.unpersist()
    result = _boosted_metrics(test, classes)
    names = F.array(*(F.lit(c) for c in classes))
    predictions = test.select(F.col(ROW_ID).cast("string").alias("row_index"), F.get(names, F.col("y")).alias("actual"), F.get(names, F.col("prediction")).alias("predicted"), *(F.get("probability", i).alias(f"probability_{c}") for i, c in enumerate(classes)), ROW_ID).orderBy(ROW_ID).drop(ROW_ID)
    order = np.argsort(-importance, kind="stable")
    table = [{"feature": made.names[i], "split_importance": int(splits[i]), "gain_importance": float(importance[i])} for i in order]
    result.tables += [Table("predictions", predictions), Table("feature_importance", table)]
    result.charts.append(Chart("feature_importance", "bar", [[r["feature"], r["gain_importance"]] for r in table]))
    result.metadata = {"classes": classes, "dropped_rows": dropped, "categorical_encoding": made.encoding, "depth": depth, "unused_parameters": ["reg_alpha", "reg_lambda", "n_jobs"]}
    if dropped:
        result.warn("MISSING_ROWS_DROPPED", "rows with missing values were dropped", count=dropped)
    return result


def _split_counts(model: Any, width: int) -> np.ndarray:
    """How often each feature splits, from the text of the trees."""
    import re

    found = np.zeros(width)
    for name in re.findall(r"If \(feature (\d+) ", model.toDebugString):
        found[int(name)] += 1
    return found


def _boosted_metrics(test: DataFrame, classes: list[str]) -> Result:
    k = len(classes)
    result = evaluate(test, classes)
    grid = confusion(test, k)
    rows = report(grid, classes)
    accuracy = float(np.trace(grid) / grid.sum())
    metrics = [Metric("accuracy", accuracy)]
    for kind, row in (("macro", rows[-2]), ("weighted", rows[-1])):
        metrics += [Metric(f"{m}_{kind}", row[m]) for m in ("precision", "recall", "f1")]
    metrics += [Metric(f"{m}_micro", accuracy) for m in ("precision", "recall", "f1")]
    if k == 2:
        scored = test.select("y", F.get("probability", 1).alias("s"))
        metrics += [Metric("roc_auc", auc(scored, "s", F.col("y") == 1)), Metric("pr_auc", curves(scored, "s", F.col("y") == 1)[2])]
    else:
        areas = [auc(test.select("y", F.get("probability", i).alias("s")), "s", F.col("y") == i) for i in range(k)]
        support = grid.sum(1)
        whole = all(a is not None for a in areas)
        flat = test.select(F.posexplode("probability").alias("i", "s"), "y").select("s", (F.col("i") == F.col("y")).alias("hit"))
        metrics += [
            Metric("roc_auc_ovr_macro", float(np.mean(areas)) if whole else None),
            Metric("roc_auc_ovr_weighted", float(np.average(areas, weights=support)) if whole else None),
            Metric("roc_auc_ovr_micro", auc(flat, "s", F.col("hit"))),
        ]
    result.metrics = metrics
    return result
