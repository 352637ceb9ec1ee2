"""A greenhouse log with gaps, ties and repeated rows, and one request for each operator, filled in from its declared slots."""

import numpy as np
import pandas as pd

from statspark.model import Context, FieldMeta, Request
from statspark.plans.registry import Operator, Slot, catalogue

N = 144
GRADES = ["poor", "fair", "good", "prime"]
BEDS = ["east", "north", "south", "west"]
ORDERED = ("grade", "judge_1", "judge_2", "judge_3")


def _graded(values: np.ndarray) -> np.ndarray:
    return np.array(GRADES, object)[np.clip(np.searchsorted(np.quantile(values, [0.2, 0.55, 0.9]), values), 0, 3)]


def build() -> pd.DataFrame:
    rng = np.random.default_rng(2718)
    step = np.arange(N)
    bed = rng.choice(4, N, p=[0.4, 0.3, 0.2, 0.1])
    height = np.array([31.0, 36.0, 44.0, 58.0])[bed] + rng.normal(0, 2, N)
    girth = np.array([5.0, 9.0, 4.0, 8.0])[bed] + rng.gamma(2.0, 0.3, N)
    sugar, acid = rng.gamma(4.0, 1.5, N), np.round(rng.uniform(2, 5, N), 1)  # acid is full of ties
    ripeness = (height - height.mean()) / height.std() + rng.normal(0, 0.4, N)
    out = pd.DataFrame({"plot": [f"plot-{i:05d}" for i in 37 * step % 1009], "logged": pd.date_range("2025-03-03 06:00", periods=N, freq="30min").astype("datetime64[us]")})
    out["height"], out["girth"], out["sugar"], out["acid"] = height, girth, sugar, acid
    out["bed"], out["grade"] = np.array(BEDS, object)[bed], _graded(ripeness)
    out["sold"] = np.where(rng.uniform(size=N) < 1 / (1 + np.exp(-ripeness)), "sold", "kept").astype(object)
    out["kind"] = np.array(["beef", "cherry", "plum"], object)[(girth > 6).astype(int) + (sugar > 6)]
    for name, share in (("dry", 0.35), ("pest", 0.5), ("frost", 0.55)):
        out[name] = np.where(rng.uniform(size=N) < share, "hit", "free").astype(object)
    for k in (1, 2, 3):
        out[f"judge_{k}"] = _graded(ripeness + rng.normal(0, 0.5, N))
        out[f"place_{k}"] = np.round(np.argsort(np.argsort(sugar + rng.normal(0, 2, N))) / 3).astype(int)
    out["fruits"], out["crates"] = rng.poisson(2.3, N), rng.integers(1, 6, N)
    out["light"] = np.maximum(0.0, np.sin(step * np.pi / 24)) * 800 + rng.normal(0, 15, N)
    out["stock"] = 40 * 1.01**step
    out["ph"] = np.where(step % 11 == 3, np.nan, np.round(rng.normal(6.4, 0.3, N), 2))
    out.loc[[5, 77], "ph"] = [13.9, 0.4]
    out["yield_kg"] = 1.5 + 0.08 * height + 0.4 * girth - 0.2 * sugar + 0.7 * (bed == 2) + rng.normal(0, 0.5, N)
    return out


def metadata(pdf: pd.DataFrame) -> dict[str, FieldMeta]:
    def of(name: str) -> FieldMeta:
        kind = pdf[name].dtype.kind
        if kind == "M":
            return FieldMeta("datetime", "categorical", "nominal", "time")
        if kind == "O":
            return FieldMeta("string", "categorical", "ordinal" if name in ORDERED else "nominal", category_order=GRADES if name in ORDERED else [])
        return FieldMeta("integer" if kind == "i" else "number", "quantitative", "scale")

    return {name: of(name) for name in pdf.columns}


#: Columns of slots whose meaning their name tells; the rest follow from the labels a slot takes.
MEANING = {
    "frequency_weight": ["crates"], "order_column": ["logged"], "time_column": ["logged"], "row_index": ["plot"], "count_column": ["fruits"], "condition_columns": ["dry", "pest", "frost"], "value_column": ["light"], "value_columns": ["light", "stock"],
    "y_set": ["sugar", "acid"], "x_set": ["height", "girth"], "block_1": ["height", "bed"], "block_2": ["sugar"], "block_3": ["girth"], "block_4": [], "block_5": [], "check_columns": ["ph", "height", "girth"], "group_columns": ["bed", "grade"],
}
#: Parameters that an operator requires, and smaller work than its defaults.
PARAMETERS = {
    "data_encoding.manual": {"mapping": dict(zip(BEDS, (10, 20, 30, 40)))}, "data_encoding.range": {"ranges": [{"maximum": 6.0, "value": "sour"}, {"minimum": 6.0, "maximum": 7.0, "value": "even"}]}, "outlier_handling.custom": {"bounds": {"ph": {"minimum": 4, "maximum": 9}}},
    "invalid_sample_handling.rule_based": {"rules": [{"type": "value_range", "columns": ["ph"], "minimum": 4, "maximum": 9}]}, "invalid_sample_handling.custom_rules": {"rules": [{"type": "cross_field_rule", "columns": ["height", "girth"], "operator": "gt"}, {"type": "value_range", "columns": ["ph"], "minimum": 5}]},
    "cochran_q.related_binary": {"positive_value": "hit"}, "runs_test.custom_cut": {"cut_value": 200}, "ridge_regression.cross_validated": {"alpha_grid": [0.1, 10.0], "cv_folds": 4}, "logistic_regression.binary_gradient_descent": {"cv_folds": 3},
    "contingency_analysis.crosstab": {"binning": {"height": {"bin_count": 5}}}, "kmeans_clustering.standard": {"n_init": 2, "n_clusters": 4}, "lightgbm_classification.standard": {"n_estimators": 4, "num_leaves": 5}, "grey_forecast_gm11.basic": {"forecast_steps": 5},
}


def _columns(op: Operator, slot: Slot) -> list[str]:
    name, family = slot.id, op.key.split(".")[0]
    if name in MEANING:
        return MEANING[name]
    if name == "rater_columns":
        stem = "place" if "string" not in slot.types else "judge"
        return [f"{stem}_{k}" for k in (1, 2, 3)][: slot.most or 3]
    if name == "y_column":
        return ["stock" if family.startswith("grey") else "yield_kg"] if "categorical" not in slot.labels else ["sold" if slot.most_unique == 2 else "kind"]
    if name in ("group_column", "source_column"):
        return ["bed"] if "categorical" in slot.labels else ["ph"]
    if slot.most_unique == 2:
        return ["sold"]
    if slot.labels == frozenset({"categorical"}):
        return ["bed", "grade"]
    if "categorical" not in slot.labels:
        wide = {"principal_component_analysis": ["height", "girth", "sugar", "acid"], "runs_test": ["light"]}
        return wide.get(family, ["ph"] if family == "outlier_handling" else ["height", "girth"] if "clustering" in family or "bayes" in family else ["ph", "sugar", "acid"])
    return {"correlation_analysis": ["sugar", "grade"] if "pearson" not in op.key else ["sugar", "height", "sold"], "data_overview": ["plot", "logged", "ph", "bed"], "contingency_analysis": ["grade", "height"]}.get(family, ["height", "girth", "bed"])


CASES = {key: ({s.id: _columns(op, s) for s in op.slots if _columns(op, s)}, PARAMETERS.get(key, {})) for key, op in catalogue().items()}


def request(key, slots, parameters=None, pdf=None) -> Request:
    return Request(key, slots, parameters or {}, Context(f"test-{key}", fields=metadata(build() if pdf is None else pdf)))
