"""Encoding, outliers, rules, windows and frequencies on small tables worked out by hand."""

import pandas as pd
import pytest

import fixtures
from statspark import queries
from statspark.model import Context, FieldMeta, OperatorError, Request
from statspark.operators.bins import bin_labels, equal_width_edges
from statspark.operators.timeseries import filtered_decimate
from statspark.plans.cores import ranked_counts
from statspark.plans.quantiles import exact_quantiles
from statspark.plans.order import shifted, with_position, with_row_id
from statspark.runner import run_operation


def run(spark, key, pdf, slots, partitions=1, **params):
    return run_operation(spark.createDataFrame(pdf).repartition(partitions), fixtures.request(key, slots, params, pdf))


SMALL = pd.DataFrame({"id": [1, 2, 3, 4, 4], "group": list("abab") + ["b"], "score": [80.0, 90.0, None, 70.0, 70.0], "at": pd.to_datetime(["2026-08-01", "2026-08-02", "2026-08-03", "2026-08-04", "2026-08-04"]).astype("datetime64[us]")})


def test_overview_of_a_small_table(spark):
    pdf = SMALL.rename(columns={"at": "time"})
    r = run(spark, "data_overview.basic", pdf, {"columns": list(pdf.columns)})
    assert (r.metric("row_count"), r.metric("column_count"), r.metric("duplicate_row_count")) == (5, 4, 1)
    score = r.table("field_overview").rows()[2]
    assert (score["missing_count"], score["missing_rate"], score["minimum"], score["maximum"], score["unique_count"]) == (1, 0.2, 70.0, 90.0, 3)
    empty = run_operation(spark.createDataFrame(pdf).limit(0), fixtures.request("data_overview.basic", {"columns": ["score"]}, {}, pdf))
    assert [w.code for w in empty.warnings] == ["EMPTY_DATA"]


def test_bin_edges_and_labels():
    assert equal_width_edges(0.0, 10.0, 2) == [-0.01, 5.0, 10.0]
    assert bin_labels([-0.01, 5.0, 10.0]) == ["[-0.01, 5]", "(5, 10]"]


def test_frequencies_keep_empty_bins_and_the_full_total(spark):
    pdf = pd.DataFrame({"x": [0.0, 0.0, 10.0, 9.0], "g": list("aabc")})
    binned = run(spark, "frequency_analysis.binned", pdf, {"columns": ["x"]}, bin_count=4).tables[0].rows()
    assert [r["frequency"] for r in binned] == [2, 0, 0, 2]
    custom = run(spark, "frequency_analysis.binned", pdf, {"columns": ["x"]}, bin_method="custom", custom_edges=[0, 5, 9]).tables[0].rows()
    assert [(r["interval"], r["frequency"]) for r in custom] == [("[0, 5]", 2), ("(5, 9]", 1), (None, 1)]
    top = run(spark, "frequency_analysis.exact", pdf, {"columns": ["g"]}, top_n=1).tables[0].rows()
    assert top == [{"field": "g", "value": "a", "frequency": 2, "percentage": 0.5, "cumulative_frequency": 2, "cumulative_percentage": 0.5}]


def test_manual_codes(spark):
    pdf = pd.DataFrame({"g": ["a", "b", None, "z"], "n": [1, 2, 3, 4]})
    r = run(spark, "data_encoding.manual", pdf, {"source_column": ["g"]}, mapping={"a": 1, "b": 2}, unmatched="null")
    assert [x["encoded_value"] for x in r.data.orderBy("n").collect()] == [1, 2, None, None]
    assert (r.metric("changed_count"), r.metric("unmatched_count")) == (2, 1)
    kept = run(spark, "data_encoding.manual", pdf, {"source_column": ["g"]}, mapping={"a": 1}, output_mode="replace")
    assert [x["g"] for x in kept.data.orderBy("n").collect()] == ["1", "b", None, "z"]
    missing = run(spark, "data_encoding.manual", pdf, {"source_column": ["g"]}, mapping={"None": "none"}, include_missing=True, unmatched="null")
    assert [x["encoded_value"] for x in missing.data.orderBy("n").collect()] == [None, None, "none", None]
    with pytest.raises(OperatorError):
        run(spark, "data_encoding.manual", pdf, {"source_column": ["g"]}, mapping={"a": 1}, unmatched="error")


def test_ranges_are_half_open_and_must_not_overlap(spark):
    pdf = pd.DataFrame({"n": [1, 4, 9, 20]})
    ranges = [{"maximum": 4, "value": "low"}, {"minimum": 4, "maximum": 9, "value": "mid"}]
    r = run(spark, "data_encoding.range", pdf, {"source_column": ["n"]}, ranges=ranges)
    assert [x["encoded_value"] for x in r.data.orderBy("n").collect()] == ["low", "mid", "9", "20"]
    with pytest.raises(OperatorError):
        run(spark, "data_encoding.range", pdf, {"source_column": ["n"]}, ranges=[{"maximum": 5, "value": 1}, {"minimum": 4, "value": 2}])


@pytest.mark.parametrize(("action", "expected"), [("set_null", None), ("zero", 0.0), ("mean", 2.8), ("median", 2.0), ("mode", 2.0), ("winsorize", 7.0), ("custom_value", -1.0)])
def test_outlier_actions_use_inside_values_only(spark, action, expected):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 2.0, 4.0, 5.0, 100.0]})
    r = run(spark, "outlier_handling.custom", pdf, {"x_columns": ["x"]}, bounds={"x": {"maximum": 7}}, action=action, replacement_value=-1)
    last = [x for x in r.data.collect() if x["x"] not in (1.0, 2.0, 4.0, 5.0)] or [{"x": expected}]
    assert last[0]["x"] == (pytest.approx(expected) if expected is not None else None)
    assert r.metric("outlier_count") == 1


def test_random_replacement_is_a_valid_value(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]})
    r = run(spark, "outlier_handling.iqr", pdf, {"x_columns": ["x"]}, action="random_valid_value")
    assert max(x["x"] for x in r.data.collect()) <= 5.0


def test_every_rule_type(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, None, 40.0, 2.0], "b": [2.0, 1.0, 5.0, 50.0, 1.0], "s": ["x1", "y", "12", None, "y"]})

    def bad(rule):
        r = run(spark, "invalid_sample_handling.rule_based", pdf, {"check_columns": ["a", "b", "s"]}, rules=[rule])
        return [bool(x["invalid_sample"]) for x in r.data.orderBy(r.data["b"], r.data["a"]).collect()]

    # rows in order of b: (2,1,y) (2,1,y) (1,2,x1) (null,5,12) (40,50,null)
    assert bad({"type": "missing_ratio", "threshold": 0.3}) == [False, False, False, True, True]
    assert bad({"type": "value_range", "columns": ["a"], "maximum": 30}) == [False, False, False, False, True]
    assert bad({"type": "allowed_values", "columns": ["s"], "values": ["y", "12"]}) == [False, False, True, False, False]
    assert bad({"type": "data_type", "columns": ["s"]}) == [True, True, True, False, False]
    assert bad({"type": "duplicate_row"}) == [True, True, False, False, False]
    assert bad({"type": "unique_key", "columns": ["a"]}) == [True, True, False, False, False]
    assert bad({"type": "cross_field_rule", "columns": ["a", "b"], "operator": "lt"}) == [True, True, False, False, False]
    assert bad({"type": "pattern", "columns": ["s"], "pattern": "[a-z]"}) == [False, False, True, True, False]


def test_rules_combine_and_remove(spark):
    pdf = pd.DataFrame({"a": [1.0, 50.0, 60.0], "b": [9.0, 9.0, -1.0]})
    rules = [{"type": "value_range", "columns": ["a"], "maximum": 10, "weight": 1}, {"type": "value_range", "columns": ["b"], "minimum": 0, "weight": 3}]
    for how, kept in (("any", [1.0]), ("all", [1.0, 50.0]), ("weighted_score", [1.0, 50.0])):
        r = run(spark, "invalid_sample_handling.custom_rules", pdf, {"check_columns": ["a", "b"]}, rules=rules, combination=how, action="remove_rows", score_threshold=2)
        assert sorted(x["a"] for x in r.data.collect()) == kept


def test_windows_are_the_oldest_first(spark):
    pdf = pd.DataFrame({"t": [3, 1, 2, 5, 4], "v": [30.0, 10.0, 20.0, 50.0, 40.0]})
    r = run(spark, "time_series_window.sliding", pdf, {"value_column": ["v"], "order_column": ["t"]}, window_size=2, step_size=2)
    assert [tuple(x) for x in r.data.orderBy("window_start").collect()] == [(0, 1, 10.0, 20.0, 1, 2, 30.0), (2, 3, 30.0, 40.0, 3, 4, 50.0)]
    part = run(spark, "time_series_window.sliding", pdf, {"value_column": ["v"], "order_column": ["t"]}, window_size=3, step_size=3, output_mode="features", include_incomplete=True)
    assert [tuple(x) for x in part.data.orderBy("window_start").collect()] == [(0, 2, 10.0, 20.0, 30.0, 1, 3), (3, 4, 40.0, 50.0, None, 4, 5)]
    twice = pd.DataFrame({"t": [1, 1, 2, 3], "v": [1.0, 9.0, 2.0, 3.0]})
    for policy, first in (("first", 1.0), ("last", 9.0)):
        r = run(spark, "time_series_window.sliding", twice, {"value_column": ["v"], "order_column": ["t"]}, window_size=1, duplicate_order=policy)
        assert r.data.orderBy("window_start").first()["v_lag_1"] == first
    with pytest.raises(OperatorError):
        run(spark, "time_series_window.sliding", twice, {"value_column": ["v"], "order_column": ["t"]})


def test_windows_over_all_rows_of_one_order_value(spark):
    twice = pd.DataFrame({"t": [1, 1, 2, 3], "v": [1.0, 9.0, 2.0, 3.0]})
    r = run(spark, "time_series_window.sliding", pd.concat([twice] * 2), {"value_column": ["v"], "order_column": ["t"]}, window_size=2, step_size=2, duplicate_order="keep")
    assert [tuple(x) for x in r.data.orderBy("window_start").collect()] == [(0, 1, 1.0, 9.0, 1, 1, 1.0), (2, 3, 1.0, 9.0, 1, 1, 2.0), (4, 5, 2.0, 2.0, 2, 2, 3.0)]


def test_the_sliding_query_keeps_rows_of_one_time(spark, tmp_path):
    at = pd.to_datetime(["2024-01-01 00:00:01", "2024-01-01 00:00:02", "2024-01-01 00:00:03"])
    events = pd.DataFrame({"event_id": range(9), "ts": [*at] * 3, "event_type": "view", "value": [float(i) for i in range(9)]})
    events["ts"] = events["ts"].astype("datetime64[us]")
    events.to_parquet(tmp_path / "events.parquet", index=False)
    got = queries.QUERIES["time_series_window_sliding"](spark, str(tmp_path)).orderBy("window_start").collect()
    assert [tuple(x)[:6] for x in got] == [(0, 2, 0.0, 3.0, 6.0, 1.0), (5, 7, 7.0, 2.0, 5.0, 8.0)]


def test_blocks_and_samples(spark):
    pdf = pd.DataFrame({"t": [1, 2, 3, 4, 5], "v": [1.0, None, 3.0, 4.0, 5.0], "s": list("abcde")})
    slots = {"value_columns": ["v"], "order_column": ["t"]}
    assert [tuple(x) for x in run(spark, "data_downsampling.periodic_sample", pdf, slots, factor=2, offset=1).data.orderBy("t").collect()] == [(2, None, "b"), (4, 4.0, "d")]
    assert [tuple(x) for x in run(spark, "data_downsampling.block_aggregate", pdf, slots, factor=2, aggregation="last", other_columns="last").data.orderBy("t").collect()] == [(1, 1.0, "b"), (3, 4.0, "d"), (5, 5.0, "e")]


@pytest.mark.parametrize("partitions", [1, 5])
def test_large_frames_are_numbered_and_shifted_like_small_ones(spark, partitions):
    df = with_row_id(spark.range(300_000).selectExpr("id", "(id * 7919) % 300007 AS k", "id % 5 AS v").repartition(partitions))
    ranged = with_position(df, "k", single_sort_rows=10)
    assert ranged.where("__position < 0").count() == 0
    window = with_position(df, "k")
    assert ranged.join(window.select("id", window["__position"].alias("p")), "id").where("p <> __position").count() == 0
    a = shifted(window, ["v"], [0, 2], single_sort_rows=10).selectExpr("sum(v__2 * (__position % 11)) AS s", "count(v__2) AS n").first()
    b = shifted(window, ["v"], [0, 2]).selectExpr("sum(v__2 * (__position % 11)) AS s", "count(v__2) AS n").first()
    assert a == b


def test_ranks_of_many_values_match_those_of_few(spark):
    counts = spark.range(1000).selectExpr("(id * 37) % 1009 AS __v", "id % 3 + 1 AS __n")
    few = {r["__v"]: r["__rank"] for r in ranked_counts(counts).collect()}
    assert few == {r["__v"]: r["__rank"] for r in ranked_counts(counts, single_sort_rows=10).collect()}


def test_blocks_of_a_filter_agree_with_the_whole_series(spark):
    df = with_row_id(spark.range(30_000).selectExpr("id", "sin(id / 9.0) + (id % 17) * 0.01 AS v").coalesce(1))
    whole = {r["id"]: r["v"] for r in filtered_decimate(df, ["v"], "id", 2).collect()}
    parts = {r["id"]: r["v"] for r in filtered_decimate(df, ["v"], "id", 2, block=8000).collect()}
    assert whole.keys() == parts.keys() and max(abs(whole[k] - parts[k]) for k in whole) < 1e-9


@pytest.mark.parametrize("partitions", [4, 17])
def test_results_do_not_depend_on_partitions(spark, partitions):
    pdf = fixtures.build()
    for key, name in (("group_summary.aggregate", "group_summary"), ("descriptive_statistics.basic", "descriptive_statistics"), ("correlation_analysis.kendall_tau_b", "kendall_tau_b_correlation")):
        slots, params = fixtures.CASES[key]
        got = [run_operation(spark.createDataFrame(pdf).repartition(n), fixtures.request(key, slots, params, pdf)).table(name).rows() for n in (1, partitions)]
        assert got[0] == got[1], key


def test_spacing_and_order_are_checked(spark):
    slots = {"value_columns": ["v"], "order_column": ["t"]}
    good = pd.DataFrame({"t": [0.0, 2.0, 4.0, 6.0], "v": [1.0, 2.0, 3.0, 4.0]})
    assert run(spark, "data_downsampling.filtered_decimate", good, slots, factor=2, filter_type="fir").data.count() == 2
    for times in ([0.0, 2.0, 5.0, 6.0], [0.0, 2.0, 2.0, 4.0], [0.0, 2.0, None, 6.0]):
        with pytest.raises(OperatorError):
            run(spark, "data_downsampling.filtered_decimate", good.assign(t=times), slots, factor=2)


def test_quantiles_of_large_frames_are_exact(spark):
    from pyspark.sql import functions as F

    df = spark.range(40_000).selectExpr("pow((id * 7919) % 40009, 1.5) AS a", "cast((id * 31) % 7 AS double) AS b", "if(id % 3 = 0, NULL, id * 1e-3) AS c", "if(id < 39990, 5.0D, id * 1.0D) AS d", "cast(NULL AS double) AS e")
    columns = [F.col(c) for c in "abcde"]
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9999, 1.0]
    direct = exact_quantiles(df, columns, shares)
    narrowed = exact_quantiles(df, columns, shares, direct_rows=50)
    assert direct[4] is None and narrowed[4] is None
    for x, y in zip(direct[:4], narrowed[:4]):
        assert y == pytest.approx(x, rel=1e-12)


def test_texts_of_numbers_and_missing_labels(spark):
    values = [1e7, 1e-5, 0.5, 1e16, 123456789.125, 0.0001, -2.5e-7, 1e15, 3.0, -0.0, 1.5e300, float("nan"), None]
    pdf = pd.DataFrame({"v": values})
    meta = {"v": FieldMeta("number", "quantitative", "scale")}
    mapping = {**{str(v): i for i, v in enumerate(values[:11])}, "nan": 99}
    body = Request("data_encoding.manual", {"source_column": ["v"]}, {"mapping": mapping, "include_missing": True, "unmatched": "null"}, Context("t", fields=meta))
    got = [r["encoded_value"] for r in run_operation(spark.createDataFrame(pdf).coalesce(1), body).data.collect()]
    assert got == [*range(11), 99, 99]
    flags = spark.createDataFrame([(True, "x"), (None, None), (False, "y")], "b boolean, s string").coalesce(1)
    for column, kind, mapping, expected in (("b", "boolean", {"True": 1, "None": 5}, [1, 5, None]), ("s", "string", {"x": 1, "None": 5}, [1, 5, None])):
        body = Request("data_encoding.manual", {"source_column": [column]}, {"mapping": mapping, "include_missing": True, "unmatched": "null"}, Context("t", fields={column: FieldMeta(kind, "categorical", "nominal")}))
        assert [r["encoded_value"] for r in run_operation(flags, body).data.collect()] == expected


def test_outliers_are_drawn_from_all_valid_values(spark):
    from statspark.model import ROW_ID
    from statspark.operators.prep import _random_valid
    from statspark.plans.order import with_row_id
    from pyspark.sql import functions as F

    df = with_row_id(spark.range(12_000).selectExpr("id", "if(id % 2 = 0, cast(id AS double), -1.0D) AS v").repartition(3))
    inside = F.col("v") >= 0
    got = _random_valid(df, "v", inside, ~inside, 7)
    assert got.count() == 12_000 and got.where("v < 0").isEmpty() and got.where("id % 2 = 0 AND v <> id").isEmpty()
    assert got.where("id % 2 = 1").select("v").distinct().count() > 3000  # 6,000 draws from 6,000 values
    assert set(got.columns) == {"id", "v", ROW_ID}
