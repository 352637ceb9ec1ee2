"""Every operator runs on the fixture and keeps its contract."""

import json

import pytest

import fixtures
from statspark.model import OperatorError, Request
from statspark.plans.registry import catalogue, check_catalogue
from statspark.runner import run_operation

PRODUCING = ("data_encoding", "outlier_handling", "invalid_sample_handling", "time_series_window", "data_downsampling", "kmeans_clustering", "dbscan_clustering")


@pytest.fixture(scope="module")
def table(spark):
    pdf = fixtures.build()
    return pdf, spark.createDataFrame(pdf).coalesce(1).cache()


def test_the_catalogue_is_complete_and_well_declared():
    assert len(catalogue()) == 53
    assert check_catalogue() == []


def test_every_operator_has_a_query():
    from statspark import queries

    assert {k.replace(".", "_") for k in catalogue()} <= set(queries.QUERIES)


@pytest.mark.parametrize("key", list(fixtures.CASES))
def test_each_operator_runs(table, key):
    pdf, df = table
    slots, params = fixtures.CASES[key]
    result = run_operation(df, fixtures.request(key, slots, params, pdf))
    body = result.to_dict()
    json.dumps(body, allow_nan=False)
    assert body["metrics"] or body["tables"]
    assert (result.data is not None) == key.startswith(PRODUCING) == catalogue()[key].produces_data
    if result.data is not None:
        assert result.data.count() > 0 and "__row_id" not in result.data.columns
    assert df.columns == list(pdf.columns)


@pytest.mark.parametrize("key", ["kmeans_clustering.standard", "ridge_regression.cross_validated", "naive_bayes_classification.gaussian", "outlier_handling.iqr"])
def test_the_same_seed_gives_the_same_result(spark, key):
    pdf = fixtures.build()
    slots, params = fixtures.CASES[key]
    bodies = [json.dumps(run_operation(spark.createDataFrame(pdf).coalesce(1), fixtures.request(key, slots, params, pdf)).to_dict()) for _ in range(2)]
    assert bodies[0] == bodies[1]


def rejected(df, request):
    with pytest.raises(OperatorError) as caught:
        run_operation(df, request)
    return caught.value.code.value


def test_requests_are_refused_with_a_code(table, spark):
    pdf, df = table
    make = fixtures.request
    assert rejected(df, make("linear_regression.ols", {"y_column": ["bed"], "x_columns": ["height"]}, {}, pdf)) == "COLUMN_ERROR"
    assert rejected(df, make("descriptive_statistics.basic", {"x_columns": ["nope"]}, {}, pdf)) == "COLUMN_ERROR"
    assert rejected(df, make("descriptive_statistics.basic", {"x_columns": ["height", "height"]}, {}, pdf)) == "COLUMN_ERROR"
    assert rejected(df, make("descriptive_statistics.basic", {"x_columns": ["height"], "z": ["girth"]}, {}, pdf)) == "COLUMN_ERROR"
    assert rejected(df, make("descriptive_statistics.basic", {"x_columns": ["height"]}, {"nope": 1}, pdf)) == "PARAMETER_ERROR"
    assert rejected(df, make("descriptive_statistics.basic", {"x_columns": ["height"]}, {"round_digits": 99}, pdf)) == "PARAMETER_ERROR"
    assert rejected(df, make("no.such", {}, {}, pdf)) == "PARAMETER_ERROR"
    bare = make("descriptive_statistics.basic", {"x_columns": ["height"]}, {}, pdf)
    bare.context.fields = {}
    assert rejected(df, bare) == "COLUMN_ERROR"
    flat = pdf.assign(height=1.0)
    assert rejected(spark.createDataFrame(flat), make("principal_component_analysis.fixed_components", {"x_columns": ["height", "girth"]}, {}, flat)) == "DATA_ERROR"
    wild = pdf.assign(height=[float("inf"), *pdf["height"][1:]])
    assert rejected(spark.createDataFrame(wild), make("linear_regression.ols", {"y_column": ["yield_kg"], "x_columns": ["height"]}, {}, wild)) == "DATA_ERROR"
    assert rejected(spark.createDataFrame(pdf.head(7)), make("normality_test.dagostino", {"x_columns": ["height"]}, {}, pdf)) == "DATA_ERROR"
    old = make("descriptive_statistics.basic", {"x_columns": ["height"]}, {}, pdf)
    old.context.protocol_version = "2.0"
    assert rejected(df, old) == "EXECUTION_ERROR"
    no_order = make("correlation_analysis.spearman", {"x_columns": ["sugar", "grade"]}, {}, pdf)
    no_order.context.fields["grade"].category_order = []
    assert rejected(df, no_order) == "COLUMN_ERROR"


def test_a_request_comes_from_json():
    raw = {"operation_key": "a.b", "slots": {"x": ["c"]}, "context": {"run_id": "r", "field_metadata": {"c": {"data_type": "number", "analysis_type": "quantitative", "analysis_type_source": "user"}}}}
    assert Request.from_dict(raw).context.fields["c"].data_type == "number"
    with pytest.raises(OperatorError):
        Request.from_dict(raw | {"more": 1})


def test_labels_can_be_left_out_of_the_data(table):
    pdf, df = table
    slots, params = fixtures.CASES["kmeans_clustering.standard"]
    assert run_operation(df, fixtures.request("kmeans_clustering.standard", slots, params | {"generate_label_column": False}, pdf)).data is None
