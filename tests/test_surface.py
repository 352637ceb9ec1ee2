"""Sources, command line, JSON, streaming, and the driver contract without the text operators."""

import datetime as dt
import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

import fixtures
from conftest import SF
from statspark import cli
from statspark.model import OperatorError, Result, strict_json
from statspark.sources import read_table
from statspark.streaming import plan_encoding, plan_outlier_bounds, windowed_summary

ROOT = Path(__file__).resolve().parent.parent


def test_values_become_strict_json():
    assert strict_json({"a": np.float64("nan"), "b": np.int64(3), "c": [float("inf"), dt.date(2026, 1, 2)]}) == {"a": None, "b": 3, "c": [None, "2026-01-02"]}
    with pytest.raises(OperatorError):
        strict_json({1: 2})
    with pytest.raises(OperatorError):
        strict_json(object())


def test_presentations_name_known_results():
    with pytest.raises(OperatorError):
        Result(presentation=[{"kind": "table", "ref": "nope"}]).to_dict()


def test_rows_carry_their_place_in_the_files(spark, tmp_path):
    spark.range(100).repartition(3).sortWithinPartitions("id").write.parquet(str(tmp_path / "t.parquet"))
    df = read_table(spark, str(tmp_path / "t.parquet"))
    rows = df.collect()
    assert len({r["__row_id"] for r in rows}) == 100
    with pytest.raises(OperatorError):
        read_table(spark, str(tmp_path / "t.csv"))


def test_the_command_line_runs_a_request(spark, tmp_path):
    pdf = fixtures.build()
    spark.createDataFrame(pdf).coalesce(1).write.parquet(str(tmp_path / "in.parquet"))
    slots, params = fixtures.CASES["data_encoding.manual"]
    meta = {c: {"data_type": m.data_type, "analysis_type": m.analysis_type, "measurement_level": m.measurement_level} for c, m in fixtures.metadata(pdf).items()}
    good = {"operation_key": "data_encoding.manual", "slots": slots, "parameters": params, "context": {"run_id": "r", "field_metadata": meta}}
    for name, body, code in (("good", good, 0), ("bad", good | {"parameters": {}}, 1)):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        args = ["run", "--input", str(tmp_path / "in.parquet"), "--request", str(tmp_path / f"{name}.json"), "--output", str(tmp_path / name)]
        assert cli.main(args) == code
        result = json.loads((tmp_path / name / "result.json").read_text())
        assert result["status"] == ("success" if code == 0 else "error") and "Traceback" not in json.dumps(result)
    assert spark.read.parquet(str(tmp_path / "good" / "data.parquet")).where("encoded_value = 10").count() == (pdf["bed"] == "east").sum()


def test_the_catalogue_can_be_inspected(capsys):
    assert cli.main(["list"]) == 0 and len(capsys.readouterr().out.split()) == 53
    assert cli.main(["inspect", "group_summary.aggregate"]) == 0 and json.loads(capsys.readouterr().out)["module"] == "descriptive_analysis"
    assert cli.main(["inspect", "no.such"]) == 1
    assert cli.main(["validate"]) == 0
    assert cli.catalogue_hash() == cli.catalogue_hash()


def test_plans_learned_on_a_batch_run_on_a_stream(spark, tmp_path):
    batch = spark.createDataFrame([(dt.datetime(2026, 1, 1, 0, i), float(i), "a" if i % 2 else "b") for i in range(60)], "ts timestamp, v double, g string")
    batch.write.parquet(str(tmp_path / "in"))
    bins, clip = plan_encoding(batch, "v", count=3), plan_outlier_bounds(batch, ["v"], "custom", bounds={"v": {"maximum": 50}})
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    out = windowed_summary(bins.apply(clip.apply(stream)), "ts", ["g"], ["v"], "30 minutes")
    query = out.writeStream.format("memory").queryName("summary").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    rows = {(r["window"]["start"].minute, r["g"]): (r["count"], r["v_sum"]) for r in spark.table("summary").collect()}
    assert rows[0, "a"] == (15, sum(range(1, 30, 2))) and rows[30, "b"][0] == 15
    assert bins.apply(clip.apply(batch)).agg({"v": "max", "v_bin": "max"}).first()[0] in (50.0, 3)


def test_entry_and_queries(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 6
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)
    table = {k.replace(".", "_") for k in fixtures.CASES}
    assert table <= set(queries)


@pytest.mark.parametrize("name", ["group_summary_aggregate", "frequency_analysis_exact", "contingency_analysis_crosstab", "correlation_analysis_pearson", "runs_test_binary", "kappa_agreement_fleiss"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    import __spark_entry__ as contract

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = contract.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({contract.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


def test_the_contract_imports_without_the_text_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "statspark", tmp_path / "statspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[-2:] == ["55", "False"]
