"""One query per catalogue operator on the test tables, with SQL for those that SQL can express.

Floats are rounded on both sides. Queries go through the same cores the operators use.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Context, FieldMeta, Request, Result
from .runner import run_operation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, sql: str | None = None):
    def put(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return put


def metas(q: str = "", c: str = "", o: dict[str, list] | None = None, ints: str = "", t: str = "") -> dict[str, FieldMeta]:
    """Metadata by kind: quantitative numbers, nominal texts, ordinal texts, integers, times."""
    out = {n: FieldMeta("number", "quantitative", "scale") for n in q.split()}
    out |= {n: FieldMeta("integer", "quantitative", "scale") for n in ints.split()}
    out |= {n: FieldMeta("string", "categorical", "nominal") for n in c.split()}
    out |= {n: FieldMeta("string", "categorical", "ordinal", category_order=v) for n, v in (o or {}).items()}
    out |= {n: FieldMeta("datetime", "categorical", "nominal", "time") for n in t.split()}
    return out


def op(df: DataFrame, key: str, slots: dict[str, list[str]], fields: dict[str, FieldMeta], **params: Any) -> Result:
    return run_operation(df, Request(key, slots, params, Context(fields=fields)))


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def rounded(value: Any, digits: int = 6) -> float | None:
    return None if value is None else round(float(value), digits) + 0.0


def drawn(source: str, seed: int) -> str:
    """CTEs that number the rows of ``source`` in their order and add ``draw``, Spark's xxhash64(number, seed): what splits and folds go by."""
    # The five primes of the 64-bit hash.
    word, p1, p2, p3, p4, p5 = 2**64, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5

    def big(n: int) -> str:
        return f"'{n}'::UHUGEINT"

    def times(a: str, b: int) -> str:
        return f"(({a}) * {big(b)}) % {big(word)}"

    def turned(a: str, n: int) -> str:
        return f"(({a}) * {big(2**n)}) % {big(word)} + ({a}) // {big(2 ** (64 - n))}"

    def folded(a: str, n: int) -> str:
        return f"xor({a}, {a} // {big(2**n)})"

    def mixed_in(value: str, start: str, size: int, turn: int, by: int, plus: int) -> list[str]:
        return [f"xor(({start} + {big(p5 + size)}) % {big(word)}, {value})", turned("h", turn), f"({times('h', by)} + {big(plus)}) % {big(word)}", folded("h", 33), times("h", p2), folded("h", 29), times("h", p3), folded("h", 32)]

    steps = [times("number::UHUGEINT", p2), turned("h", 31), times("h", p1), *mixed_in("h", big(42), 8, 27, p1, p4), *mixed_in(big(seed * p1 % word), "h", 4, 23, p2, p3)]
    ctes = [f"d0 AS (SELECT *, row_number() OVER () - 1 AS number FROM ({source}))"]
    for i, step in enumerate(steps):
        ctes.append(f"d{i + 1} AS (SELECT * {'' if i == 0 else 'EXCLUDE (h)'}, {step} AS h FROM d{i})")
    ctes.append(f"drawn AS (SELECT * EXCLUDE (h), CASE WHEN h >= {big(2**63)} THEN h::HUGEINT - {word} ELSE h::HUGEINT END AS draw FROM d{len(steps)})")
    return ",\n".join(ctes)


LINE_Q = metas("l_quantity l_extendedprice l_discount l_tax", "l_returnflag l_linestatus")


@add("group_summary_aggregate", """
SELECT l_returnflag, l_linestatus, count(l_quantity) AS l_quantity_count, round_even(sum(l_quantity), 2) AS l_quantity_sum, round_even(avg(l_quantity), 2) AS l_quantity_mean,
  round_even(median(l_quantity), 2) AS l_quantity_median, round_even(min(l_quantity), 2) AS l_quantity_min, round_even(max(l_quantity), 2) AS l_quantity_max, round_even(stddev_samp(l_quantity), 2) AS l_quantity_std
FROM lineitem GROUP BY 1, 2""")
def q_group_summary(spark, d):
    r = op(table(spark, d, "lineitem"), "group_summary.aggregate", {"group_columns": ["l_returnflag", "l_linestatus"], "value_columns": ["l_quantity"]}, LINE_Q, aggregations=["count", "sum", "mean", "median", "min", "max", "std"], round_digits=2)
    return r.table("group_summary").source


@add("data_overview_basic", """
WITH n AS (SELECT count(*) AS c FROM orders)
SELECT field, valid_count, missing_count, unique_count FROM (
  SELECT 'o_orderstatus' AS field, count(o_orderstatus) AS valid_count, count(*) - count(o_orderstatus) AS missing_count, count(DISTINCT o_orderstatus) AS unique_count FROM orders
  UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority) FROM orders
  UNION ALL SELECT 'half_price', count(h), count(*) - count(h), count(DISTINCT h) FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS h FROM orders))""")
def q_overview(spark, d):
    df = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("half_price"))
    r = op(df, "data_overview.basic", {"columns": df.columns}, metas("half_price", "o_orderstatus o_orderpriority"))
    return small(spark, [(f["field"], f["valid_count"], f["missing_count"], f["unique_count"]) for f in r.table("field_overview").rows()], "field string, valid_count long, missing_count long, unique_count long")


@add("frequency_analysis_exact", """
WITH c AS (SELECT o_orderpriority AS value, count(*) AS frequency FROM orders GROUP BY 1)
SELECT value, frequency, round(frequency / sum(frequency) OVER (), 6) AS percentage, CAST(sum(frequency) OVER (ORDER BY frequency DESC, value) AS BIGINT) AS cumulative_frequency FROM c""")
def q_frequency(spark, d):
    r = op(table(spark, d, "orders"), "frequency_analysis.exact", {"columns": ["o_orderpriority"]}, metas(c="o_orderpriority"))
    return r.tables[0].source.select("value", "frequency", F.round("percentage", 6).alias("percentage"), "cumulative_frequency")


@add("frequency_analysis_binned", """
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
e AS (SELECT i, CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001::DOUBLE WHEN i = 8 THEN hi ELSE lo + (hi - lo) * i / 8 END AS e FROM b, range(9) t(i)),
bins AS (SELECT a.i + 1 AS bin, a.e AS low, c.e AS high FROM e a JOIN e c ON c.i = a.i + 1)
SELECT CAST(bin AS INTEGER) AS bin, count(l_extendedprice) AS frequency FROM bins LEFT JOIN lineitem ON l_extendedprice > low AND l_extendedprice <= high GROUP BY bin""")
def q_binned(spark, d):
    r = op(table(spark, d, "lineitem"), "frequency_analysis.binned", {"columns": ["l_extendedprice"]}, LINE_Q, bin_count=8)
    return r.tables[0].source.select("bin", "frequency")


@add("contingency_analysis_crosstab", """
WITH g AS (SELECT a AS "group", b AS x, (SELECT count(*) FROM orders WHERE o_orderstatus = a AND o_orderpriority = b) AS frequency
  FROM (SELECT DISTINCT o_orderstatus AS a FROM orders), (SELECT DISTINCT o_orderpriority AS b FROM orders))
SELECT "group", x, frequency, round(frequency / sum(frequency) OVER (PARTITION BY "group"), 6) AS row_percentage, round(frequency / sum(frequency) OVER (PARTITION BY x), 6) AS column_percentage FROM g""")
def q_crosstab(spark, d):
    r = op(table(spark, d, "orders"), "contingency_analysis.crosstab", {"group_column": ["o_orderstatus"], "x_columns": ["o_orderpriority"]}, metas(c="o_orderstatus o_orderpriority"))
    return small(spark, [(x["group"], x["x"], x["frequency"], rounded(x["row_percentage"]), rounded(x["column_percentage"])) for x in r.tables[0].rows()], "group string, x string, frequency long, row_percentage double, column_percentage double")


@add("contingency_chi_square_yates", """
WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2),
e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS x FROM c)
SELECT round(sum(pow(abs(n - x) - least(0.5, abs(n - x)), 2) / x), 6) AS chi_square FROM e""")
def q_yates(spark, d):
    df = table(spark, d, "labels").select(F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    r = op(df, "contingency_analysis.crosstab", {"group_column": ["quality"], "x_columns": ["toxic"]}, metas(c="quality toxic"))
    return small(spark, [(rounded(r.metric("chi_square_1")),)], "chi_square double")


_DESC = ("count", "missing", "mean", "std", "min", "q1", "median", "q3", "max", "skewness", "kurtosis")


def _describe_sql(c: str) -> str:
    return f"""SELECT '{c}' AS field, count({c}) AS "count", count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS "min", round(quantile_cont({c}, 0.25), 6)::DOUBLE AS q1,
 round(quantile_cont({c}, 0.5), 6)::DOUBLE AS median, round(quantile_cont({c}, 0.75), 6)::DOUBLE AS q3, max({c})::DOUBLE AS "max", round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM lineitem"""


@add("descriptive_statistics_basic", " UNION ALL ".join(_describe_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def q_descriptive(spark, d):
    r = op(table(spark, d, "lineitem"), "descriptive_statistics.basic", {"x_columns": ["l_quantity", "l_extendedprice", "l_discount"]}, LINE_Q, round_digits=6)
    rows = [(x["field"], x["count"], x["missing"], *(float(x[k]) for k in _DESC[2:])) for x in r.table("descriptive_statistics").rows()]
    return small(spark, rows, "field string, count long, missing long, " + ", ".join(f"{k} double" for k in _DESC[2:]))


_NORMAL = "field string, sample_count long, statistic double, p_value double"


def _normality(key: str, name: str, column: str):
    def query(spark, d):
        r = op(table(spark, d, name), key, {"x_columns": [column]}, metas(column))
        return small(spark, [(x["field"], x["sample_count"], rounded(x["statistic"], 4), rounded(x["p_value"], 4)) for x in r.tables[0].rows()], _NORMAL)

    return query


_DAGOSTINO = """
WITH m AS (SELECT count(v)::DOUBLE AS n, avg(v) AS mu FROM {t}), c AS (SELECT n, avg(pow(v - mu, 2)) AS m2, avg(pow(v - mu, 3)) AS m3, avg(pow(v - mu, 4)) AS m4 FROM {t}, m GROUP BY n),
g AS (SELECT n, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) AS b2 FROM c),
s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
  (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS k FROM g),
w AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / k * (2 / k + sqrt(1 + 4 / (k * k))) AS a FROM s),
z AS (SELECT n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, ((1 - 2 / (9 * a)) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM w)
SELECT '{c}' AS field, n::BIGINT AS sample_count, round(z1 * z1 + z2 * z2, 4) AS statistic, round(exp(-(z1 * z1 + z2 * z2) / 2), 4) AS p_value FROM z"""
add("normality_test_dagostino", _DAGOSTINO.format(t="(SELECT c_acctbal AS v FROM customer)", c="c_acctbal"))(_normality("normality_test.dagostino", "customer", "c_acctbal"))
add("normality_test_auto", _DAGOSTINO.format(t="(SELECT value AS v FROM events)", c="value"))(_normality("normality_test.auto", "events", "value"))
add("normality_test_shapiro")(_normality("normality_test.shapiro", "supplier", "s_acctbal"))
# The normal distribution function by its power series, and p between the levels of the corrected critical values.
add("normality_test_anderson", """
WITH m AS (SELECT count(c_acctbal) AS n, avg(c_acctbal) AS mu, stddev_samp(c_acctbal) AS sd FROM customer),
z AS (SELECT row_number() OVER (ORDER BY c_acctbal) AS i, n, (c_acctbal - mu) / sd AS z FROM customer, m WHERE c_acctbal IS NOT NULL),
p AS (SELECT i, n, 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2))) AS p FROM z),
a AS (SELECT -n - sum((2 * i - 1) * ln(p) + (2 * (n - i) + 1) * ln(1 - p)) / n AS a, n FROM p GROUP BY n),
c AS (SELECT n, a, round(c / (1 + 4.0 / n - 25.0 / n / n), 3) AS c, l FROM a, (VALUES (0.576::DOUBLE, 0.15::DOUBLE), (0.656, 0.1), (0.787, 0.05), (0.918, 0.025), (1.092, 0.01)) t(c, l)),
b AS (SELECT *, lead(c) OVER (ORDER BY c) AS c2, lead(l) OVER (ORDER BY c) AS l2 FROM c)
SELECT 'c_acctbal' AS field, n AS sample_count, round(a, 4) AS statistic, round(CASE WHEN a <= min(c) THEN 0.15 WHEN a >= max(c) THEN 0.01 ELSE max(CASE WHEN a >= c AND a < c2 THEN l + (l2 - l) * (a - c) / (c2 - c) END) END, 4) AS p_value FROM b GROUP BY n, a""")(_normality("normality_test.anderson", "customer", "c_acctbal"))


@add("data_encoding_manual", """SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END AS BIGINT) AS encoded_value FROM orders""")
def q_manual(spark, d):
    r = op(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "data_encoding.manual", {"source_column": ["o_orderpriority"]}, metas(c="o_orderpriority"), mapping={"1-URGENT": 1, "2-HIGH": 2}, unmatched="null")
    return r.data.select("o_orderkey", "encoded_value")


@add("data_encoding_manual_numbers", """SELECT l_orderkey, l_linenumber, CAST(CASE l_discount WHEN 0.0 THEN 0 WHEN 0.05 THEN 5 WHEN 0.1 THEN 10 END AS BIGINT) AS encoded_value FROM lineitem""")
def q_manual_numbers(spark, d):
    r = op(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "data_encoding.manual", {"source_column": ["l_discount"]}, metas("l_discount"), mapping={"0.0": 0, "0.05": 5, "0.1": 10}, unmatched="null")
    return r.data.select("l_orderkey", "l_linenumber", "encoded_value")


@add("data_encoding_range", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size >= 10 AND p_size < 30 THEN 'middle' WHEN p_size >= 40 THEN 'large' ELSE CAST(p_size AS VARCHAR) END AS encoded_value FROM part""")
def q_range(spark, d):
    ranges = [{"maximum": 10, "value": "small"}, {"minimum": 10, "maximum": 30, "value": "middle"}, {"minimum": 40, "value": "large"}]
    r = op(table(spark, d, "part").select("p_partkey", "p_size"), "data_encoding.range", {"source_column": ["p_size"]}, metas(ints="p_size"), ranges=ranges)
    return r.data.select("p_partkey", "encoded_value")


@add("data_encoding_auto_bin", """
WITH q AS (SELECT quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(1 + (l_extendedprice > e[2])::INT + (l_extendedprice > e[3])::INT + (l_extendedprice > e[4])::INT AS BIGINT) AS encoded_group FROM lineitem, q""")
def q_auto_bin(spark, d):
    r = op(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "data_encoding.auto_bin", {"source_column": ["l_extendedprice"]}, LINE_Q, bin_method="equal_frequency", bin_count=4)
    return r.data.select("l_orderkey", "l_linenumber", "encoded_group")


def _outlier(key: str, name: str, ident: str, column: str, sql: str | None, **params: Any) -> None:
    def query(spark, d):
        r = op(table(spark, d, name).select(ident, column), f"outlier_handling.{key}", {"x_columns": [column]}, metas(column), **params)
        return r.data.select(ident, F.round(column, 6).alias(column))

    add(f"outlier_handling_{key}", sql)(query)


_QUARTILES = "SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3 FROM {t}"
_MAD = """WITH m AS (SELECT quantile_cont(value, 0.5) AS med FROM events), s AS (SELECT med, quantile_cont(abs(value - med), 0.5) AS mad FROM events, m GROUP BY med),
b AS (SELECT med - 3.5 * mad / 0.6744897501960817 AS lo, med + 3.5 * mad / 0.6744897501960817 AS hi FROM s)"""
_outlier("auto", "events", "event_id", "value", _MAD + " SELECT event_id, round(CASE WHEN value < lo OR value > hi THEN NULL ELSE value END, 6) AS value FROM events, b")
_outlier("mad", "events", "event_id", "value", _MAD + ", r AS (SELECT quantile_cont(value, 0.5) AS v FROM events, b WHERE value BETWEEN lo AND hi) SELECT event_id, round(CASE WHEN value < lo OR value > hi THEN v ELSE value END, 6) AS value FROM events, b, r", action="median")
_outlier("iqr", "events", "event_id", "value", "WITH q AS (" + _QUARTILES.format(c="value", t="events") + ") SELECT event_id, round(greatest(least(value, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)), 6) AS value FROM events, q", action="winsorize")
_outlier("three_sigma", "events", "event_id", "value", "WITH b AS (SELECT avg(value) - 2 * stddev_samp(value) AS lo, avg(value) + 2 * stddev_samp(value) AS hi FROM events), r AS (SELECT avg(value) AS v FROM events, b WHERE value BETWEEN lo AND hi) SELECT event_id, round(CASE WHEN value < lo OR value > hi THEN v ELSE value END, 6) AS value FROM events, b, r", action="mean", k=2.0)
_outlier("custom", "customer", "c_custkey", "c_acctbal", "SELECT c_custkey, round(CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 0 ELSE c_acctbal END, 6) AS c_acctbal FROM customer", bounds={"c_acctbal": {"minimum": 0, "maximum": 9000}}, action="zero")


@add("invalid_sample_handling_rule_based", """SELECT l_orderkey, l_linenumber, (l_quantity < 5 OR l_quantity > 45) AS invalid_sample FROM lineitem""")
def q_rule(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    r = op(df, "invalid_sample_handling.rule_based", {"check_columns": ["l_quantity", "l_tax"]}, LINE_Q, rules=[{"type": "value_range", "columns": ["l_quantity"], "minimum": 5, "maximum": 45}])
    return r.data.select("l_orderkey", "l_linenumber", "invalid_sample")


@add("invalid_sample_handling_custom_rules", """
WITH s AS (SELECT doc_id, 2.0::DOUBLE * (count(*) OVER (PARTITION BY text) > 1)::INT + (lang NOT IN ('en', 'de'))::INT + (NOT regexp_full_match(source, 'src[0-9]'))::INT AS score FROM documents) SELECT doc_id FROM s WHERE score < 2""")
def q_rules(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    rules = [{"type": "duplicate_row", "columns": ["text"], "weight": 2}, {"type": "allowed_values", "columns": ["lang"], "values": ["en", "de"]}, {"type": "pattern", "columns": ["source"], "pattern": "src[0-9]"}]
    r = op(df, "invalid_sample_handling.custom_rules", {"check_columns": ["text", "lang", "source"]}, metas(c="text lang source"), rules=rules, combination="weighted_score", score_threshold=2, action="remove_rows")
    return r.data.select("doc_id")


EVENT = metas("value", "event_type", ints="event_id", t="ts")


@add("time_series_window_sliding", """
WITH p AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS p, ts, value FROM events), l AS (SELECT p, value AS a, lead(value, 1) OVER w AS b, lead(value, 2) OVER w AS c, lead(value, 3) OVER w AS t, ts AS s, lead(ts, 2) OVER w AS e FROM p WINDOW w AS (ORDER BY p))
SELECT p AS window_start, p + 2 AS window_end, a AS value_lag_1, b AS value_lag_2, c AS value_lag_3, t AS value_target, epoch_us(s) AS start_us, epoch_us(e) AS end_us FROM l WHERE p % 5 = 0 AND t IS NOT NULL""")
def q_sliding(spark, d):
    r = op(table(spark, d, "events"), "time_series_window.sliding", {"value_column": ["value"], "order_column": ["ts"]}, EVENT, step_size=5, duplicate_order="keep")
    return r.data.select("window_start", "window_end", "value_lag_1", "value_lag_2", "value_lag_3", "value_target", F.unix_micros(F.col("order_start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("order_end").cast("timestamp")).alias("end_us"))


@add("data_downsampling_periodic_sample", """SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS p FROM events) WHERE p % 7 = 2""")
def q_periodic(spark, d):
    return op(table(spark, d, "events"), "data_downsampling.periodic_sample", {"value_columns": ["value"], "order_column": ["ts"]}, EVENT, factor=7, offset=2).data.select("event_id", "value")


@add("data_downsampling_block_aggregate", """SELECT min(event_id) AS event_id, round(avg(value), 6) AS value FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) GROUP BY p // 10""")
def q_block(spark, d):
    r = op(table(spark, d, "events").select("event_id", "value"), "data_downsampling.block_aggregate", {"value_columns": ["value"], "order_column": ["event_id"]}, EVENT, factor=10)
    return r.data.select("event_id", F.round("value", 6).alias("value"))


@add("data_downsampling_filtered_decimate")
def q_decimate(spark, d):
    r = op(table(spark, d, "events").select("event_id", "value"), "data_downsampling.filtered_decimate", {"value_columns": ["value"], "order_column": ["event_id"]}, EVENT, factor=4)
    return r.data.select("event_id", F.round("value", 6).alias("value"))


_PAIR = "variable_1 string, variable_2 string, coefficient double, sample_count long"


def _correlation(method: str):
    def query(spark, d):
        df = table(spark, d, "part").select(F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("price"), F.col("p_size").cast("double").alias("size"))
        r = op(df, f"correlation_analysis.{method}", {"x_columns": ["price", "size"]}, metas("price size"))
        return small(spark, [(x["variable_1"], x["variable_2"], rounded(x["coefficient"]), x["sample_count"]) for x in r.tables[0].rows()], _PAIR)

    return query


_PART = "WITH p AS (SELECT CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price, p_size::DOUBLE AS size FROM part)"
_DIAGONAL = " UNION ALL SELECT 'price', 'price', 1.0::DOUBLE, count(price) FROM p UNION ALL SELECT 'size', 'size', 1.0::DOUBLE, count(*) FROM p"
add("correlation_analysis_pearson", _PART + " SELECT 'price' AS variable_1, 'size' AS variable_2, round(corr(price, size), 6) AS coefficient, count(price) AS sample_count FROM p" + _DIAGONAL)(_correlation("pearson"))
add("correlation_analysis_spearman", _PART + """, r AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0::DOUBLE AS b FROM p WHERE price IS NOT NULL)
 SELECT 'price' AS variable_1, 'size' AS variable_2, round(corr(a, b), 6) AS coefficient, count(*) AS sample_count FROM r""" + _DIAGONAL)(_correlation("spearman"))
add("correlation_analysis_kendall_tau_b", _PART + """, q AS (SELECT * FROM p WHERE price IS NOT NULL), s AS (SELECT sum(sign(a.price - b.price) * sign(a.size - b.size)) AS s, sum((a.price <> b.price)::INT) AS x, sum((a.size <> b.size)::INT) AS y FROM q a, q b)
 SELECT 'price' AS variable_1, 'size' AS variable_2, round(s / (sqrt(x) * sqrt(y)), 6) AS coefficient, (SELECT count(*) FROM q) AS sample_count FROM s""" + _DIAGONAL)(_correlation("kendall_tau_b"))


@add("association_auto_solver_auto", """
WITH g AS (SELECT event_type AS g, avg(value) AS m, count(*) AS n, var_pop(value) AS v FROM events GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS mu FROM g)
SELECT 'event_type' AS variable_1, 'value' AS variable_2, 'eta_squared' AS method, round(sum(n * pow(m - mu, 2)) / sum(n * pow(m - mu, 2) + n * v), 6) AS statistic, CAST(sum(n) AS BIGINT) AS sample_count FROM g, t
UNION ALL SELECT 'value', 'event_id', 'pearson', round(corr(value, event_id), 6), count(*) FROM events
UNION ALL (WITH t2 AS (SELECT avg(event_id) AS mu FROM events), g2 AS (SELECT avg(event_id) AS m, count(*) AS n, var_pop(event_id) AS v FROM events GROUP BY event_type)
 SELECT 'event_type', 'event_id', 'eta_squared', round(sum(n * pow(m - mu, 2)) / sum(n * pow(m - mu, 2) + n * v), 6), CAST(sum(n) AS BIGINT) FROM g2, t2)""")
def q_auto_association(spark, d):
    r = op(table(spark, d, "events").select("event_type", "value", "event_id"), "association_auto_solver.auto", {"analysis_columns": ["event_type", "value", "event_id"]}, EVENT)
    return small(spark, [(x["variable_1"], x["variable_2"], x["method"], rounded(x["statistic"]), x["sample_count"]) for x in r.tables[0].rows()], "variable_1 string, variable_2 string, method string, statistic double, sample_count long")


@add("cochran_q_related_binary", """
WITH b AS (SELECT (o_totalprice > 150000)::INT AS a, (o_orderpriority < '3')::INT AS b, (o_orderkey % 3 = 0)::INT AS c FROM orders), s AS (SELECT sum(a) AS ga, sum(b) AS gb, sum(c) AS gc, sum(pow(a + b + c, 2)) AS sq, count(*) AS n FROM b)
SELECT round(2 * (3 * (ga * ga + gb * gb + gc * gc)::DOUBLE - pow(ga + gb + gc, 2)) / (3 * (ga + gb + gc) - sq), 6) AS q_statistic, n AS sample_count FROM s""")
def q_cochran(spark, d):
    conditions = {"c1": F.col("o_totalprice") > 150000, "c2": F.col("o_orderpriority") < "3", "c3": F.col("o_orderkey") % 3 == 0}
    df = table(spark, d, "orders").select(*(F.when(c, "yes").otherwise("no").alias(n) for n, c in conditions.items()))
    r = op(df, "cochran_q.related_binary", {"condition_columns": ["c1", "c2", "c3"]}, metas(c="c1 c2 c3"), positive_value="yes")
    return small(spark, [(rounded(r.metric("q_statistic")), r.metric("sample_count"))], "q_statistic double, sample_count long")


_RATERS = "WITH r AS (SELECT l_linenumber % 4 AS a, CASE WHEN l_orderkey % 5 = 0 THEN (l_linenumber + 1) % 4 ELSE l_linenumber % 4 END AS b, CASE WHEN l_orderkey % 7 = 0 THEN (l_linenumber + 2) % 4 ELSE l_linenumber % 4 END AS c, l_quantity AS w FROM lineitem)"


def _raters(spark, d):
    k, line = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    return table(spark, d, "lineitem").select((line % 4).alias("a"), F.when(k % 5 == 0, (line + 1) % 4).otherwise(line % 4).alias("b"), F.when(k % 7 == 0, (line + 2) % 4).otherwise(line % 4).alias("c"), F.col("l_quantity").alias("w"))


def _kappa(kind: str, distance: str | None):
    def query(spark, d):
        raters = ["a", "b", "c"] if kind == "fleiss" else ["a", "b"]
        r = op(_raters(spark, d), f"kappa_agreement.{kind}", {"rater_columns": raters, "frequency_weight": ["w"]}, metas("w", ints="a b c"))
        return small(spark, [(rounded(r.metric("kappa")), r.metric("sample_count"))], "kappa double, sample_count long")

    if distance:
        sql = _RATERS + f""", g AS (SELECT a, b, sum(w) AS n FROM r GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS n FROM g GROUP BY 1), rb AS (SELECT b, sum(n) AS n FROM g GROUP BY 1)
        SELECT round(1 - (SELECT sum(n * ({distance})) FROM g) / (SELECT sum(ra.n * rb.n * ({distance})) / (SELECT sum(n) FROM g) FROM ra, rb), 6) AS kappa, (SELECT count(*) FROM r) AS sample_count"""
    else:
        sql = _RATERS + """, p AS (SELECT sum(w) AS tw, sum(w * ((a = b)::INT + (a = c)::INT + (b = c)::INT) / 3.0::DOUBLE) AS s FROM r), l AS (SELECT a AS k, w FROM r UNION ALL SELECT b, w FROM r UNION ALL SELECT c, w FROM r),
        e AS (SELECT sum(pow(n / (3 * tw), 2)) AS e FROM (SELECT k, sum(w) AS n FROM l GROUP BY 1), p) SELECT round((s / tw - e) / (1 - e), 6) AS kappa, (SELECT count(*) FROM r) AS sample_count FROM p, e"""
    add(f"kappa_agreement_{kind}", sql)(query)


_kappa("cohen", "(a <> b)::INT")
_kappa("linear_weighted", "abs(a - b)")
_kappa("quadratic_weighted", "pow(a - b, 2)")
_kappa("fleiss", None)


@add("kendall_w_concordance", """
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0::DOUBLE AS b, rank() OVER (ORDER BY p_partkey % 50) + (count(*) OVER (PARTITION BY p_partkey % 50) - 1) / 2.0::DOUBLE AS c FROM part),
t AS (SELECT sum(pow(n, 3) - n) AS t FROM (SELECT count(*)::DOUBLE AS n FROM part GROUP BY p_size UNION ALL SELECT count(*) FROM part GROUP BY p_retailprice UNION ALL SELECT count(*) FROM part GROUP BY p_partkey % 50))
SELECT round(12 * var_pop(a + b + c) * count(*) / (9 * (pow(count(*), 3) - count(*)) - 3 * t), 6) AS kendall_w FROM r, t GROUP BY t""")
def q_kendall_w(spark, d):
    df = table(spark, d, "part").select(F.col("p_size").cast("long").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_partkey") % 50).alias("c"))
    r = op(df, "kendall_w.concordance", {"rater_columns": ["a", "b", "c"]}, metas("b", ints="a c"))
    return small(spark, [(rounded(r.metric("kendall_w")),)], "kendall_w double")


@add("canonical_correlation_basic", """
WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS rx, corr(l_discount, l_tax) AS ry, corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b, corr(l_extendedprice, l_discount) AS c, corr(l_extendedprice, l_tax) AS e FROM lineitem),
m AS (SELECT ((a - rx * c) * (a - ry * b) + (b - rx * e) * (b - ry * a) + (c - rx * a) * (c - ry * e) + (e - rx * b) * (e - ry * c)) / ((1 - rx * rx) * (1 - ry * ry)) AS tr, (a * e - b * c) * (a * e - b * c) / ((1 - rx * rx) * (1 - ry * ry)) AS det FROM r)
SELECT k::INTEGER AS component, round(sqrt(greatest(0, (tr + (3 - 2 * k) * sqrt(greatest(0, tr * tr - 4 * det))) / 2)), 5) AS canonical_correlation FROM m, range(1, 3) t(k)""")
def q_canonical(spark, d):
    r = op(table(spark, d, "lineitem"), "canonical_correlation.basic", {"x_set": ["l_quantity", "l_extendedprice"], "y_set": ["l_discount", "l_tax"]}, LINE_Q)
    return small(spark, [(x["component"], rounded(x["canonical_correlation"], 5)) for x in r.table("canonical_correlations").rows()], "component int, canonical_correlation double")


# Cells are joined from the right while fewer than five are expected, so the last one starts at the greatest count whose tail is that large.
@add("poisson_goodness_of_fit_chi_square", """
WITH c AS (SELECT l_linenumber AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), r AS (SELECT sum(k * n) / sum(n) AS rate, sum(n) AS t, max(k) AS most FROM c),
e AS (SELECT x.k, coalesce(n, 0) AS seen, t * exp(x.k * ln(rate) - rate - lgamma(x.k + 1)) AS wanted, t, rate FROM r, range(0, 1000) x(k) LEFT JOIN c USING (k) WHERE x.k <= greatest(most, ceil(rate + 6 * sqrt(rate)))),
u AS (SELECT *, t - coalesce(sum(wanted) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tail, t - coalesce(sum(seen) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen_tail FROM e),
l AS (SELECT max(k) AS last FROM u WHERE tail >= 5 OR k = 1)
SELECT round(max(rate), 6) AS lambda, round(sum(CASE WHEN k < last THEN (seen - wanted) * (seen - wanted) / wanted ELSE (seen_tail - tail) * (seen_tail - tail) / tail END), 4) AS chi_square, (max(last) - 1)::BIGINT AS degrees FROM u, l WHERE k <= last""")
def q_poisson(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("k"))
    r = op(df, "poisson_goodness_of_fit.chi_square", {"count_column": ["k"]}, metas(ints="k"))
    return small(spark, [(rounded(r.metric("lambda")), rounded(r.metric("chi_square"), 4), int(r.metadata["degrees_of_freedom"]))], "lambda double, chi_square double, degrees long")


_RUNS = """WITH b AS ({b}), s AS (SELECT b, lag(b) OVER (ORDER BY ts) AS p FROM b WHERE b IS NOT NULL), c AS (SELECT 1 + sum((b <> p)::INT)::DOUBLE AS runs, sum(b)::DOUBLE AS n1, count(*) - sum(b)::DOUBLE AS n0 FROM s)
SELECT runs::BIGINT AS runs, n0::BIGINT AS class_0_count, n1::BIGINT AS class_1_count, round((runs - (2 * n0 * n1 / (n0 + n1) + 1)) / sqrt(2 * n0 * n1 * (2 * n0 * n1 - n0 - n1) / (pow(n0 + n1, 2) * (n0 + n1 - 1))), 6) AS z_statistic FROM c"""


def _runs(kind: str, sql: str, column: str = "value", **params: Any) -> None:
    def query(spark, d):
        df = table(spark, d, "events").withColumn("two", F.when(F.col("event_type") < "m", "a").otherwise("b"))
        r = op(df, f"runs_test.{kind}", {"x_columns": [column], "order_column": ["ts"]}, EVENT | metas(c="two"), **params)
        return small(spark, [(x["runs"], x["class_0_count"], x["class_1_count"], rounded(x["z_statistic"])) for x in r.tables[0].rows()], "runs long, class_0_count long, class_1_count long, z_statistic double")

    add(f"runs_test_{kind}", _RUNS.format(b=sql))(query)


_runs("median_cut", "SELECT ts, CASE WHEN value > m THEN 1 WHEN value < m THEN 0 END AS b FROM events, (SELECT quantile_cont(value, 0.5) AS m FROM events)")
_runs("custom_cut", "SELECT ts, CASE WHEN value >= 10 THEN 1 ELSE 0 END AS b FROM events", cut_value=10, ties="upper")
_runs("binary", "SELECT ts, (event_type >= 'm')::INT AS b FROM events", column="two")

_COEF = "feature string, coefficient double"


@add("linear_regression_ols", """
WITH m AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS b0, regr_slope(l_extendedprice, l_quantity) AS b1, regr_r2(l_extendedprice, l_quantity) AS r2, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_avgx(l_extendedprice, l_quantity) AS mx, count(*) AS n FROM lineitem),
s AS (SELECT *, (1 - r2) * syy / (n - 2) AS v FROM m),
f AS (SELECT 'intercept' AS feature, b0 AS b, sqrt(v * (1.0 / n + mx * mx / sxx)) AS se, r2 FROM s UNION ALL SELECT 'l_quantity', b1, sqrt(v / sxx), r2 FROM s)
SELECT feature, round(b, 4) AS coefficient, round(se, 4) AS standard_error, round(b / se, 3) AS t_value, round(r2, 6) AS r_squared FROM f""")
def q_ols(spark, d):
    r = op(table(spark, d, "lineitem").select("l_extendedprice", "l_quantity"), "linear_regression.ols", {"y_column": ["l_extendedprice"], "x_columns": ["l_quantity"]}, LINE_Q)
    rows = [(x["feature"], rounded(x["coefficient"], 4), rounded(x["standard_error"], 4), rounded(x["coefficient"] / x["standard_error"], 3), rounded(r.metric("r_squared"))) for x in r.table("coefficients").rows()]
    return small(spark, rows, "feature string, coefficient double, standard_error double, t_value double, r_squared double")


@add("ridge_regression_fixed_alpha", """
WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, stddev_pop(l_quantity) AS s FROM lineitem)
SELECT 'l_quantity' AS feature, round(sum((l_quantity - mx) / s * (l_extendedprice - my)) / (sum(pow((l_quantity - mx) / s, 2)) + 10), 4) AS coefficient FROM lineitem, m""")
def q_ridge(spark, d):
    r = op(table(spark, d, "lineitem"), "ridge_regression.fixed_alpha", {"y_column": ["l_extendedprice"], "x_columns": ["l_quantity"]}, LINE_Q, alpha=10)
    return small(spark, [(x["feature"], rounded(x["coefficient"], 4)) for x in r.table("ridge_coefficients").rows()], _COEF)


def _eliminated(prefix: str, width: int, kept: list[str]) -> str:
    """CTEs that solve the equations a0_0 .. of ``{prefix}0``, one pivot each; ``{prefix}{width}`` holds the solution in column ``width``."""
    cells = [(i, j) for i in range(width) for j in range(width + 1)]
    ctes = []
    for k in range(width):
        terms = [f"a{i}_{j} / a{k}_{k} AS a{i}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i, j in cells]
        ctes.append(f"{prefix}{k + 1} AS (SELECT {', '.join(kept + terms)} FROM {prefix}{k})")
    return ",\n".join(ctes)


def _ridge_cv_sql(width: int, folds: int, alphas: str) -> str:
    x = [f"x{i}" for i in range(width)]
    names = [*x, "y"]
    scale = ", ".join(f"avg({c}) AS c_{c}, stddev_pop({c}) AS s_{c}" for c in x)
    scaled = ", ".join(f"({c} - c_{c}) / s_{c} AS {c}" for c in x)
    gram = ", ".join(f"covar_pop({x[i]}, {names[j]}) * count(*) AS a{i}_{j}" for i in range(width) for j in range(width + 1))
    means = ", ".join(f"avg({c}) AS m_{c}" for c in names)
    fit = " + ".join(f"a{i}_{width} * ({c} - m_{c})" for i, c in enumerate(x))
    source = "SELECT l_extendedprice AS y, l_quantity AS x0, l_discount AS x1, (l_returnflag = 'N')::INT::DOUBLE AS x2, (l_returnflag = 'R')::INT::DOUBLE AS x3 FROM lineitem"
    return f"""WITH {drawn(source, 42)},
s AS (SELECT {scale} FROM drawn),
z AS (SELECT ((draw % {folds}) + {folds}) % {folds} AS fold, {scaled}, y FROM drawn, s),
g AS (SELECT f, {means}, {gram} FROM z JOIN range({folds}) t(f) ON fold <> f GROUP BY f),
e0 AS (SELECT * REPLACE ({", ".join(f"a{i}_{i} + alpha AS a{i}_{i}" for i in range(width))}) FROM g, (VALUES {alphas}) t(alpha)),
{_eliminated("e", width, ["f", "alpha", *(f"m_{c}" for c in names)])},
r AS (SELECT alpha, f, avg(pow(y - m_y - ({fit}), 2)) AS mse FROM z JOIN e{width} ON fold = f GROUP BY alpha, f)
SELECT alpha, round(avg(mse), 0) AS mean_mse FROM r GROUP BY alpha"""


# Errors are near 9e8, so whole numbers are nine digits.
@add("ridge_regression_cross_validated", _ridge_cv_sql(4, 5, "(0.01::DOUBLE), (0.1), (1), (10), (100)"))
def q_ridge_cv(spark, d):
    r = op(table(spark, d, "lineitem"), "ridge_regression.cross_validated", {"y_column": ["l_extendedprice"], "x_columns": ["l_quantity", "l_discount", "l_returnflag"]}, LINE_Q)
    return small(spark, [(float(x["alpha"]), rounded(x["mean_mse"], 0)) for x in r.table("cv_curve").rows()], "alpha double, mean_mse double")


@add("hierarchical_regression_blockwise_ols", """
WITH c AS (SELECT corr(l_extendedprice, l_quantity) AS a, corr(l_extendedprice, l_discount) AS b, corr(l_quantity, l_discount) AS c FROM lineitem)
SELECT 1 AS block, round(a * a, 6) AS r_squared FROM c UNION ALL SELECT 2, round((a * a + b * b - 2 * a * b * c) / (1 - c * c), 6) FROM c""")
def q_hierarchical(spark, d):
    r = op(table(spark, d, "lineitem"), "hierarchical_regression.blockwise_ols", {"y_column": ["l_extendedprice"], "block_1": ["l_quantity"], "block_2": ["l_discount"]}, LINE_Q)
    return small(spark, [(x["block"], rounded(x["r_squared"])) for x in r.table("hierarchical_models").rows()], "block int, r_squared double")


# The shift is the first of up to 100,000 steps that brings all level ratios within bounds.
@add("grey_forecast_gm11_basic", """
WITH y AS (SELECT year(o_orderdate)::VARCHAR AS t, count(*)::DOUBLE AS v FROM orders GROUP BY 1),
o AS (SELECT row_number() OVER (ORDER BY t) AS i, v, lag(v) OVER (ORDER BY t) AS p FROM y),
m AS (SELECT count(*) AS n, greatest(0, -min(v) + 1e-8) AS start, 0.1 * greatest(stddev_pop(v), 1.0) AS width, exp(-2.0 / (count(*) + 1)) AS lo, exp(2.0 / (count(*) + 1)) AS hi FROM o),
plain AS (SELECT bool_and(v > 0 AND (p IS NULL OR (p / v > lo AND p / v < hi))) AS good FROM o, m),
tried AS (SELECT k, bool_and(v + start + k * width > 0 AND (p IS NULL OR ((p + start + k * width) / (v + start + k * width) > lo AND (p + start + k * width) / (v + start + k * width) < hi))) AS good FROM range(0, 100000) r(k), o, m GROUP BY k),
s AS (SELECT CASE WHEN good THEN 0 ELSE start + (SELECT min(k) FROM tried WHERE good) * width END AS shift FROM plain, m),
x AS (SELECT i, v + shift AS x, sum(v + shift) OVER (ORDER BY i) AS c FROM o, s),
z AS (SELECT x, -(c + lag(c) OVER (ORDER BY i)) / 2 AS z FROM x),
g AS (SELECT regr_slope(x, z) AS a, regr_intercept(x, z) AS u FROM z WHERE z IS NOT NULL)
SELECT step::INTEGER AS step, round(((SELECT x FROM x WHERE i = 1) - u / a) * (exp(-a * (n + step - 1)) - exp(-a * (n + step - 2))) - shift, 3) AS forecast FROM g, m, s, range(1, 3) r(step)""")
def q_grey(spark, d):
    months = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("string").alias("year")).agg(F.count("*").cast("double").alias("n"))
    r = op(months, "grey_forecast_gm11.basic", {"y_column": ["n"], "time_column": ["year"]}, metas("n", "year"), forecast_steps=2)
    return small(spark, [(x["step"], rounded(x["forecast"], 3)) for x in r.table("gm11_forecast").rows()], "step int, forecast double")


def _pca(kind: str, sql: str | None, **params: Any) -> None:
    def query(spark, d):
        r = op(table(spark, d, "lineitem"), f"principal_component_analysis.{kind}", {"x_columns": ["l_quantity", "l_extendedprice"]}, LINE_Q, **params)
        return small(spark, [(x["component"], rounded(x["eigenvalue"], 5), rounded(x["explained_variance_ratio"], 5)) for x in r.table("explained_variance").rows()], "component string, eigenvalue double, explained_variance_ratio double")

    add(f"principal_component_analysis_{kind}", sql)(query)


_TWO = "WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r, count(*)::DOUBLE AS n FROM lineitem) SELECT 'PC1' AS component, round((1 + r) * n / (n - 1), 5) AS eigenvalue, round((1 + r) / 2, 5) AS explained_variance_ratio FROM c"
_pca("fixed_components", _TWO + " UNION ALL SELECT 'PC2', round((1 - r) * n / (n - 1), 5), round((1 - r) / 2, 5) FROM c")
_pca("eigenvalue_threshold", _TWO)


def vectors(spark: SparkSession, d: str, width: int = 4) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", *(F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(width)), F.concat(F.lit("k"), (F.col("label") % 3).cast("string")).alias("class"))


_E = metas("e0 e1 e2 e3", "class", ints="vec_id")


@add("kmeans_clustering_standard")
def q_kmeans(spark, d):
    r = op(vectors(spark, d), "kmeans_clustering.standard", {"x_columns": ["e0", "e1", "e2", "e3"]}, _E, n_init=2)
    return r.data.select("vec_id", "cluster_kmeans")


@add("dbscan_clustering_standard", """
WITH RECURSIVE e AS (SELECT vec_id, row_number() OVER () AS r, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
s AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM e),
x AS (SELECT vec_id, r, a / sa AS a, b / sb AS b FROM e, s),
near AS (SELECT p.r AS i, q.r AS j FROM x p, x q WHERE sqrt(pow(p.a - q.a, 2) + pow(p.b - q.b, 2)) <= 0.15),
core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 5),
links AS (SELECT n.i, n.j FROM near n JOIN core c ON n.i = c.i JOIN core d ON n.j = d.i),
reached AS (SELECT i AS root, i AS j FROM core UNION SELECT w.root, l.j FROM reached w JOIN links l ON w.j = l.i),
roots AS (SELECT j AS i, min(root) AS root FROM reached GROUP BY j),
named AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS k FROM roots),
border AS (SELECT n.i, min(k) AS k FROM near n JOIN named m ON n.j = m.i GROUP BY n.i)
SELECT vec_id, coalesce(m.k, o.k, -1)::BIGINT AS cluster_dbscan FROM x LEFT JOIN named m ON m.i = x.r LEFT JOIN border o ON o.i = x.r""")
def q_dbscan(spark, d):
    r = op(vectors(spark, d), "dbscan_clustering.standard", {"x_columns": ["e0", "e1"]}, _E, eps=0.15)
    return r.data.select("vec_id", "cluster_dbscan")


_SCORE = "accuracy double, f1 double"


def _classifier(key: str, sql: str | None, slots: dict[str, list[str]], **params: Any) -> None:
    def query(spark, d):
        df = vectors(spark, d).withColumns({"two": F.when(F.col("class") == "k0", "no").otherwise("yes"), "sign": F.when(F.col("e1") > 0, "up").otherwise("down")})
        r = op(df, key, slots, _E | metas(c="two sign"), **params)
        return small(spark, [(rounded(r.metric("accuracy")), rounded(r.metric("f1") if key.split(".")[0] != "lightgbm_classification" else r.metric("f1_weighted")))], _SCORE)

    add(key.replace(".", "_"), sql)(query)


_VECTORS = "SELECT embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1, embedding[3]::DOUBLE AS e2, 'k' || (label % 3) AS class, CASE WHEN embedding[2]::DOUBLE > 0 THEN 'up' ELSE 'down' END AS sign FROM embeddings"


def _bayes_sql(numbers: list[str], words: list[str], prior: str, variance: str, extra: str) -> str:
    """Accuracy and weighted F1 over the rows held out of a stratified split of 0.8."""
    stats = "".join(f", avg({c}) AS m_{c}, {variance}({c}) + ({extra}) AS v_{c}" for c in numbers)
    score = "".join(f" - 0.5 * ln(2 * pi() * v_{c}) - pow({c} - m_{c}, 2) / (2 * v_{c})" for c in numbers)
    score += "".join(f" + ln(((SELECT count(*) FROM train WHERE train.class = p.class AND train.{c} = q.{c}) + 1.0) / (p.n + (SELECT count(DISTINCT {c}) FROM ranked)))" for c in words)
    return f"""WITH {drawn(_VECTORS, 42)},
{_PARTS.format(y="class")},
parts AS (SELECT class, count(*) AS n{stats} FROM train GROUP BY class),
scored AS (SELECT q.number, q.class AS y, p.class AS c, ln({prior}){score} AS s FROM test q, parts p),
best AS (SELECT y, c FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY s DESC, c) AS place FROM scored) WHERE place = 1),
f AS (SELECT class, (SELECT count(*) FROM best WHERE y = class) AS support, (SELECT count(*) FROM best WHERE c = class) AS given, (SELECT count(*) FROM best WHERE y = class AND c = class) AS hit FROM parts)
SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(sum(support * 2.0::DOUBLE * hit / (support + given)) / sum(support), 6) AS f1 FROM f WHERE support + given > 0"""


_PARTS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY {y} ORDER BY draw, number) AS rank, count(*) OVER (PARTITION BY {y}) AS size FROM drawn),
train AS (SELECT * FROM ranked WHERE rank <= least(greatest(1, round_even(size * 0.8::DOUBLE, 0)), size - 1)),
test AS (SELECT * FROM ranked WHERE rank > least(greatest(1, round_even(size * 0.8::DOUBLE, 0)), size - 1))"""


def _logistic_sql(steps: int = 12) -> str:
    """Newton's steps for the penalised log-loss with C = 1; the intercept is not penalised."""
    x = ["1", "a", "b", "u"]
    width = len(x)
    line = " + ".join(f"w{i} * {c}" for i, c in enumerate(x))
    scaled = "(e0 - ma) / sa AS a, (e1 - mb) / sb AS b, (sign = 'up')::INT::DOUBLE AS u, (class <> 'k0')::INT AS y"
    hessian = ", ".join(f"sum(p * (1 - p) * {x[i]} * {x[j]}) + {int(i == j and i > 0)} AS a{i}_{j}" for i in range(width) for j in range(width))
    slope = ", ".join(f"sum((y - p) * {c}) - {'0' if i == 0 else f'any_value(w{i})'} AS a{i}_{width}" for i, c in enumerate(x))
    ws = [f"w{i}" for i in range(width)]
    ctes = ["n0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS {w}" for w in ws) + ")"]
    for t in range(steps):
        ctes.append(f"s{t}_0 AS (SELECT {', '.join(f'any_value({w}) AS {w}' for w in ws)}, {hessian}, {slope} FROM (SELECT *, 1 / (1 + exp(-({line}))) AS p FROM z, n{t}))")
        ctes.append(_eliminated(f"s{t}_", width, ws))
        ctes.append(f"n{t + 1} AS MATERIALIZED (SELECT {', '.join(f'{w} + a{i}_{width} AS {w}' for i, w in enumerate(ws))} FROM s{t}_{width})")
    return f"""WITH {drawn(_VECTORS, 42)},
{_PARTS.format(y="(class = 'k0')")},
m AS (SELECT avg(e0) AS ma, stddev_pop(e0) AS sa, avg(e1) AS mb, stddev_pop(e1) AS sb FROM train),
z AS MATERIALIZED (SELECT {scaled} FROM train, m),
{", ".join(ctes)},
g AS (SELECT y, ({line} > 0)::INT AS c FROM (SELECT {scaled} FROM test, m), n{steps})
SELECT round(avg((y = c)::INT), 6) AS accuracy, round(2.0::DOUBLE * sum(y * c) / (sum(y) + sum(c)), 6) AS f1 FROM g"""


_SHARE, _SMOOTH = "p.n / (SELECT count(*) FROM train)", "(p.n + 1.0::DOUBLE) / ((SELECT count(*) FROM train) + (SELECT count(*) FROM parts))"
_LARGEST = "SELECT 1e-9 * greatest(var_pop(e0), var_pop(e1), var_pop(e2)) FROM train"
_classifier("logistic_regression.binary_gradient_descent", _logistic_sql(), {"y_column": ["two"], "x_columns": ["e0", "e1", "sign"]})
_classifier("naive_bayes_classification.gaussian", _bayes_sql(["e0", "e1", "e2"], [], _SHARE, "var_pop", _LARGEST), {"y_column": ["class"], "x_columns": ["e0", "e1", "e2"]})
_classifier("naive_bayes_classification.categorical", _bayes_sql([], ["sign"], _SHARE, "", ""), {"y_column": ["class"], "x_columns": ["sign"]})
_classifier("naive_bayes_classification.mixed", _bayes_sql(["e0", "e2"], ["sign"], _SMOOTH, "var_samp", "1e-9"), {"y_column": ["class"], "x_columns": ["e0", "e2", "sign"]})
_classifier("lightgbm_classification.standard", None, {"y_column": ["two"], "x_columns": ["e0", "e1", "e2"]}, n_estimators=10, num_leaves=8)
