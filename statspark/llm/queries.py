"""The text operators bound to the test tables, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def fold(column: str, k: int) -> F.Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % k


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(fold("doc_id", 5) != 0))
    found = langid.detect(spark, docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["place"] < len(pii.BASE_KINDS))
    digest = F.sha2(pii.joined(base), 256).alias("base_sha256")
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",")
    more = [count(k) for k in pii.KINDS if k not in pii.BASE_KINDS]
    return found.select("doc_id", *(count(k) for k in pii.BASE_KINDS), digest, pii.joined(F.col("pii")).alias("spans"), *more, F.size("pii").cast("long").alias("n_spans"), scores.alias("scores"))


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixdedup

    return suffixdedup.remove_repeats(spark, documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(spark, documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    found = media.summarize_texts(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256")


#: The contract's rules: action, host, path prefix.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlfilter

    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return urlfilter.judge(spark, table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
OP2_SQL = f"""
WITH parts AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(action, rhost, rpath) AS (VALUES {_RULE_ROWS}),
fits AS (
  SELECT r, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, rhost || rpath DESC) AS n
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (r)
"""


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(spark, documents(spark, sf_dir), shingle=2, percent=80)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source's folders; an id divisible by 50 is the licence file of its folder of 1000 ids."""
    from . import license as licences

    docs = documents(spark, sf_dir)
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"))
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.lit("part/"), F.col("doc_id"), F.lit(".txt")))
    files = docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text")
    judged = licences.own_licences(spark, files).drop("text")
    return licences.inherit(judged).select("doc_id", "path", "license", F.round("license_score", 6).alias("license_score"), "found_in")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = fold("doc_id", 3) == 1
    model = quality.fit(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return quality.score(spark, docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    windows = decontam.windows_of(table(spark, sf_dir, "benchmark"))
    return decontam.report(decontam.scan(documents(spark, sf_dir), windows), windows)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_url_filter": op2_url_filter,
    "op3_repeated_bytes": op3_repeated_bytes,
    "op4_packing": op4_packing,
    "op5_media": op5_media,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_licenses": op7_licenses,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
}
SQL: dict[str, str] = {"op2_url_filter": OP2_SQL}
