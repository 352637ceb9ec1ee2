"""A corpus pipeline: language, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of ``documents``. Stages that drop
rows tell them by their id where ids are unique and present, else by a 64-bit
hash of the whole row, so rows with a null or repeated id are judged by their
own text. Rows equal in all columns are copies; the near-duplicate stage keeps one.

Only keys of removed rows are joined to the texts. They are sent to all
executors while their counted number stays within a limit; beyond, Spark shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statspark.llm import common, decontam, langid, minhash, packing, pii, queries

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Share of the tempered evidence that the predicted language of a kept text has at least.
MIN_SCORE = 0.5


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents with ``row_key``."""
    rows = docs.select(*COLUMNS)
    ids = rows.select("doc_id")
    unique = ids.where("doc_id is null").isEmpty() and ids.groupBy("doc_id").count().where("count > 1").isEmpty()
    return rows.withColumn("row_key", F.col("doc_id").cast("long") if unique else F.xxhash64(*COLUMNS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, and those whose language is not told by more than half of the evidence; where no label is known, only the former."""
    model = langid.fit(docs)
    if not model.languages:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    return langid.reject(langid.detect(spark, docs.select(*COLUMNS), model), MIN_SCORE).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the least key of each group of near copies."""
    rows = _keyed(docs)
    judged = minhash.near_duplicates(spark, rows.select(F.col("row_key").alias("doc_id"), "text"))
    removed = judged.where(~F.col("kept")).select(F.col("doc_id").alias("row_key")).distinct()
    kept = rows.join(common.sized(removed), "row_key", "left_anti")
    equal = rows.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key")
    if equal.isEmpty():
        return kept.select(*COLUMNS)
    equal = common.sized(equal)
    return kept.join(equal, "row_key", "left_anti").select(*COLUMNS).unionByName(kept.join(equal, "row_key", "left_semi").select(*COLUMNS).distinct())


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    rows = _keyed(docs)
    windows = decontam.windows_of(queries.table(spark, sf_dir, "benchmark"))
    leaking = decontam.scan(rows, windows, key="row_key").where(F.size("hits") > 0).select(F.col("doc_id").alias("row_key")).distinct()
    return rows.join(common.sized(common.settled(leaking)), "row_key", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; ``n_chars`` follows."""
    clean = pii.redact(pii.find(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens."""
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("pii", personal_data),
    ("packing", pack),
]

#: Tokenisation, min-max hashing and the language model have no SQL form; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    scratch = common.Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs)
    scratch.close()  # the last stage's rows are settled already
    return docs
