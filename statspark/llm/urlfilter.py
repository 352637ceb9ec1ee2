"""URL rules by a sort-merge range join with a stack of nested rules.

A rule names a host and a path prefix; it fits that host, its subdomains, and
the paths that start with the prefix. The canonical key of a host and path is
the host's labels from right to left, each closed by a comma, then ``)`` and the path:
``org,example,)/en/1``. A URL has one key for each suffix of its host, and a
rule fits if its key is a prefix of one of them: a URL's key then lies in the
interval of keys that start with the rule's.

URL keys are range-partitioned and sorted (with the row as second key, so that
equal keys spread). Rules are swept along in the same order; the stack holds the
rules whose interval is open, the longest on top. The rule table is sorted and
shared with all executors while its counted rows stay within ``BROADCAST_RULES``.
Beyond, the rules are range-partitioned together with the URLs, and every partition
gets the rules still open at its first key: prefixes of that one key.

The longest fitting rule wins, measured in characters of host plus path; among
equals the longer host, then the rule that sorts first. Without a fitting rule
the verdict is ``default``.

Defined cases: a null URL or one without ``://`` has an empty host and path and no
rule; of repeated rules with unlike actions, block wins; a rule with a null part
is ignored; repeated URLs are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, settled

BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels from right to left, each closed by a comma, so that no host's key starts another's by chance."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(","))


def _keys(host: Column, path: Column) -> Column:
    """One key for each suffix of the host."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), ","), F.lit(",)"), path))).otherwise(F.array().cast("array<string>"))


class _Sweep:
    """Sorted rules beside sorted keys: a stack of the rules whose interval holds the current key."""

    def __init__(self, rules: Iterator[tuple[bytes, str]]) -> None:
        self.rules, self.stack = rules, []
        self.upcoming = next(rules, None)

    def add(self, key: bytes, rule: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        self.stack.append((key, rule))

    def top(self, key: bytes) -> str | None:
        while self.upcoming is not None and self.upcoming[0] <= key:
            self.add(*self.upcoming)
            self.upcoming = next(self.rules, None)
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        return self.stack[-1][1] if self.stack else None


MATCH_SCHEMA = "row long, rule string"


def _emit(found: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], ["row", "rule"])


def _match_shared(spark: SparkSession, keys: DataFrame, rules: DataFrame) -> DataFrame:
    table = spark.sparkContext.broadcast(sorted((r["key"].encode(), r["rule"]) for r in rules.select("key", "rule").collect()))

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Sweep(iter(table.value))
        for batch in batches:
            found = [(row, rule) for key, row in zip(batch.column("key").to_pylist(), batch.column("row").to_pylist(), strict=True) if (rule := state.top(key.encode()))]
            if found:
                yield _emit(found)

    return keys.repartitionByRange("key", "row").sortWithinPartitions("key", "row").select("key", "row").mapInArrow(sweep, MATCH_SCHEMA)


def _match_distributed(spark: SparkSession, keys: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """Rules take part in the range partitioning; the prefixes of each partition's first key are carried in."""
    both = rules.select("key", F.lit(-1).cast("long").alias("row"), "rule").unionByName(keys.select("key", "row", F.lit(None).cast("string").alias("rule")))

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int32()), *batch.columns], ["part", *batch.schema.names])

    laid = scratch.table(both.repartitionByRange("key", "row").sortWithinPartitions("key", "row").mapInArrow(numbered, "part int, key string, row long, rule string"))
    firsts = laid.groupBy("part").agg(F.min("key").alias("first"))
    prefixes = firsts.select("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda n: F.substring(F.col("first"), F.lit(1), n))).alias("key"))
    carried = rules.join(prefixes, "key").select("part", "key", F.lit(-1).cast("long").alias("row"), "rule")
    # A carried rule may also lie in the partition itself; the stack then holds it twice, harmlessly.
    together = laid.unionByName(carried).repartition("part").sortWithinPartitions("part", "key", "row")

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = _Sweep(iter(())), None
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if r["part"] != current:
                    state, current = _Sweep(iter(())), r["part"]
                if r["rule"] is not None:
                    state.add(r["key"].encode(), r["rule"])
                elif rule := state.top(r["key"].encode()):
                    found.append((r["row"], rule))
            if found:
                yield _emit(found)

    return together.mapInArrow(sweep, MATCH_SCHEMA)


def judge(spark: SparkSession, pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES, scratch: Scratch | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host plus path, or null) and ``verdict``; rules have host, path, action."""
    added = ("host", "path", "rule", "verdict", "row")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in added or c == url]
    # Row numbers are used twice, so they are settled with the kept columns first; pass only the columns you need.
    named = settled(pages.select(*kept, F.monotonically_increasing_id().alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")))
    clean = rules.where("host is not null and path is not null and action is not null").select(
        F.concat(host_key(F.col("host")), F.lit(")"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "action"
    )
    clean = clean.groupBy("key", "rule", "host_length").agg(F.max("action").alias("action"))
    keys = named.select("row", F.explode(_keys(F.col("host"), F.col("path"))).alias("key"))
    if clean.limit(broadcast_rules + 1).count() <= broadcast_rules:
        matched = _match_shared(spark, keys, _packed(clean))
    else:
        with scratch or Scratch(spark) as folder:
            matched = settled(_match_distributed(spark, keys, _packed(clean), folder))
    parts = F.from_json("rule", "rule string, host_length int, action string")
    best = matched.select("row", parts.alias("r")).groupBy("row").agg(F.max_by("r", F.struct(F.length("r.rule"), F.col("r.host_length"), F.col("r.rule"))).alias("r"))
    return named.join(best, "row", "left").select(*kept, "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", F.lit(default)).alias("verdict"))


def _packed(clean: DataFrame) -> DataFrame:
    return clean.select("key", F.to_json(F.struct("rule", "host_length", "action")).alias("rule"))
