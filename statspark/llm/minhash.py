"""Near-duplicate detection by min-max hashing.

Each text is the set of its distinct word shingles, as 64-bit hashes. Under each
of ``BANDS * ROWS / 2`` random permutations both the least and the greatest
value are kept, so a signature of 252 values costs 126 hash evaluations a
shingle. Bands of six values are hashed to bucket keys; two texts with
similarity 0.8 share no key with a chance of 3e-6.

1. Texts with equal sets form a class (a 128-bit digest of the sorted set); its
   representative is the least id, and only representatives go on.
2. Keys held by several representatives make candidates, in rounds: first each
   member with the bucket's least id, then with a bucket-wise random member, as
   far as they are not connected yet; last, the members of a bucket that are
   still in different components. Members that are already connected are not
   paired. Where a bucket leaves more than ``PAIRS_A_MEMBER`` such pairs a member,
   its members outside the largest component become queries against all its
   members, in blocks of sets compared as arrays; no candidate is dropped.
3. A pair whose 8-bit signatures agree far less than the threshold demands (by
   more than six standard deviations) is not confirmed; the others are compared
   on their full sets, computed again from the texts of the documents involved.
4. Links are contracted to components, by large-star / small-star rounds where they are many.

Only counts reach the driver. Intermediate tables live in the shared folder.

Defined cases: texts without words have an empty set and link with nothing; with
fewer words than a shingle, the whole sequence is the one shingle; a null id is
never linked and is its own component (null, ``kept`` true); repeated rows are one
document, each row answered alike; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, frugal, pieces, settled, sized
from .textkit import LOWER, U64, byte_values, mix, prefix_hash, signed, slices, span_hash, text_bytes, word_spans

BANDS, ROWS = 42, 6
VALUES = BANDS * ROWS
LEAST_AGREEMENT = 0.62
#: Unconnected pairs a member of a bucket up to which they are listed, and the members of a block beyond.
PAIRS_A_MEMBER, BLOCK_ROWS = 4, 256
BLOCK_BYTES = 4 << 20
EDGES_A_TASK = 500_000
#: Texts of one Arrow batch.
TEXT_ROWS = 1000
_SEEDS = (mix(np.arange(1, VALUES // 2 + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)).tolist()
_ORDER = np.random.default_rng(11).permutation(VALUES)
_BYTES = byte_values(23)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their offsets."""
    low = LOWER[data]
    starts, ends = word_spans(low, offsets, _IS_WORD)
    words = span_hash(prefix_hash(_BYTES[low]), starts, ends)
    of = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(of, np.arange(len(offsets)))
    rolled = words.copy()
    for j in range(1, k):
        rolled[: len(words) - j] = mix(rolled[: len(words) - j] * U64(0xD6E8FEB86659FD93) + words[j:])
    out, sizes = [], np.zeros(len(offsets), np.int64)
    for row in range(len(offsets) - 1):
        a, b = first[row], first[row + 1]
        if b - a >= k:
            found = np.unique(rolled[a : b - k + 1])
        elif b > a:
            whole = U64(0x5851F42D4C957F2D)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    whole = whole * U64(0x9E3779B97F4A7C15) + w
            found = mix(np.array([whole + U64(int(b - a))], U64))
        else:
            continue
        out.append(found)
        sizes[row + 1] = len(found)
    return np.concatenate(out) if out else np.zeros(0, U64), np.cumsum(sizes)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Least and greatest value of each non-empty set under each permutation, as rows of 32-bit values."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    found = np.empty((VALUES, len(starts)), np.uint32)
    for i, seed in enumerate(_SEEDS):
        values = ((hashes * U64(seed)) >> U64(32)).astype(np.uint32)
        np.minimum.reduceat(values, starts, out=found[2 * i])
        np.maximum.reduceat(values, starts, out=found[2 * i + 1])
    return found[_ORDER].T


SIGN_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, agree binary"


def _sign(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, offsets = text_bytes(batch.column("text"))
                ids = batch.column("doc_id")
                for a, b in slices(offsets):
                    hashes, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                    sizes = np.diff(at)
                    digests = np.zeros((b - a, 2), np.int64)
                    for row in np.flatnonzero(sizes):
                        digests[row] = np.frombuffer(hashlib.blake2b(hashes[at[row] : at[row + 1]].tobytes(), digest_size=16).digest(), np.int64)
                    keys: list = [None] * (b - a)
                    agree: list = [None] * (b - a)
                    if len(hashes):
                        signed_rows = signatures(hashes, at)
                        by_band = signed_rows.reshape(-1, BANDS, ROWS).astype(U64)
                        key = np.broadcast_to(np.arange(BANDS, dtype=U64) + U64(1), by_band.shape[:2])
                        for j in range(ROWS):
                            key = mix(key * U64(0x9E3779B97F4A7C15) + by_band[:, :, j])
                        low = (signed_rows & 0xFF).astype(np.uint8)
                        for n, row in enumerate(np.flatnonzero(sizes)):
                            keys[row] = signed(key[n])
                            agree[row] = low[n].tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(a, b - a), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array(agree, pa.binary())],
                        ["doc_id", "n_shingles", "set_a", "set_b", "bands", "agree"],
                    )

    return run


def _sets(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, offsets = text_bytes(batch.column("text"))
                for a, b in slices(offsets):
                    hashes, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                    rows = [hashes[at[i] : at[i + 1]].tobytes() for i in range(b - a)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(rows, pa.binary())], ["id", "members"])

    return run


def _agreeing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(-1, VALUES) for n in ("agree_a", "agree_b"))
        yield batch.select(["a", "b"]).filter(pa.array((left == right).mean(axis=1) >= LEAST_AGREEMENT))


def _confirm(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
                left, right = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _union(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least reachable ids of a bounded edge list, by union and find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in parent]
    moved = [(x, r) for x, r in found if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in moved], pa.int64()), pa.array([r for _, r in moved], pa.int64())], ["id", "component"])


def components(edges: DataFrame, one_task: int = EDGES_A_TASK) -> DataFrame:
    """(id, component) of every node that is not the least of its component, from an edge list (a, b).

    Up to a counted ``one_task`` edges (16 bytes each) one task joins them; beyond,
    large-star and small-star rounds go on until nothing changes.
    """
    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sums = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = edges.agg(*sums).first()
    if before[0] <= one_task:
        return settled(edges.coalesce(1).mapInArrow(_union, "id long, component long"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(large_least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = settled(small.where("u <> v").distinct())
        now = after.agg(*sums).first()
        if now == before:
            return after.select(F.col("u").alias("id"), F.col("v").alias("component"))
        edges, before = after, now


def _packed(block: int):
    """Rows sorted by (grp, salt) become blocks: ids, components and concatenated sets of one group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        weight = 0

        def made() -> pa.RecordBatch:
            sizes = [len(r["members"]) // 8 for r in held]
            cells = [[held[0]["grp"]], [[r["id"] for r in held]], [[r["component"] for r in held]], [sizes], [b"".join(r["members"] for r in held)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["grp", "ids", "components", "sizes", "hashes"])

        for batch in batches:
            for r in batch.to_pylist():
                if held and ((r["grp"], r["salt"]) != (held[0]["grp"], held[0]["salt"]) or len(held) >= block or weight > BLOCK_BYTES):
                    yield made()
                    held, weight = [], 0
                held.append(r)
                weight += len(r["members"])
        if held:
            yield made()

    return run


BLOCK_SCHEMA = "grp long, ids array<long>, components array<long>, sizes array<long>, hashes binary"


def _meet(percent: int):
    """Links of a block of queries to a block of targets: one for each query and component it reaches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for r in batch.to_pylist():
                targets = np.frombuffer(r["hashes"], U64)
                sizes = np.array(r["sizes"])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                known, place = np.unique(targets, return_inverse=True)
                components = np.array(r["components"])
                ids = np.array(r["ids"])
                queries = np.frombuffer(r["q_hashes"], U64)
                at = 0
                for query, own, size in zip(r["q_ids"], r["q_components"], r["q_sizes"], strict=True):
                    mine = queries[at : at + size]
                    at += size
                    where = np.searchsorted(known, mine)
                    where[where == len(known)] = 0
                    held = np.zeros(len(known), np.int64)
                    held[where[known[where] == mine]] = 1
                    both = np.add.reduceat(held[place], starts)
                    linked = np.flatnonzero((100 * both >= percent * (sizes + size - both)) & (components != own))
                    _, first = np.unique(components[linked], return_index=True)
                    found.extend((int(query), int(ids[k])) for k in linked[first])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


class _Linker:
    """Confirmed links between representatives, and their components so far."""

    def __init__(self, scratch: Scratch, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> None:
        self.spark, self.scratch, self.docs, self.reps, self.k, self.percent = docs.sparkSession, scratch, docs, reps, k, percent
        self.links: DataFrame | None = None
        self.found: DataFrame | None = None

    def placed(self, members: DataFrame, column: str = "rep", into: str = "component") -> DataFrame:
        """Members with the component so far of one of their columns."""
        if self.found is None:
            return members.withColumn(into, F.col(column))
        return members.join(sized(self.found.toDF(column, into)), column, "left").withColumn(into, F.coalesce(into, column))

    def confirm(self, pairs: DataFrame) -> None:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = settled(pairs)
        if pairs.isEmpty():
            return
        either = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
        signs = self.reps.join(sized(either), "rep", "left_semi").select("rep", "agree", "n_shingles")
        near = pairs.join(signs.toDF("a", "agree_a", "n_a"), "a").join(signs.toDF("b", "agree_b", "n_b"), "b")
        near = near.where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        near = settled(near.select("a", "b", "agree_a", "agree_b").mapInArrow(_agreeing, "a long, b long"))
        if near.isEmpty():
            return
        involved = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
        texts = self.docs.join(sized(involved), "doc_id", "left_semi")
        sets = self.scratch.table(texts.mapInArrow(frugal(_sets(self.k)), "id long, members binary"))
        linked = near.join(sets.toDF("a", "members_a"), "a").join(sets.toDF("b", "members_b"), "b").mapInArrow(frugal(_confirm(self.percent)), "a long, b long")
        with arrow_batches(self.spark, 256):
            self.add(linked)

    def add(self, linked: DataFrame) -> None:
        links = linked.distinct() if self.links is None else linked.unionByName(self.links).distinct()
        self.links = settled(links)
        self.found = components(self.links)

    def confirm_in_blocks(self, members: DataFrame) -> None:
        """Members (key, rep, component) of crowded buckets; buckets that share members are one group."""
        edges = members.groupBy("key").agg(F.min("rep").alias("b")).join(members.select("key", F.col("rep").alias("a")), "key")
        groups = components(edges.select("a", "b"))
        held = members.select("rep", "component").distinct().join(groups.toDF("rep", "grp"), "rep", "left").withColumn("grp", F.coalesce("grp", "rep"))
        held = settled(held)
        by_component = held.groupBy("grp", "component").agg(F.count("*").alias("n"))
        main = by_component.groupBy("grp").agg(F.max_by("component", "n").alias("main"), F.ceil(F.sum("n") / BLOCK_ROWS).alias("salts"))
        texts = self.docs.join(sized(held.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
        sets = texts.mapInArrow(frugal(_sets(self.k)), "id long, members binary")
        rows = self.scratch.table(held.withColumnRenamed("rep", "id").join(sets, "id").join(main, "grp").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))))

        def blocks(df: DataFrame) -> DataFrame:
            laid = df.select("grp", "salt", "id", "component", "members").repartition("grp", "salt").sortWithinPartitions("grp", "salt")
            return laid.mapInArrow(frugal(_packed(BLOCK_ROWS)), BLOCK_SCHEMA)

        with arrow_batches(self.spark, 4):
            targets = self.scratch.table(blocks(rows))
            queries = self.scratch.table(blocks(rows.where("component <> main"))).toDF("grp", "q_ids", "q_components", "q_sizes", "q_hashes")
            pairs = targets.join(queries, "grp").repartition(F.xxhash64(F.get("ids", 0), F.get("q_ids", 0)))
            self.add(pairs.mapInArrow(frugal(_meet(self.percent)), "a long, b long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per document row: id, set size, the least id reachable by links, and whether the row's document is that one."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with Scratch(spark) as scratch, arrow_batches(spark, TEXT_ROWS):
        signs = scratch.table(source.mapInArrow(frugal(_sign(shingle)), SIGN_SCHEMA))
        classes = signs.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
        classes = scratch.table(classes)
        held = signs.where("n_shingles > 0").join(classes.withColumnRenamed("rep", "doc_id"), ["set_a", "set_b", "doc_id"], "left_semi")
        reps = scratch.table(held.select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "agree"))
        spread = reps.select("rep", F.explode("bands").alias("key"))
        shared = spread.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.min_by("rep", F.xxhash64("rep", "key")).alias("some")).where("least < most")
        members = scratch.table(spread.join(sized(scratch.table(shared.select("key", "least", "some"))), "key"))
        linker = _Linker(scratch, source, reps, shingle, percent)
        linker.confirm(members.where("rep > least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
        centred = linker.placed(linker.placed(members), "some", "of")
        linker.confirm(centred.where("component <> of").select(F.col("rep").alias("a"), F.col("some").alias("b")))
        parts = linker.placed(members.select("key", "rep"))
        counts = parts.groupBy("key", "component").agg(F.count("*").cast("double").alias("n"))
        counts = counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq")).where("n * n > sq")
        left = counts.select("key", ((F.col("n") * F.col("n") - F.col("sq")) / 2 > PAIRS_A_MEMBER * F.col("n")).alias("crowded"))
        unconnected = settled(parts.join(left, "key"))
        few = unconnected.where("not crowded")
        other = few.select("key", F.col("rep").alias("b"), F.col("component").alias("of"))
        linker.confirm(few.join(other, "key").where("component < of").select(F.col("rep").alias("a"), "b"))
        crowd = unconnected.where("crowded").select("key", "rep")
        if not crowd.isEmpty():
            linker.confirm_in_blocks(linker.placed(crowd))
        whole = signs.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
        placed = linker.placed(whole.withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep"))))
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        result = placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
        return settled(result)
