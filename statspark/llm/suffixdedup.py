"""Exact removal of repeated byte strings by a column-wise suffix construction over anchored segments.

Wanted: every byte covered by a ``length``-byte string that also starts
elsewhere; and, beside it, the passages a document shares with other documents.
A column-wise construction over whole documents takes as many sequential passes
as the longest document has bytes, so the collection is cut down first:

1. Anchors. In every window of ``length`` bytes the leftmost least hash of its
   ``gram``-byte strings is an anchor. Equal windows have the same anchor at the
   same place, so repeats only touch anchors whose gram occurs twice. A first
   scan counts the grams; a second keeps the anchors of those that repeat.
2. Segments. The segment of an anchor reaches ``length - gram`` bytes to either side of
   its gram, and so holds all windows with the gram in them. Anchors with equal
   segments need no more; of unlike segments around one gram, one of each kind is compared.
3. Columns. The segments of a gram are a collection of aligned strings. Their
   suffixes are built from the right, one symbol of each segment a round: the
   column of symbols is the Burrows-Wheeler transform read in the order of the
   suffixes before it; a stable counting sort by symbol gives the next order,
   and the common prefix of new neighbours is one more than the least over the
   old neighbours between them. The columns of the gram itself are equal and
   are inserted at once. Where a suffix at distance l before the gram shares
   ``length`` symbols with a neighbour, the window there is repeated; where a run of
   such neighbours has two documents, it is shared.
4. Cover. Each anchor's distances cover bytes of its document; their union counts.

Passages: the bytes covered by ``length``-byte strings that another document
has too; for documents without one, the runs of at least ``words`` words covered
by ``passage``-byte strings that another document has too. For these the steps
run again with the shorter length, over the anchors whose gram stands in such a document.

A gram with more than ``block`` unlike segments is not compared in one task, but
split to cells by more of the bytes around it (see ``_ranges``), which are then
compared column-wise in the same way, in work linear in the segments.

Segments are told equal by a 128-bit hash of their bytes within a 64-bit hash of
their gram; windows in a column comparison are compared symbol by symbol, grams byte by byte.

Defined cases: null is the empty text; texts under ``length`` bytes keep all;
repeated rows are separate documents, so both lose what they share (where ids are
null or repeated, rows of equal id and text count as one document for passages);
a null id is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, frugal, merged_runs, pieces, settled, sized
from .textkit import U64, byte_values, powers, signed, slices, text_bytes

LENGTH, GRAM = 400, 128
#: Bytes and words that a shared passage has at least; its grams.
PASSAGE, WORDS, PASSAGE_GRAM = 240, 50, 64
#: Segments up to which a cell is compared in one task.
BLOCK = 4_000
#: Grams (16 bytes each) and list entries (40 bytes each) up to which a table is sent to every executor.
GRAMS, CELLS = 2_000_000, 1_500_000
ABSENT = 256
#: Hashes of a span that are looked at for its least one, on average.
LOW = 8
#: Bytes of freed memory a Python worker keeps for the next arrays.
HELD = 8 << 20
_BYTES = byte_values(97)
_TOP = U64(0xFFFFFFFFFF000000)
_PLACE_LIMIT = 1 << 24


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams, in few arrays, as their making takes most of a scan."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    body = sums[1:]
    np.take(_BYTES, data, out=body, mode="clip")
    body *= up[: len(data)]
    np.cumsum(body, out=body)
    count = max(0, len(data) - gram + 1)
    hashes = sums[gram:] - sums[:count]
    hashes *= down[:count]
    hashes ^= hashes >> U64(32)
    hashes *= U64(0x94D049BB133111EB)
    hashes ^= hashes >> U64(29)
    return hashes


def _low_places(hashes: np.ndarray, span: int) -> np.ndarray:
    """Places of the hashes under a bound, and all places of a stretch of ``span`` or more without one: they hold the least of every span."""
    bound = U64(min(LOW * ((1 << 64) // span), (1 << 64) - 1)) & _TOP
    place = np.flatnonzero(hashes < bound)
    edges = np.concatenate([[-1], place, [len(hashes)]])
    far = np.flatnonzero(np.diff(edges) > span)
    if not len(far):
        return place
    return np.sort(np.concatenate([place, *(np.arange(edges[i] + 1, edges[i + 1]) for i in far.tolist())]))


def _least_of_places(hashes: np.ndarray, place: np.ndarray, offsets: np.ndarray, window: int, span: int) -> np.ndarray:
    """Keys that are the least of a span, from the low places alone.

    Spans that begin behind a place, end at one or begin a text hold all sets of places there are.
    """
    n, key = len(place), (hashes[place] & _TOP) | place.astype(U64)
    last = offsets[1:] - window
    firsts = offsets[:-1][last >= offsets[:-1]]
    begin = np.concatenate([place + 1, place - span + 1, firsts])
    low = np.concatenate([np.arange(1, n + 1), np.searchsorted(place, place - span + 1), np.searchsorted(place, firsts)])
    high = np.concatenate([np.searchsorted(place, place + span + 1), np.arange(1, n + 1), np.searchsorted(place, firsts + span)]) - 1
    inside = (begin >= 0) & (begin <= np.append(last, -1)[np.searchsorted(offsets, begin, side="right") - 1])
    low, high = low[inside], high[inside]
    return _least_between(key, low, high, n)


def _least_of_all(hashes: np.ndarray, offsets: np.ndarray, window: int, span: int) -> np.ndarray:
    """Keys that are the least of a span, from every place."""
    count = len(hashes)
    key = (hashes & _TOP) | np.arange(count, dtype=U64)
    table = np.concatenate([key, np.full(-count % span, ~U64(0))]).reshape(-1, span)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = count - span + 1
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    inside = np.zeros(windows + 1, np.int64)
    first, last = offsets[:-1], offsets[1:] - window + 1
    holds = last > first
    np.add.at(inside, first[holds], 1)
    np.add.at(inside, last[holds], -1)
    least = least[np.cumsum(inside[:-1]) > 0]
    change = np.ones(len(least), bool)
    change[1:] = least[1:] != least[:-1]
    return least[change]


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions and hashes of their grams."""
    if not (np.diff(offsets) >= window).any():
        return np.zeros(0, np.int64), np.zeros(0, U64)
    hashes, span = _gram_hashes(data, gram), window - gram + 1
    place = _low_places(hashes, span)
    few = 4 * len(place) <= len(hashes)
    least = _least_of_places(hashes, place, offsets, window, span) if few else _least_of_all(hashes, offsets, window, span)
    at = np.unique((least & U64(_PLACE_LIMIT - 1)).astype(np.int64))
    return at, hashes[at]


def segment_hashes(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, of: np.ndarray, length: int, gram: int) -> list[bytes]:
    """Hashes of the bytes around each anchor (clipped at the text's ends) and of the anchor's place among them."""
    low, high = np.maximum(at - (length - gram), offsets[of]), np.minimum(at + length, offsets[of + 1])
    raw = memoryview(np.ascontiguousarray(data))
    return [xxhash.xxh3_128_digest(raw[a:b], c) for a, b, c in zip(low.tolist(), high.tolist(), (at - low).tolist(), strict=True)]


ANCHOR_SCHEMA = "uid long, pos int, gram long, segment binary"


def _parts(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Row ranges with their byte ranges, and the range whose anchors count; a text beyond the place limit comes in overlapping parts."""
    for a, b in slices(offsets):
        low, high = int(offsets[a]), int(offsets[b])
        if high - low <= _PLACE_LIMIT:
            yield a, b, low, high, low, high
        else:
            step = _PLACE_LIMIT - 4 * length
            for at in range(low, high, step):
                yield a, b, max(low, at - 2 * length), min(high, at + step + 2 * length), at, min(high, at + step)


def _anchored(column: pa.Array, length: int, gram: int) -> Iterator[tuple]:
    """Of each part of a batch: bytes, offsets, anchors, their grams and texts, the first text's row, and where each text begins."""
    data, offsets = text_bytes(column)
    for a, b, low, high, first, last in _parts(offsets, length):
        local = np.clip(offsets[a : b + 1] - low, 0, high - low)
        at, grams = anchors(data[low:high], local, length, gram)
        mine = (at >= first - low) & (at < last - low)
        at, grams = at[mine], grams[mine]
        yield data[low:high], local, at, grams, np.searchsorted(local, at, side="right") - 1, a, offsets[a : b + 1] - low


def _find_grams(forms: tuple[tuple[int, int, bool], ...]):
    """The distinct grams of each text's anchors, or all of them, for each form (length, gram, whether distinct)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                for form, (length, gram, distinct) in enumerate(forms):
                    for _, _, _, grams, of, _, _ in _anchored(batch.column("text"), length, gram):
                        if distinct and len(grams):
                            by = np.lexsort((grams, of))
                            new = np.ones(len(by), bool)
                            new[1:] = (np.diff(of[by]) != 0) | (grams[by][1:] != grams[by][:-1])
                            grams = grams[by][new]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), form, np.int32)), pa.array(signed(grams))], ["form", "gram"])

    return run


def _find_anchors(length: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                for data, local, at, grams, of, a, starts in _anchored(batch.column("text"), length, gram):
                    segments = segment_hashes(data, local, at, of, length, gram)
                    place = at - starts[of]
                    yield pa.RecordBatch.from_arrays([batch.column("uid").take(pa.array(a + of)), pa.array(place.astype(np.int32)), pa.array(signed(grams)), pa.array(segments, pa.binary())], ["uid", "pos", "gram", "segment"])

    return run


#: ``single``: the segment occurs once; ``doc``: the document that alone holds it, null where there are several.
SEGMENT_SCHEMA = "gram long, segment binary, single boolean, doc long, at int, bytes binary"
_SEGMENT_FIELDS = ["gram", "segment", "single", "doc", "at", "bytes"]


def _cut_segments(length: int, gram: int):
    """The bytes of each wanted segment, and where its gram begins."""
    reach = length - gram

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, wanted in zip(batch.column("text").cast(pa.large_binary()), batch.column("wanted"), strict=True):
                raw = memoryview(text.as_buffer() if text.is_valid else b"")
                for w in wanted.as_py():
                    p = w["pos"]
                    low = max(0, p - reach)
                    rows.append((w["gram"], w["segment"], w["single"], w["doc"], p - low, bytes(raw[low : p + length])))
                if len(rows) > 20_000:
                    yield _segment_batch(rows)
                    rows = []
            if rows:
                yield _segment_batch(rows)

    return run


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _SEGMENT_FIELDS)


def _symbols(parts: list[bytes], reach: int, right_aligned: bool) -> np.ndarray:
    """Columns of symbols; places beyond a text's end are absent."""
    out = np.full((len(parts), reach), ABSENT, np.int16)
    for i, part in enumerate(parts):
        if part:
            raw = np.frombuffer(part, np.uint8)
            if right_aligned:
                out[i, reach - len(raw) :] = raw
            else:
                out[i, : len(raw)] = raw
    return np.ascontiguousarray(out.T)


def _least_between(common: np.ndarray, low: np.ndarray, high: np.ndarray, longest: int) -> np.ndarray:
    """Least of common[low..high] for each pair, by a table of powers of two."""
    size = high - low + 1
    longest = min(longest, int(size.max(initial=1)))
    out = common[low].copy()
    table, step = common, 1
    while step * 2 <= longest:
        nxt = table.copy()
        nxt[: len(table) - step] = np.minimum(table[: len(table) - step], table[step:])
        table, step = nxt, step * 2
        here = (size >= step) & (size < step * 2)
        out[here] = np.minimum(table[low[here]], table[high[here] - step + 1])
    return out


def repeated_distances(groups: np.ndarray, docs: np.ndarray, left: np.ndarray, right: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each aligned segment (grouped, in order) the distances before the gram whose window has an equal in its group.

    ``left`` and ``right`` are columns x segments. The first array (distances x segments) is of
    windows that occur twice; the second of those that two documents have
    (``docs``: a number a document, -1 for several).
    """
    n, reach = len(groups), length - gram
    order = np.arange(n)
    # common[i]: symbols shared by the suffixes at places i - 1 and i of the order; -1 between groups
    border = np.ones(n, bool)
    border[1:] = groups[1:] != groups[:-1]
    common = np.where(border, -1, 0).astype(np.int32)
    starts = np.flatnonzero(border)
    longest = int(np.diff(np.append(starts, n)).max(initial=1))
    rank = np.cumsum(border).astype(np.int64)
    repeated, shared = np.zeros((reach + 1, n), bool), np.zeros((reach + 1, n), bool)

    def insert(column: np.ndarray) -> None:
        nonlocal order, common
        symbols = column[order].astype(np.int64)
        place = np.argsort(rank * 512 + symbols, kind="stable")  # groups keep their places, so ranks stay in order
        chosen = symbols[place]
        fresh = np.where(border, -1, 0).astype(np.int32)
        same = np.zeros(n, bool)
        same[1:] = ~border[1:] & (chosen[1:] == chosen[:-1]) & (chosen[1:] != ABSENT)
        at = np.flatnonzero(same)
        if len(at):
            fresh[at] = 1 + _least_between(common, place[at - 1] + 1, place[at], longest)
        order, common = order[place], fresh

    def note(distance: int) -> None:
        heads = np.flatnonzero(common < length)
        sizes = np.diff(np.append(heads, n))
        those = docs[order]
        least, most = np.minimum.reduceat(those, heads), np.maximum.reduceat(those, heads)
        repeated[distance, order] = np.repeat(sizes > 1, sizes)
        shared[distance, order] = np.repeat((sizes > 1) & ((least != most) | (least < 0)), sizes)

    for k in reversed(range(reach)):
        insert(right[k])
    common = np.where(border, -1, common + gram).astype(np.int32)
    note(0)
    for distance in range(1, reach + 1):
        insert(left[reach - distance])
        note(distance)
    return repeated, shared


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


#: Distances low to high of a segment; what: 0 for repeated windows, 1 for shared ones, 2 for both.
RANGE_SCHEMA = "gram long, segment binary, low int, high int, what int"


def _range_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["gram", "segment", "low", "high", "what"])


#: A cell: segments of one gram that share all bytes which the windows at distances ``low`` to ``high`` have in common.
CELL_SCHEMA = SEGMENT_SCHEMA + ", low int, high int, cell long"
_CELL = ["low", "high", "cell"]
_CELL_FIELDS = [*_SEGMENT_FIELDS, *_CELL]


def _cell_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _CELL_FIELDS)


def _halve(length: int):
    """The two cells of each segment of a crowded cell: the nearer and the farther half of its distances."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for g, s, single, doc, at, raw, low, high, _ in zip(*(batch.column(n).to_pylist() for n in _CELL_FIELDS), strict=True):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    if at >= a and at - b + length <= len(raw):
                        start = max(0, at - b)
                        cell = xxhash.xxh3_64_intdigest(raw[at - a : at - b + length], a)
                        rows.append((g, s, single, doc, at - start, raw[start : at - a + length], a, b, cell - (cell >> 63 << 64)))
            if rows:
                yield _cell_batch(rows)

    return run


def _compare(length: int, block: int):
    """Column-wise comparison of segments sorted by cell, in blocks of whole cells of the same distances."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        low, high = rows[0][6:8]
        reach = high - low
        core = length - reach
        cores = [r[5][r[4] - low : r[4] - low + core] for r in rows]
        number = {c: i for i, c in enumerate(sorted(set(cores)))}
        groups = np.array([number[c] for c in cores], np.int64)
        by = np.argsort(groups, kind="stable")
        rows, groups = [rows[i] for i in by.tolist()], groups[by]
        docs = np.unique(np.array([r[3] if r[3] is not None else 0 for r in rows], np.int64), return_inverse=True)[1].astype(np.int64)
        docs[np.array([r[3] is None for r in rows], bool)] = -1
        left, right = [r[5][: r[4] - low] for r in rows], [r[5][r[4] - low + core :] for r in rows]
        flags = repeated_distances(groups, docs, _symbols(left, reach, True), _symbols(right, reach, False), core, length)
        out = []
        for what, (found, wanted) in enumerate(zip(flags, ([r[2] for r in rows], [r[3] is not None for r in rows]), strict=True)):
            some = found.any(axis=0)
            out += [(r[0], r[1], low + a, low + b, what) for i, r in enumerate(rows) if some[i] and wanted[i] for a, b in _spans(found[:, i])]
        return _range_batch(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in _CELL_FIELDS), strict=True):
                if held and (row[6:8] != held[-1][6:8] or len(held) >= block and row[8] != held[-1][8]):
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def _equal_windows(cells: DataFrame) -> DataFrame:
    """Ranges of crowded cells of one distance: their members share a whole window, so counts tell all."""
    windows = cells.select("gram", "segment", "single", "doc", F.col("low").alias("distance"), F.sha2("bytes", 256).alias("window"))
    counted = windows.groupBy("gram", "distance", "window").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("doc").alias("known")).where("n > 1")
    counted = settled(counted.select("gram", "distance", "window", ((F.col("known") < F.col("n")) | (F.col("a") != F.col("b"))).alias("across")))
    again = windows.join(sized(counted), ["gram", "distance", "window"])
    what = F.array(F.when(F.col("single"), 0), F.when(F.col("across") & F.col("doc").isNotNull(), 1))
    return again.select("gram", "segment", F.col("distance").alias("low"), F.col("distance").alias("high"), F.explode(what).alias("what")).where("what is not null")


def _joined_ranges(ranges: DataFrame) -> DataFrame:
    """The ranges of each segment, those that touch across cells as one."""
    # merged_runs starts from 0 and takes ends that are not included, so starts move up by one and ends by two
    run = F.struct((F.col("low") + 1).alias("s"), (F.col("high") + 2).alias("e"))
    runs = ranges.groupBy("gram", "segment", "what").agg(merged_runs(F.array_sort(F.collect_list(run))).alias("runs"))
    return runs.select("gram", "segment", F.inline(F.transform("runs", lambda r: F.struct((r["s"] - 1).alias("low"), (r["e"] - 2).alias("high")))), "what")


def _ranges(scratch: Scratch, segments: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """Column-wise comparison of all segments of each gram.

    Cells of more than ``block`` segments are halved by distance: windows at the far
    half share more bytes before the gram, those at the near half more after it, so
    either half falls apart by these bytes. That ends after as many rounds as the distances can be halved.
    """
    cells = segments.select("*", F.lit(0).alias("low"), F.lit(length - gram).alias("high"), F.col("gram").alias("cell"))
    found = []
    while True:
        crowded = settled(cells.groupBy(*_CELL).count().where(F.col("count") > block).select(*_CELL))
        last = crowded.isEmpty()
        usual = cells if last else cells.join(sized(crowded), _CELL, "left_anti")
        found.append(usual.select(*_CELL_FIELDS).repartition(*_CELL).sortWithinPartitions(*_CELL, "segment").mapInArrow(frugal(_compare(length, block), HELD), RANGE_SCHEMA))
        if last:
            return found[0] if len(found) == 1 else found[0].unionByName(_joined_ranges(reduce(DataFrame.unionByName, found[1:])))
        rest = cells.join(sized(crowded), _CELL, "left_semi").select(*_CELL_FIELDS)
        found.append(_equal_windows(rest.where("low = high")))
        cells = scratch.table(rest.where("low < high").mapInArrow(frugal(_halve(length), HELD), CELL_SCHEMA))


RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long"


def _covered(size: int, runs: list[dict] | None) -> np.ndarray:
    mask = np.zeros(size + 1, np.int64)
    for c in runs or ():
        mask[min(size, c["s"])] += 1
        mask[min(size, c["e"])] -= 1
    return np.cumsum(mask[:-1]) > 0


def _remove(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, offsets = text_bytes(batch.column("text"))
                columns: list[list] = [[] for _ in range(7)]
                for i, (cover, shared, short) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("cover", "shared", "short")), strict=True)):
                    raw = data[offsets[i] : offsets[i + 1]]
                    gone = _covered(len(raw), cover)
                    runs = _spans(_covered(len(raw), shared or short))
                    if not shared:
                        runs = [(a, b) for a, b in runs if len(raw[a : b + 1].tobytes().split()) >= words]
                    kept = raw[~gone].tobytes()
                    made = (len(raw), int(gone.sum()), len(_spans(gone)), hashlib.sha256(kept).hexdigest(), len(runs), sum(b - a + 1 for a, b in runs), kept)
                    for column, value in zip(columns, made, strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes", "kept"])

    return run


def _anchors_of(scratch: Scratch, source: DataFrame, several: DataFrame, length: int, gram: int) -> DataFrame:
    """The anchors whose gram is a given one."""
    found = source.select("uid", "text").mapInArrow(frugal(_find_anchors(length, gram), HELD), ANCHOR_SCHEMA)
    return scratch.table(found.join(sized(several, GRAMS), "gram", "left_semi").select("uid", "pos", "gram", "segment"))


def _covers(scratch: Scratch, source: DataFrame, repeated: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """Per document with repeats: runs covered by repeated strings (``cover``) and by those another document has (``shared``)."""
    reach = length - gram
    kinds = repeated.groupBy("gram", "segment").agg(F.count("*").alias("n"), F.min(F.struct("uid", "pos")).alias("at"), F.max("uid").alias("last"))
    kinds = scratch.table(kinds.select("gram", "segment", (F.col("n") == 1).alias("single"), "at.pos", "at.uid", F.when(F.col("at.uid") == F.col("last"), F.col("last")).alias("doc")))
    unlike = scratch.table(kinds.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram"))
    mixed = kinds.join(sized(unlike, GRAMS), "gram", "left_semi")
    wanted = scratch.table(mixed.groupBy("uid").agg(F.collect_list(F.struct("pos", "gram", "segment", "single", "doc")).alias("wanted")))
    segments = scratch.table(source.select("uid", "text").join(sized(wanted, CELLS, F.size("wanted")), "uid").select("text", "wanted").mapInArrow(frugal(_cut_segments(length, gram), HELD), SEGMENT_SCHEMA))
    ranges = _ranges(scratch, segments, length, gram, block)
    # Every occurrence of a segment that occurs twice is covered whole; one of several documents is shared whole.
    whole = kinds.where(~F.col("single")).select("gram", "segment", F.lit(0).alias("low"), F.lit(reach).alias("high"), F.when(F.col("doc").isNull(), 2).otherwise(0).alias("what"))
    ranges = scratch.table(whole.unionByName(ranges))
    run = F.struct(F.greatest(F.col("pos") - F.col("high"), F.lit(0)).alias("s"), (F.col("pos") - F.col("low") + length).alias("e"))

    def merged(on: Column) -> Column:
        return merged_runs(F.array_sort(F.collect_list(F.when(on, run))))

    cover = repeated.join(ranges, ["gram", "segment"]).groupBy("uid")
    return scratch.table(cover.agg(merged(F.col("what") != 1).alias("cover"), merged(F.col("what") != 0).alias("shared")))


def remove_repeats(
    spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE, words: int = WORDS, passage_gram: int = PASSAGE_GRAM, block: int = BLOCK, keep_text: bool = False
) -> DataFrame:
    """Per document row: id, bytes, removed bytes, removed runs, hash of the rest (and the rest itself if wanted), shared passages and their bytes.

    A document is told by its id where ids are unique and present, else by a 64-bit hash of id and text.
    """
    ids = docs.select(F.col(key).cast("long").alias("doc_id"))
    unique = ids.where("doc_id is null").isEmpty() and ids.groupBy("doc_id").count().where("count > 1").isEmpty()
    uid = F.col("doc_id") if unique else F.xxhash64("doc_id", "text")
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).select(uid.alias("uid"), "doc_id", "text")
    forms, grams_schema = ((length, gram, False), (passage, passage_gram, True)), "form int, gram long"
    with Scratch(spark) as scratch, arrow_batches(spark, 1000):
        grams = source.select("text").mapInArrow(frugal(_find_grams(forms), HELD), grams_schema)
        several = scratch.table(grams.groupBy("form", "gram").agg(F.count("*").alias("n")).where("n > 1").select("form", "gram"))
        cover = _covers(scratch, source, _anchors_of(scratch, source, several.where("form = 0").select("gram"), length, gram), length, gram, block)
        known = sized(cover.where(F.size("shared") > 0).select("uid"))
        near = _anchors_of(scratch, source, several.where("form = 1").select("gram"), passage, passage_gram)
        candidates = scratch.table(near.join(known, "uid", "left_anti").select("gram").distinct())
        near = scratch.table(near.join(sized(candidates, GRAMS), "gram", "left_semi"))
        short = _covers(scratch, source, near, passage, passage_gram, block).where(F.size("shared") > 0).select("uid", F.col("shared").alias("short"))
        cover = scratch.table(cover.join(short, "uid", "full"))
        joined = source.join(sized(cover, CELLS, sum(F.coalesce(F.size(c), F.lit(0)) for c in ("cover", "shared", "short"))), "uid", "left").select("doc_id", "text", "cover", "shared", "short")
        result = joined.mapInArrow(frugal(_remove(words), HELD), RESULT_SCHEMA + ", kept binary")
        return settled(result if keep_text else result.drop("kept"))
