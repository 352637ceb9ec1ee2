"""Packing of tokenised documents into fixed windows: bounded-space online best fit.

Every partition keeps ``open_windows`` windows open. A document of more than a
window is cut into full windows and a rest; a rest goes to the open window that
it fills best. When none has room, the fullest one is topped up with the head of
the document, emitted, and the tail placed again. What is left open at the end
of a partition is joined end to end; the last short window of each of ``merge``
neighbouring partitions is merged with the others in a second, small step. The
last rest of a merge group is cut at powers of two, which need no padding.

Tokens are never shuffled but for those last short windows (one a partition).
The pieces of the first step are written to the shared folder, so a lost
executor costs its running tasks only.

Defined cases: a null or empty text is one piece holding only the end id; very
long texts are cut, never shortened; repeated rows are packed once for each row;
a null id is kept; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, frugal, pieces, settled
from .textkit import LOWER, U64, byte_values, prefix_hash, slices, span_hash, text_bytes, word_spans

WINDOW = 4096
OPEN_WINDOWS = 64
MERGE_PARTITIONS = 64
END_ID = 2
#: Bytes of freed memory a Python worker keeps for the next arrays.
HELD = 8 << 20
#: Entries of the word table of one Python worker (about 75 bytes each).
CACHE_WORDS = 500_000
#: Texts of one Arrow batch.
TEXT_ROWS = 1000

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, merge_group long"


def _marks() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank, letter, mark = (np.zeros(256, bool) for _ in range(3))
    blank[[9, 10, 13, 32]] = True
    letter[65:91] = letter[97:123] = True
    mark[list(b".,;:!?")] = True
    return blank, letter, mark


_BLANK, _LETTER, _MARK = _marks()
_BYTES = byte_values(59)


@lru_cache(maxsize=1)
def _loaded(path: str):
    """The tokenizer, read once by each Python worker, without threads of its own, as every core has a worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTokenizer:
    """Exact ids of a word tokenizer, from a table of words by hash.

    Blanks never lie inside a token of this vocabulary and are dropped, so the
    ids of a text are those of its blank-separated words in order. A plain word
    (Latin letters, with at most one mark after them) is its letters, then its
    mark. ASCII letters are lower-cased by the tokenizer itself, so words that differ in
    their case only share an entry. Words are found in a slice, hashed (64 bits,
    length included) and looked up as arrays; only unseen ones are encoded,
    plain ones many in a call, as each ends in a token that closes a word. The
    table is open, half full at most, and takes unseen words without moving others. Texts
    with the opening of a special token are encoded whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        self.tokenizer = _loaded(path)
        self.limit = cache_words
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.held = 0
        self._lay(1 << 12)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _lay(self, size: int) -> None:
        """An empty table; a key of 0 is a free slot."""
        self.keys, self.starts, self.counts = np.zeros(size, U64), np.zeros(size, np.int64), np.zeros(size, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free one where it would stand."""
        slot = self._home(keys)
        found = self.keys[slot]
        off = np.flatnonzero((found != keys) & (found != 0))
        while len(off):
            slot[off] = (slot[off] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[off]]
            off = off[(found != keys[off]) & (found != 0)]
        return slot

    def _insert(self, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """Enter distinct keys that the table does not hold."""
        size = len(self.keys)
        while 2 * (self.held + len(keys)) > size:
            size *= 2
        if size > len(self.keys):
            old = np.flatnonzero(self.keys)
            keys, starts, counts = (np.concatenate([x[old], y]) for x, y in ((self.keys, keys), (self.starts, starts), (self.counts, counts)))
            self._lay(size)
            self.held = 0
        self.held += len(keys)
        slot, left = self._home(keys), np.arange(len(keys))
        while len(left):
            at, mine = slot[left], keys[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = mine[free]
            won = self.keys[at] == mine  # of several keys for a slot one stands there now
            self.starts[at[won]], self.counts[at[won]] = starts[left[won]], counts[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words end to end, and their counts."""
        ids, counts = [], []
        lots = [words[at : at + 256] for at in range(0, len(words), 256)]
        for some, encoded in zip(lots, self.tokenizer.encode_batch_fast([" ".join(some) for some in lots], add_special_tokens=False), strict=True):
            found = np.array(encoded.ids, np.uint32)
            ends = np.flatnonzero(self.closes[found]) + 1
            if len(ends) == len(some):
                ids.append(found)
                counts.append(np.diff(ends, prepend=0))
            else:
                each = [self._ids(w) for w in some]
                ids.extend(each)
                counts.append(np.array([len(x) for x in each]))
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _learn(self, hashes: np.ndarray, words: list[str], plain: np.ndarray) -> None:
        first = np.flatnonzero(plain)
        rest = np.flatnonzero(~plain)
        ids, counts = self._encode_plain([words[i] for i in first])
        others = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)] if len(rest) else []
        whole = np.concatenate([ids, *others]) if others else ids
        counts = np.concatenate([counts, [len(x) for x in others]]).astype(np.int64)
        while self.used + len(whole) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(whole)] = whole
        starts = self.used + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.used += len(whole)
        self._insert(hashes[np.concatenate([first, rest])], starts, counts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a byte array end to end, and their offsets."""
        if self.held > self.limit:
            self._clear()
        low = LOWER[data]
        starts, ends = word_spans(low, offsets, ~_BLANK)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        lead = low == 0xC3
        letter = _LETTER[low] | lead
        tail = np.zeros(len(low), bool)
        tail[1:] = lead[:-1] & (low[1:] >= 0x80) & (low[1:] < 0xC0) & (low[1:] != 0x97) & (low[1:] != 0xB7)
        letters = np.concatenate([[0], np.cumsum(letter | tail)])
        inside, size = letters[ends] - letters[starts], ends - starts
        marked = (inside == size - 1) & (size > 1) & _MARK[low[ends - 1]]
        # Parts: the word without its mark, then the mark.
        place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(marked)[:-1]])
        total = len(starts) + int(marked.sum())
        part_start, part_end, plain = np.empty(total, np.int64), np.empty(total, np.int64), np.zeros(total, bool)
        part_start[place], part_end[place] = starts, ends - marked
        plain[place] = (inside == size) | marked
        part_start[place[marked] + 1], part_end[place[marked] + 1] = ends[marked] - 1, ends[marked]
        key = np.maximum(span_hash(prefix_hash(_BYTES[low]), part_start, part_end), U64(1))
        slot = self._slots(key)
        unseen = np.flatnonzero(self.keys[slot] != key)
        if len(unseen):
            distinct, first = np.unique(key[unseen], return_index=True)
            new = unseen[first]
            raw = low.tobytes()
            words = [raw[i:j].decode("utf-8") for i, j in zip(part_start[new].tolist(), part_end[new].tolist(), strict=True)]
            size = len(self.keys)
            self._learn(distinct, words, plain[new])
            if len(self.keys) == size:
                slot[unseen] = self._slots(key[unseen])
            else:
                slot = self._slots(key)
        counts, source = self.counts[slot].astype(np.int64), self.starts[slot]
        upto = np.cumsum(counts)
        ids = self.pool[np.arange(int(upto[-1])) + np.repeat(source - upto + counts, counts)]
        bounds = np.searchsorted(part_start, offsets)
        return ids, np.concatenate([[0], upto])[bounds]

    def encode_texts(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text of a column."""
        data, offsets = text_bytes(texts)
        out: list[bytes] = []
        for a, b in slices(offsets):
            piece = data[offsets[a] : offsets[b]]
            ids, at = self.encode(piece, offsets[a : b + 1] - offsets[a])
            raw = ids.astype("<u4", copy=False).tobytes()
            found = [raw[4 * i : 4 * j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            if b"<|" in piece.tobytes():
                for row in range(a, b):
                    text = data[offsets[row] : offsets[row + 1]].tobytes()
                    if b"<|" in text:
                        found[row - a] = self._ids(text.decode("utf-8")).astype("<u4").tobytes()
            out.extend(found)
        return out


class _Packer:
    def __init__(self, first_sequence: int, window: int, open_windows: int) -> None:
        self.next, self.window, self.most = first_sequence, window, open_windows
        self.rooms: list[tuple[int, int]] = []  # (free ids, window) in order
        self.held: dict[int, list[tuple]] = {}

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, doc_id, ids: bytes) -> Iterator[tuple]:
        """Finished pieces: (doc_id, start, ids, doc_tokens, sequence, offset)."""
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            yield doc_id, at, ids[4 * at : 4 * (at + self.window)], total, self._new(), 0
            at += self.window
        while at < total:
            need = total - at
            k = bisect.bisect_left(self.rooms, (need, -1))
            if k == len(self.rooms) and len(self.rooms) < self.most:
                window = self._new()
                self.held[window] = []
                room, take = self.window, need
            elif k == len(self.rooms):  # none fits: top up the fullest
                room, window = self.rooms.pop(0)
                take = room
            else:
                room, window = self.rooms.pop(k)
                take = need
            self.held[window].append((doc_id, at, ids[4 * at : 4 * (at + take)], total, window, self.window - room))
            at += take
            if room == take:
                yield from self.held.pop(window)
            else:
                bisect.insort(self.rooms, (room - take, window))

    def rest(self) -> list[tuple]:
        """The pieces still open, fullest window first."""
        return [p for _, w in self.rooms for p in self.held[w]]


def _cut(parts: Iterable[tuple], lengths: Iterator[int], sequence: Iterator[int]) -> Iterator[tuple]:
    """Lay pieces end to end into windows of the given lengths."""
    room = offset = 0
    window = 0
    for doc_id, start, ids, total, *_ in parts:
        at, n = 0, len(ids) // 4
        while at < n:
            if not room:
                room, offset, window = next(lengths), 0, next(sequence)
            take = min(room, n - at)
            yield doc_id, start + at, ids[4 * at : 4 * (at + take)], total, window, offset
            at, room, offset = at + take, room - take, offset + take


def _lengths(total: int, window: int) -> Iterator[int]:
    """Full windows, then the powers of two that make up the rest."""
    for _ in range(total // window):
        yield window
    rest = total % window
    for bit in reversed(range(window.bit_length())):
        if rest >> bit & 1:
            yield 1 << bit


def _batch(rows: list[tuple], group: int | None) -> pa.RecordBatch:
    """Finished rows (no group) carry no ids; rows to merge do."""
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([len(r[2]) // 4 for r in rows], pa.int64()),
            pa.array([zlib.crc32(r[2]) for r in rows], pa.int64()),
            pa.array([r[3] for r in rows], pa.int64()),
            pa.array([r[4] for r in rows], pa.int64()),
            pa.array([r[5] for r in rows], pa.int64()),
            pa.array([None] * n if group is None else [r[2] for r in rows], pa.binary()),
            pa.array([group] * n, pa.int64()),
        ],
        [x.split()[0] for x in PIECE_SCHEMA.split(", ")],
    )


def _count_from(first: int) -> Iterator[int]:
    while True:
        yield first
        first += 1


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, open_windows: int = OPEN_WINDOWS, merge: int = MERGE_PARTITIONS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: its document, place in the document, length, ids' crc32, sequence and offset."""
    end = np.array([end_id], "<u4").tobytes()

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        packer = _Packer(partition << 40, window, open_windows)
        tokenizer = WordTokenizer(tokenizer_path)
        for whole in batches:
            for batch in pieces(whole, "text"):
                done: list[tuple] = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encode_texts(batch.column("text")), strict=True):
                    done.extend(packer.place(doc_id, ids + end))
                if done:
                    yield _batch(done, None)
        rest = packer.rest()
        total = sum(len(p[2]) // 4 for p in rest)
        laid = list(_cut(rest, iter([window] * (total // window) + [total % window or window]), _count_from(packer.next)))
        last = laid[-1][4] if total % window else None
        if full := [p for p in laid if p[4] != last]:
            yield _batch(full, None)
        if short := [p for p in laid if p[4] == last and last is not None]:
            yield _batch(short, partition // merge)

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[tuple]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                groups.setdefault(r["merge_group"], []).append((r["doc_id"], r["start"], r["ids"], r["doc_tokens"], r["sequence_id"], r["offset"]))
        for group, parts in groups.items():
            parts.sort(key=lambda p: (p[4], p[5]))
            total = sum(len(p[2]) // 4 for p in parts)
            yield _batch(list(_cut(parts, _lengths(total, window), _count_from(-1 - ((group + 1) << 32)))), None)

    with Scratch(spark) as scratch, arrow_batches(spark, TEXT_ROWS):
        source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        laid = scratch.table(source.mapInArrow(frugal(first, HELD), PIECE_SCHEMA))
        short = laid.where("merge_group is not null").repartition("merge_group").mapInArrow(second, PIECE_SCHEMA)
        return settled(laid.where("merge_group is null").unionByName(short).drop("ids", "merge_group"))
