"""Repeated bytes and near duplicates against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from conftest import SF
from helpers import AWKWARD, closed, frame, shingles
from statspark.llm import minhash, queries, suffixdedup


def repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(4000)}" for _ in range(3000)]
    shared = [" ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randint(1, 40))))
        texts.append(" ".join(parts))
    return [*texts, texts[0], texts[1] + "x", "x" + texts[2], "ab" * 200, "ab" * 30, None, "", "\u00e9" * 90]


def shared_runs(raws, size):
    """Runs of each text covered by strings of a size that another text has too."""
    held = {}
    for k, raw in enumerate(raws):
        for i in range(len(raw) - size + 1):
            held.setdefault(raw[i : i + size], set()).add(k)
    for raw in raws:
        mask = np.zeros(len(raw) + 2, bool)
        for i in range(len(raw) - size + 1):
            if len(held[raw[i : i + size]]) > 1:
                mask[i + 1 : i + size + 1] = True
        edges = np.flatnonzero(np.diff(mask.astype(int)))
        yield list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def shared_passages(texts, length, passage, words):
    """Number and bytes of the long shared runs, else of the shorter ones with enough words."""
    raws = [(t or "").encode() for t in texts]
    out = []
    for raw, long, short in zip(raws, shared_runs(raws, length), shared_runs(raws, passage)):
        runs = long or [(a, b) for a, b in short if len(raw[a:b].split()) >= words]
        out.append((len(runs), sum(b - a for a, b in runs)))
    return out


@pytest.mark.parametrize(("gram", "block", "passage"), [(30, 4000, 45), (30, 2, 40), (50, 4000, 60), (10, 5, 25)])
def test_repeated_bytes_match_brute_force(spark, gram, block, passage):
    texts = passages(gram + block)
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = suffixdedup.remove_repeats(spark, frame(spark, rows).repartition(3), length=60, gram=gram, passage=passage, passage_gram=15, words=8, block=block, keep_text=True).collect()
    expected, shared = repeats(texts, 60), shared_passages(texts, 60, passage, 8)
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:5] == expected[r["doc_id"]], r["doc_id"]
        assert tuple(r)[5:7] == shared[r["doc_id"]], r["doc_id"]
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_a_crowded_window_among_unlike_segments(spark):
    """Cells that stay crowded down to a single distance."""
    rng = random.Random(11)

    def noise(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    common = noise(60)
    texts = [noise(rng.randint(0, 50)) + common + noise(rng.randint(0, 50)) for _ in range(14)] + [common[:59], common]
    got = suffixdedup.remove_repeats(spark, frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), length=60, gram=30, passage=45, passage_gram=15, words=8, block=2).collect()
    expected, shared = repeats(texts, 60), shared_passages(texts, 60, 45, 8)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: (*expected[i], *shared[i]) for i in range(len(texts))}


def test_awkward_rows_of_repeated_bytes(spark):
    got = suffixdedup.remove_repeats(spark, frame(spark, extra=True), length=40, gram=20, passage=30, passage_gram=15).collect()
    assert len(got) == len(AWKWARD)
    assert sum(r["n_removed"] == r["n_bytes"] > 0 for r in got) == 4  # the three equal rows, and one that repeats itself
    assert suffixdedup.remove_repeats(spark, frame(spark, []), length=40, gram=20, passage=30, passage_gram=15).count() == 0


def test_repeated_bytes_of_a_whole_table(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    texts = [r["text"] for r in docs]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op3_repeated_bytes(spark, SF).collect()}
    expected = {r["doc_id"]: (*a, *b) for r, a, b in zip(docs, repeats(texts, suffixdedup.LENGTH), shared_passages(texts, suffixdedup.LENGTH, suffixdedup.PASSAGE, suffixdedup.WORDS))}
    assert got == expected


def plain_anchors(data, offsets, window, gram):
    """The leftmost least gram hash of each window, window by window."""
    hashes = suffixdedup._gram_hashes(data, gram)
    at = set()
    for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        for i in range(first, last - window + 1):
            at.add(i + int(np.argmin(hashes[i : i + window - gram + 1] & suffixdedup._TOP)))
    return sorted(at)


@pytest.mark.parametrize(("window", "gram"), [(400, 128), (240, 64), (60, 30), (20, 20)])
def test_anchors_from_few_hashes_match_every_window(window, gram):
    rng = np.random.default_rng(window)
    for letters in (1, 2, 200):
        sizes = [0, window - 1, window, 0, 3000, 5, 1500, window + 1, 0]
        data = rng.integers(0, letters, sum(sizes)).astype(np.uint8)
        data[3000:3000 + 2 * window] = 7  # a stretch of equal hashes
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        at, grams = suffixdedup.anchors(data, offsets, window, gram)
        hashes = suffixdedup._gram_hashes(data, gram)
        assert at.tolist() == plain_anchors(data, offsets, window, gram) and (grams == hashes[at]).all()
    hashes = rng.integers(0, 1 << 63, 100_000).astype(np.uint64) * np.uint64(2)
    assert len(suffixdedup._low_places(hashes, 273)) < 5000  # of 100,000; every one was compared before
    none = suffixdedup.anchors(np.zeros(0, np.uint8), np.zeros(1, np.int64), window, gram)
    assert len(none[0]) == len(none[1]) == 0


def test_each_text_is_scanned_once_for_grams_and_once_a_form_for_anchors(spark, monkeypatch):
    scans = []
    for name in ("_find_grams", "_find_anchors"):
        def counted(*args, name=name, make=getattr(suffixdedup, name)):
            scans.append(name)
            return make(*args)

        monkeypatch.setattr(suffixdedup, name, counted)
    suffixdedup.remove_repeats(spark, frame(spark), length=40, gram=20, passage=30, passage_gram=15).count()
    assert sorted(scans) == ["_find_anchors", "_find_anchors", "_find_grams"]


def test_column_construction_alone():
    groups = np.array([0, 0, 0, 1, 1])
    docs = np.array([3, 4, -1, 7, 7])
    left = [b"xxab", b"yyab", b"zzzb", b"abcd", b"abcd"]
    right = [b"pqrs", b"pqzz", b"pqrs", b"wwww", b"wzzz"]
    columns = suffixdedup._symbols(left, 4, True), suffixdedup._symbols(right, 4, False)
    # distance d takes d bytes before the gram and 4 - d after it
    for found, own in zip(suffixdedup.repeated_distances(groups, docs, *columns, 6, 10), (False, True)):
        for d in range(5):
            keys = [(g, l[4 - d :], r[: 4 - d]) for g, l, r in zip(groups, left, right)]
            assert found[d].tolist() == [Counter(keys)[k] > 1 and not (own and k[0] == 1) for k in keys], d


def near(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c, i == c) for i, c in closed(sets, links).items()}


def crowd(seed, size):
    """Near copies of one text with edits of many sizes, others around them, and ties of the threshold."""
    rng = random.Random(seed)
    base = [f"t{rng.randrange(10_000)}" for _ in range(120)]
    texts = [(0, " ".join(base))]
    for i in range(1, size):
        copy = list(base)
        for _ in range(rng.randint(0, 18)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(50)}"
        texts.append((i, " ".join(copy)))
    texts += [(size + j, " ".join(f"o{rng.randrange(9)}" for _ in range(rng.randint(0, 6)))) for j in range(30)]
    at = size + 30
    texts += [(at, "a b c d e f"), (at + 1, "a b c d e"), (at + 2, "A B C D E"), (at + 3, None), (at + 4, ""), (at + 5, "solo"), (at + 6, "Solo")]
    return texts


@pytest.mark.parametrize(("k", "pairs", "one_task"), [(2, 4, 500_000), (2, 0, 0), (5, 0, 500_000)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, k, pairs, one_task):
    monkeypatch.setattr(minhash, "PAIRS_A_MEMBER", pairs)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    monkeypatch.setattr(minhash.components, "__defaults__", (one_task,))
    texts = crowd(k, 70)
    rows = [(i, t, None, None, None) for i, t in texts]
    got = minhash.near_duplicates(spark, frame(spark, rows).repartition(3), shingle=k, percent=80).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == near(texts, k, 80)


def test_awkward_rows_of_near_duplicates(spark):
    got = sorted(map(tuple, minhash.near_duplicates(spark, frame(spark, extra=True), shingle=2).collect()), key=str)
    assert len(got) == len(AWKWARD)
    assert [r[2:] for r in got if r[0] == 3] == [(3, True)] * 2
    assert [r[2:] for r in got if r[0] is None] == [(None, True)]
    assert [r[1:] for r in got if r[0] == 1] == [(0, 1, True)]
    assert minhash.near_duplicates(spark, frame(spark, [])).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (800, 100, 100))
    sets = [np.unique(np.concatenate([common, x])) for x in (a, b)]
    rows = minhash.signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
    assert abs((rows[0] == rows[1]).mean() - 0.8) < 0.1


def test_stars_find_the_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    for limit in (0, 1000):
        got = {r["id"]: r["component"] for r in minhash.components(edges, limit).collect()}
        assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_near_duplicates_of_the_test_table(spark):
    texts = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op6_near_duplicates(spark, SF).collect()}
    assert got == near(texts, 2, 80)
