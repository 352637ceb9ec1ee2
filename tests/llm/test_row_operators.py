"""Packing, media, licences, quality, language, and the pipeline."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from conftest import SF
from helpers import AWKWARD, frame
from statspark.llm import langid, license, media, packing, quality, queries
from statspark.llm.common import settled

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def truth(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    return [np.array([*plain.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4") for t in texts]


def check_packing(rows, texts, window):
    ids = dict(enumerate(truth(texts)))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for k, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[k])
            assert r["ids_crc32"] == zlib.crc32(ids[k][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[k])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize("partitions", [1, 5])
def test_every_token_is_packed_once_without_padding(spark, partitions):
    texts = [f"word{i} naive \u00e9t\u00e9 don't stop, now. " * (i % 17) for i in range(80)] + [None, "", "x " * 700, "<|endoftext|> odd <|x"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = packing.pack(spark, frame(spark, rows).repartition(partitions), TOKENIZER, window=256, open_windows=4, merge=2).collect()
    assert check_packing(got, texts, 256) == 0
    assert packing.pack(spark, frame(spark, []), TOKENIZER).count() == 0
    assert packing.pack(spark, frame(spark, extra=True), TOKENIZER).where("start = 0").count() == len(AWKWARD)


def test_ids_of_odd_words_match_the_tokenizer():
    ours = packing.WordTokenizer(TOKENIZER, cache_words=10)
    texts = ["A\u00c9a. \u00d7\u00f7 \u03a3\u03c2 \u01c5 e\u0301 \u0130 's don't 12\u00b2\u00bd \u4e2d\u6587.", None, "", " \t\n", "a\u00a0b \u2003c", "\U0001f600. x", "-- ,, a,", "HELLO hello Hello hello, HELLO!"]
    for _ in range(2):
        got = ours.encode_texts(pa.array(texts, pa.string()))
        assert [g + np.array([2], "<u4").tobytes() for g in got] == [t.tobytes() for t in truth(texts)]


@pytest.mark.parametrize("crowded", [False, True])
def test_the_word_table_grows_without_laying_known_words_anew(monkeypatch, crowded):
    """Slices with few new words must not cost the whole table; all words in one slot's run are still told apart."""
    if crowded:
        monkeypatch.setattr(packing.WordTokenizer, "_home", lambda self, keys: np.full(len(keys), len(self.keys) - 2))
    laid = []
    lay = packing.WordTokenizer._lay
    monkeypatch.setattr(packing.WordTokenizer, "_lay", lambda self, size: (laid.append(size), lay(self, size))[1])
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefgh\u00e9\u00c9XY"))
    count = 300 if crowded else 20_000
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) + str(rng.choice(["", ".", ",", "'s", "7"])) for _ in range(count)]
    texts = [" ".join(words[i : i + 100] + words[: i // 2 : 7]) for i in range(0, count, 100)]
    ours = packing.WordTokenizer(TOKENIZER)
    for text, ids in zip(texts, truth(texts)):
        assert ours.encode_texts(pa.array([text]))[0] == ids[:-1].tobytes()
    assert ours.held == np.count_nonzero(ours.keys) <= len(ours.keys) // 2
    assert laid == sorted(set(laid)) and len(laid) < 8  # sizes double; 200 slices had new words


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_texts_survive_as_images(spark, form):
    stored = media.store_texts(frame(spark, extra=True).select("doc_id", "text", "media", "feature"), form=form)
    got = media.media_digests(media.image_features(stored)).collect()
    for r in got:
        raw = (r["text"] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and len(r["feature"]) == 16
    assert len(got) == len(AWKWARD)


def test_images_round_trip_and_resize():
    rng = np.random.default_rng(0)
    grey, colour = rng.integers(0, 256, (7, 5, 1), np.uint8), rng.integers(0, 256, (6, 9, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_ppm(colour)) == colour).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all() and (media.decode(media.encode_bmp(colour)) == colour).all()
    assert media.decode(b"P2 # note\n2 2\n15\n0 15\n5 10").ravel().tolist() == [0, 255, 85, 170]
    assert media.decode(b"P1\n3 1\n1 0 1").ravel().tolist() == [0, 255, 0]
    assert media.decode(b"P4\n3 1\n\xa0").ravel().tolist() == [0, 255, 0]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").ravel().tolist() == [1, 2, 3]
    half = media.area_resize(grey[:6, :4].astype(np.uint8), 3, 2)
    assert np.allclose(half[:, :, 0], grey[:6, :4, 0].reshape(3, 2, 2, 2).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(grey, 3, 3).mean(), grey.mean())
    import io

    assert np.load(io.BytesIO(media.npy_tile(grey, 4, 4))).shape == (4, 4, 1)
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


DAMAGED = [
    None, b"", b"BM", b"BM" + b"\xff" * 60, b"P7\n1 1\n255\n0", b"P1\n", b"P1\n2 2\n1 0", b"P2\n1 1\n255\n300\n", b"P2\n1 1\n255\nx\n", b"P3\n1 1\n255\n1 2\n", b"P4\n9 9\n\x00", b"P5\nbroken", b"P5\n99999999999 9\n255\n\x00",
    b"P5\n2 2\n0\n\x00\x00\x00\x00", b"P5\n1 1\n15\n\xff", b"P6\n2 2\n255\n\x00", b"P5\n" + b"9" * 5000 + b" 1\n255\n\x00", media.encode_bmp(np.zeros((2, 2, 3), np.uint8))[:-3], b"P5\n1 1\n255\n",
]


def test_damaged_media_give_nulls(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(DAMAGED)] + [(99, b"P5\n1 1\n255\n\x07")], "doc_id long, media binary")
    for r in media.media_digests(media.image_features(df)).collect():
        good = r["doc_id"] == 99
        assert all((r[c] is not None) == good for c in ("height", "feature", "tile", "payload_bytes", "payload_sha256", "tail_crc32")), r["doc_id"]
        assert r["media_bytes"] == (None if r["media"] is None else len(r["media"]))


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_one_pass_equals_separate_passes(spark, form):
    docs = frame(spark, extra=True).select("doc_id", "text", "media", "feature")
    apart = media.media_digests(media.image_features(media.store_texts(docs, form=form)))
    names = ["doc_id", *(f.name for f in media.SUMMARY_FIELDS[:-1])]
    assert sorted(map(tuple, media.summarize_texts(docs, form=form).select(*names).collect()), key=str) == sorted(map(tuple, apart.select(*names).collect()), key=str)


def test_licences_are_found_and_inherited(spark):
    files = [
        ("a/LICENSE", "MIT stuff\nReleased under the MIT License."), ("a/b/x.py", "code\nno notice"), ("a/b/c/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), ("a/b/c/d/e.py", None),
        ("a/b/y.py", "first\nThis work is licensed under the GNU General Public License, version 3.\nlast"), ("z/q.py", "plain"), (None, "Licensed under CC BY-NC 4.0."), ("w.py", "a license to ramble about nothing at all in this long line of words"),
    ]
    df = spark.createDataFrame([(p, t, "clash") for p, t in files], "path string, text string, license string")
    got = {r["path"]: (r["license"], r["found_in"]) for r in license.inherit(settled(license.own_licences(spark, df))).collect()}
    assert got["a/b/x.py"] == ("MIT", "inherited") and got["a/b/c/d/e.py"] == ("Apache-2.0", "inherited")
    assert got["a/b/y.py"] == ("GPL-3.0", "header") and got["z/q.py"] == (None, "none") and got[None] == ("CC-BY-NC-4.0", "header") and got["w.py"] == (None, "none")
    assert got["a/LICENSE"][0] == "MIT"
    assert license.inherit(license.own_licences(spark, df.limit(0))).count() == 0


MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_licence_files_and_spdx_identifiers(spark):
    known = license.license_texts()
    agpl = known["GPL-3.0"].replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE", 1)
    bsd = known["BSD-3-Clause"]
    at, to = bsd.index("3. Neither"), bsd.index("THIS SOFTWARE")
    notice = "# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 2 of the License, or\n# (at your option) any later version."
    want = {
        "m/LICENSE": (MIT_BODY, "MIT"), "m/x.py": ("code", "MIT"), "g/COPYING": (known["GPL-3.0"], "GPL-3.0"), "g2/COPYING": (known["GPL-2.0"], "GPL-2.0"),
        "l/COPYING.LESSER": (known["LGPL-3.0"], "LGPL-3.0"), "a/LICENSE": (agpl, "AGPL-3.0"), "b/LICENSE": (bsd, "BSD-3-Clause"), "b2/LICENSE": (bsd[:at] + bsd[to:], "BSD-2-Clause"),
        "p/LICENSE.txt": (known["Apache-2.0"].split("\n", 4)[4], "Apache-2.0"), "q/LICENSE": (MIT_BODY.replace("Permission is", "Copyright (c) 2020 Some Name\n\nPermission is"), "MIT"),
        "s/1.py": ("# SPDX-License-Identifier: MIT\ncode", "MIT"), "s/2.c": ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"), "s/3.c": ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        "s/4.c": ("// SPDX-License-Identifier: Zlib", None), "t/1.txt": ("GNU GENERAL PUBLIC LICENSE", None), "t/2.txt": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0"), "t/3.py": (notice, "GPL-2.0"),
        "n/LICENSE": ("A licence to print money is what they called it, and the people of the town agreed that it was so.", None),
    }
    df = spark.createDataFrame([(p, t) for p, (t, _) in want.items()], "path string, text string")
    got = {r["path"]: r["license"] for r in license.inherit(settled(license.own_licences(spark, df))).collect()}
    assert got == {p: name for p, (_, name) in want.items()}


def test_language_and_quality_on_held_out_rows(spark):
    found = queries.op10_language_id(spark, SF).join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    scored = queries.op8_quality(spark, SF).join(queries.table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in scored]) > 0.85
    assert all(0 <= r["score"] <= 1 for r in found + scored)


def test_awkward_rows_of_the_classifiers(spark):
    df = frame(spark, extra=True)
    model = langid.fit(df)
    rows = {r["doc_id"]: r for r in langid.detect(spark, df, model).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[4]["lang_pred"] == "und" and rows[5]["lang_pred"] == "de" and rows[6]["lang_pred"] == "fr"
    assert rows[1]["score"] == 0
    nothing = langid.fit(df.where("false"))
    assert {r["lang_pred"] for r in langid.detect(spark, df, nothing).collect()} == {"und"}
    assert langid.detect(spark, frame(spark, []), model).count() == 0
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 0), (6, 1), (None, 1), (2, None), (1, 7)], "doc_id long, quality int")
    for marked in (labels, labels.where("quality = 1"), labels.where("false")):
        fitted = quality.fit(df, marked)
        got = quality.score(spark, df, fitted).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert quality.score(spark, frame(spark, []), fitted).count() == 0


def test_dual_coordinate_descent_meets_its_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    y = np.sign(x[:, 0] + 0.1 * rng.normal(size=60))
    w, b = quality.dual_coordinate_descent([np.arange(5)] * 60, list(x), y, 5, rounds=2000, tolerance=1e-9)
    slack = np.maximum(0, 1 - y * (x @ w + b))
    assert np.allclose(w, 2 * (slack * y) @ x, atol=1e-5) and b == pytest.approx(2 * (slack * y).sum(), abs=1e-5)


def test_the_pipeline_drops_leaks_copies_and_texts_without_a_language(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, kept, SF).write.parquet(path)
        before, kept = kept.count(), spark.read.parquet(path)
        assert kept.columns == docs.columns and 0 < kept.count() <= before
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert len(set(texts.values())) == len(texts)
    from test_span_operators import base_spans, leaks

    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert not any(r[5] for r in leaks(list(texts.items()), items))
    assert not any("email" in base_spans(t) or "card" in base_spans(t) for t in texts.values())
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(texts)


def test_pipeline_stages_take_awkward_rows(spark):
    df = frame(spark, extra=True)
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, df, SF).collect()} == {None, 3, 5, 6}
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()]
    assert len(kept) == 6 and sorted(x for x in kept if x not in (None, 3)) == [1, 2, 4, 5, 6]  # one of three copies, told by rows and not by ids
    assert corpus_pipeline.benchmark_leaks(spark, df, SF).count() == len(AWKWARD)
    assert corpus_pipeline.personal_data(spark, df, SF).count() == len(AWKWARD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), SF).count() == 0


def test_leaks_are_dropped_by_row(spark):
    item = queries.table(spark, SF, "benchmark").where("length(text) > 100").first()["text"]
    rows = [(None, f"x {item} y", "en", "s", 1), (None, "clean words", "en", "s", 2), (7, f"z {item}", "en", "s", 3), (7, "clean too", "en", "s", 4)]
    kept = corpus_pipeline.benchmark_leaks(spark, frame(spark, rows), SF).collect()
    assert sorted((r["text"], r["doc_id"]) for r in kept) == [("clean too", 7), ("clean words", None)]
    none = spark.createDataFrame([(1, "abc", None, None, 3), (2, "12", None, None, 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, none, SF).collect()] == [1]
