"""Frames of awkward documents, and plain versions of the word and shingle rules."""

import re

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (None, "the cat sat on the mat and the dog ran far away from it", "en", "s", 55),
    (3, "the cat sat on the mat and the dog ran far away from it", "en", None, 55),
    (3, "the cat sat on the mat and the dog ran far away from it", "en", None, 55),
    (4, "... !!! 123 \n\t", "en", "s", 13),
    (5, "Wort " * 30_000, "de", "s", 150_000),
    (6, "\u00c9t\u00e9 \u00e9t\u00e9 na\u00efve caf\u00e9 \U0001f600 \u4e2d\u6587", "fr", "s", 20),
]


def frame(spark, rows=None, extra=False):
    df = spark.createDataFrame(AWKWARD if rows is None else rows, FIELDS)
    if extra:  # names that operators use themselves
        for name in ("score", "lang_pred", "pii", "media", "feature", "row", "component_id", "kept", "words", "verdict"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def closed(sets, links):
    """Least reachable id by union and find."""
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in sets}
