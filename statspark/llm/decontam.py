"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Every item is read through windows of ``window`` consecutive words (an item with
fewer words is one window). A window is a set of shingles of ``shingle`` words;
as it must be contained whole, a prefix of one shingle is enough: the rarest by
benchmark frequency, longest first among equals. The documents' shingle hashes
are joined to these prefix tokens. The position of the token in the window
fixes where the window would start, so each match is bounded by the document's
first and last word and then verified: the words there must equal the window.

A document is parted into words once. Its shingles are generated as rows of
``shingle`` words inside generated code, where the array of all words is only
referred to; it is copied for no shingle. Windows carry the number of their set
of items, so a passage that all items share costs a number a match; the sets
are looked up once for each document and set.

The window table is sent to all executors while its counted rows stay within
``BROADCAST_ROWS``; a sentinel before the first word then keeps every document in the outer join,
and documents are read and tokenised once. Beyond, hashes alone are shuffled, and
candidates are verified where they meet their document again.

Defined cases: a null text or item has no words; a window of fewer words than a
shingle is one shingle of its own length; equal windows of several items count
for each of them; a null item id is not counted as an item, but its windows hit;
repeated rows are judged each; very long texts are read whole; of equally rare
and equally long shingles of a window the first is its prefix; an empty
benchmark or table gives clean or no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import merged_runs, settled, sized

WINDOW = 10
SHINGLE = 5
BROADCAST_ROWS = 500_000

# Everything but 0-9, a-z and characters beyond ASCII parts words (A-Z are lower-cased first).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-case A-Z only, then part into words."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, SEPARATORS, -1), "")


def _runs(words: Column, k: int) -> Column:
    """Rows of k neighbouring words for each place; those past the end hold nulls."""
    later = [F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0))).alias(f"w{i}") for i in range(1, k)]
    return F.arrays_zip(words.alias("w0"), *later)


def _token(run: Column, k: int) -> Column:
    """Hash of the first k words of a run; null where it has fewer."""
    whole = reduce(and_, [run[f"w{i}"].isNotNull() for i in range(k)])
    return F.when(whole, F.xxhash64(F.lit(k), *(run[f"w{i}"] for i in range(k))))


class Windows:
    """Distinct windows (token, place, set_no, window_words) and the items of each set (set_no, item_id)."""

    def __init__(self, windows: DataFrame, sets: DataFrame) -> None:
        self.windows, self.sets = windows, sets


def windows_of(items: DataFrame, text: str = "text", key: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE) -> Windows:
    """Distinct windows with their prefix token's hash and place, and the sets of items that hold them."""
    read = items.select(F.col(key).alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    cut = read.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("window_words"))
    cut = cut.groupBy("window_words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    numbered = settled(cut.select("items").distinct().withColumn("set_no", F.monotonically_increasing_id()))
    tokens = cut.select("window_words", "items", F.posexplode(_runs(F.col("window_words"), shingle)).alias("place", "run"))
    n = F.least(F.size("window_words"), F.lit(shingle))
    hashes = reduce(lambda c, k: c.when(n == k, _token(F.col("run"), k)), range(1, shingle + 1), F.when(F.lit(False), F.lit(0).cast("long")))
    tokens = tokens.withColumn("token", hashes).where(F.col("token").isNotNull())
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    long = F.length(F.concat_ws(" ", *(F.col(f"run.w{i}") for i in range(shingle))))
    best = tokens.withColumn("long", long).join(often, "token").groupBy("window_words", "items").agg(F.min_by(F.struct("token", "place"), F.struct("often", -F.col("long"), "place")).alias("b"))
    chosen = best.join(numbered, "items").select("b.token", "b.place", "set_no", "window_words")
    return Windows(settled(chosen), numbered.select("set_no", F.explode("items").alias("item_id")))


def scan(docs: DataFrame, found: Windows, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document row: ``row``, its id, word count, merged hit runs [start, end) and the numbers of the item sets."""
    windows = found.windows
    short = sorted(r["n"] for r in windows.select(F.least(F.size("window_words"), F.lit(shingle)).alias("n")).distinct().collect()) or [shingle]
    longest = short[-1]
    read = docs.select(F.col(key).alias("doc_id"), words_of(F.col(text)).alias("words"))

    def tokens(frame: DataFrame, *kept: str, sentinel: bool) -> DataFrame:
        """(at, token) of every shingle; ``at`` -1 is the sentinel."""
        base = F.concat(F.array(F.lit("")), F.col("words")) if sentinel else F.col("words")
        runs = frame.select(*kept, F.posexplode(_runs(base, longest)).alias("pos", "run"))
        at = (F.col("pos") - 1 if sentinel else F.col("pos")).alias("at")
        if len(short) == 1:
            return runs.select(*kept, at, _token(F.col("run"), longest).alias("token"))
        several = F.array(*(_token(F.col("run"), k) for k in short))
        return runs.select(*kept, at, F.explode(several).alias("token"))

    start, length = F.col("at") - F.col("place"), F.size("window_words")
    inside = (start >= 0) & (start + length <= F.size("words"))
    same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.greatest(length, F.lit(0))) == F.col("window_words")
    if windows.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rows = read.withColumn("row", F.monotonically_increasing_id())
        joined = tokens(rows, "row", "doc_id", "words", sentinel=True).join(F.broadcast(windows), "token", "left")
        matched = joined.where((F.col("at") < 0) | (F.col("place").isNotNull() & inside & same))
    else:
        # Only hashes are shuffled; candidates then meet their document's words once.
        rows = read.withColumn("content", F.xxhash64(F.col("doc_id"), F.array_join("words", " ")))
        narrow = tokens(rows, "content", sentinel=False).where(F.col("token").isNotNull()).join(windows, "token").distinct()
        candidates = narrow.groupBy("content").agg(F.collect_list(F.struct("at", "place", "set_no", "window_words")).alias("candidates"))
        none = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("set_no"), F.lit(None).cast("array<string>").alias("window_words")))
        together = rows.join(candidates, "content", "left").withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "words", F.inline(F.concat(none, F.coalesce("candidates", F.slice(none, 1, 0)))))
        matched = together.where((F.col("at") < 0) | (inside & same))
    real = F.col("at") >= 0
    hits = matched.select("row", "doc_id", F.size("words").alias("n_words"), F.when(real, F.struct(start.alias("s"), (start + length).alias("e"))).alias("run"), F.when(real, F.col("set_no")).alias("set_no"))
    per_doc = hits.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_set("run")).alias("runs"), F.collect_set("set_no").alias("set_nos"))
    return per_doc.select("row", "doc_id", "n_words", merged_runs(F.col("runs")).alias("hits"), "set_nos")


def hit_words() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + (r["e"] - r["s"]))


def report(scanned: DataFrame, found: Windows) -> DataFrame:
    """Counts and digests of a scan, one row per document row."""
    scanned = settled(scanned.select("row", "doc_id", "n_words", hit_words().alias("n_hit"), "set_nos"))
    pairs = scanned.select("row", F.explode("set_nos").alias("set_no")).join(sized(found.sets), "set_no").groupBy("row").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    ids = F.coalesce(F.array_sort("items"), F.array().cast("array<string>"))
    return scanned.join(sized(settled(pairs)), "row", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
