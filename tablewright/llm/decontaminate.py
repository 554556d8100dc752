"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words (the whole item where it is shorter). A
window is the set of its word shingles; a document holds the window only if it holds all of them, so
one shingle is a necessary prefix: the one that is rarest among the documents. Documents are joined
on it, length and position bounds drop what cannot fit, and the words of what is left are compared.

Defined cases: words are runs of characters that are no ASCII punctuation, space or control; A-Z count
as a-z, other characters as they are. Null and wordless texts have no words and are never hit; items
without words have no window. Repeated items share their windows and each count; an item without an id
hits but is not listed. Documents without a key, and repeated ones, are judged like all others.
Overlapping hits count each word once. All columns of the documents are kept, whatever their names;
those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.columns import column
from tablewright.llm.common import drop_stage, stage

WINDOW_WORDS = 13
SHINGLE_WORDS = 5
#: Shingles of the benchmark up to this number (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Verdicts and item ids in them up to this number may be broadcast; more are joined to the texts that they are about.
BROADCAST_VERDICTS = 100_000

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text as written; an ASCII capital is a letter here."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.expr("cast(array() as array<string>)"))


def folded(text: Column) -> Column:
    """A-Z lowered. Other letters stay: how they are lowered may depend on what is beside them."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _shingles(tokens: Column, size: int) -> Column:
    """Hashes of all shingles of ``size`` words, by place."""
    last = F.size(tokens) - size
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(size), *[F.get(tokens, i + j) for j in range(size)]))


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """Distinct windows: words, length, shingle size, shingle hashes and the items that hold them."""
    items = benchmark.select(F.col(item).alias("item"), words(folded(F.col(text))).alias("w")).filter("size(w) > 0")
    length = F.least(F.size("w"), F.lit(size))
    cut = items.select(
        "item", length.alias("length"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("words"),
    )
    shared = cut.groupBy("words", "length").agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    by_size = [F.when(F.least(F.col("length"), F.lit(SHINGLE_WORDS)) == k, _shingles(F.col("words"), k)) for k in range(1, SHINGLE_WORDS + 1)]
    return shared.select("words", "length", "items", F.coalesce(*by_size).alias("shingles"))


def _row(key: str, text: str) -> tuple[Column, Column]:
    """Two hashes of key and text that tell rows apart; only equal rows agree in both."""
    return F.xxhash64(column(key), column(text)), F.xxhash64(column(text).isNull(), column(text), column(key))


def _verdicts(
    docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, size: int, per: int
) -> tuple[DataFrame, DataFrame]:
    """Rows (key, mark, n_hit, items, contaminated) of the documents that hold a window, and the keys of all that were compared; both as stages.

    Two passes over the texts: the first finds where shingles of the benchmark occur, the second compares
    words in the documents that are left; only their texts are shuffled. Both fold A-Z alone. Places are
    joined by the first hash of a row and the comparison is made for each row, so that equal hashes do no harm.

    Places, words and items repeat so much that their files are a small part of what they take in memory. Spark
    would broadcast them by the size of the files, through the driver; they are joined by sorting instead.
    """
    spark = docs.sparkSession
    wanted = stage(windows(benchmark, item, item_text, size), "decontaminate-windows")
    sizes = [r.k for r in wanted.select(F.least("length", F.lit(SHINGLE_WORDS)).alias("k")).distinct().collect()]
    needed = wanted.select(F.explode("shingles").alias("shingle")).distinct()
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    row, mark = _row(key, text)
    lowered = docs.select(row.alias("key"), words(folded(column(text))).alias("w"))
    found = [
        lowered.select("key", F.size("w").alias("n"), F.posexplode(_shingles(F.col("w"), k)).alias("place", "shingle")).join(needed, "shingle")
        for k in sorted(sizes)
    ]
    if not found:
        found = [lowered.select(F.lit(0).cast("long").alias("shingle"), "key", F.size("w").alias("n"), F.lit(0).alias("place")).filter("false")]
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = stage(hits, "decontaminate-hits")
    rarity = hits.groupBy("shingle").agg(F.count("*").alias("seen"))
    places = wanted.select("words", F.posexplode("shingles").alias("offset", "shingle")).join(rarity, "shingle", "left")
    prefix = places.groupBy("words").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "offset", "shingle")).alias("rarest")
    ).filter("rarest.seen > 0")
    prefix = prefix.join(wanted.select("words", "length", "items").hint("merge"), "words").select(
        "words", "length", "items", "rarest.offset", "rarest.shingle"
    )
    candidates = (
        hits.hint("merge").join(prefix, "shingle")
        .withColumn("start", F.col("place") - F.col("offset"))
        .filter("start >= 0 and start + length <= n")
        .groupBy("key")
        .agg(F.collect_set(F.struct("start", "length", F.array_join("words", " ").alias("joined"), "items")).alias("found"))
    )
    candidates = stage(candidates, "decontaminate-candidates")
    # Written on their own: as hashes do not repeat, Spark sees how small they are and broadcasts them, so that the other texts stay where they are.
    keys = stage(candidates.select("key"), "decontaminate-keys")
    held = docs.select(row.alias("key"), mark.alias("mark"), column(text).alias("text")).join(keys, "key", "left_semi")
    tokens = held.join(candidates.hint("merge"), "key").select("key", "mark", "found", words(F.col("text")).alias("w"))
    true = F.filter("found", lambda c: folded(F.array_join(F.slice("w", c.start + 1, c.length), " ")) == c.joined)
    # No filter here: it would be pushed down, and the words be cut anew for every place that is compared.
    checked = tokens.select("key", "mark", F.size("w").alias("n"), true.alias("true"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("true", lambda c: F.sequence(c.start, c.start + c.length - 1)))))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("true", lambda c: c.items))))
    found = stage(checked.select("key", "mark", "n", hit.cast("long").alias("n_hit"), names.alias("items")).distinct(), "decontaminate-verdicts")
    for old in (wanted, hits, candidates):
        drop_stage(spark, old)
    hit_enough = F.col("n_hit") * per >= F.col("n")
    return found.filter("n_hit > 0").select("key", "mark", "n_hit", "items", hit_enough.alias("contaminated")), keys


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW_WORDS,
    per: int = 20,
) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``contaminated`` to every document.

    A document is contaminated if at least one of ``per`` words is hit. Repeated and missing keys do no harm.
    """
    found, keys = _verdicts(docs, benchmark, key, text, item, item_text, size, per)
    if (found.agg(F.sum(F.size("items") + 1)).first()[0] or 0) > BROADCAST_VERDICTS:
        found = found.hint("merge")
    row, mark = _row(key, text)
    # All columns travel in one, so that their names cannot clash with those used here.
    kept = [column(c) for c in docs.columns if c not in ("n_words", "n_hit", "items", "contaminated")]
    whole = docs.select(F.struct(*kept).alias("all"), column(text).alias("text"), row.alias("key"), mark.alias("mark"))
    n, none = F.size(words(F.col("text"))).cast("long").alias("n_words"), F.expr("cast(array() as array<string>)")
    # Only the texts that were compared meet the verdicts; the others are left where they are.
    held = whole.join(keys, "key", "left_semi").join(found, ["key", "mark"], "left").select(
        "all.*", n, F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"),
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )
    others = whole.join(keys, "key", "left_anti").select(
        "all.*", n, F.lit(0).cast("long").alias("n_hit"), none.alias("items"), F.lit(False).alias("contaminated")
    )
    return others.union(held)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the options of ``contaminated``."""
    named = {"key": "doc_id", "text": "text", "item": "item_id", "item_text": "text", "size": WINDOW_WORDS, "per": 20} | options
    found, keys = _verdicts(docs, benchmark, **named)
    drop_stage(docs.sparkSession, keys)
    found = stage(found.filter("contaminated").select(F.col("key").alias("_row_key"), F.col("mark").alias("_row_mark")), "decontaminate-gone")
    row, mark = _row(named["key"], named["text"])
    return docs.join(found, (row == F.col("_row_key")) & (mark == F.col("_row_mark")), "left_anti")
