r"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. A benchmark item gives its windows of `window` consecutive words; an item of fewer words, but
not none, is one window. To ask for whole windows means that a window's rarest word is a prefix that must be matched: words are ordered by how often
the documents have them (counted over all documents), and every window is filed under its rarest word. Documents' words are read in
order and joined with these prefix words only. A hit fixes where the window would have to start; it goes on only within the document's
bounds (length and position) and if the second rarest word stands at its place. Survivors are verified word by word.

The windows are the broadcast side. Their bytes are counted first, and windows beyond BROADCAST_BYTES are dealt by their prefix word into as many passes over
the documents as keep each pass within that bound. Nothing is exploded but one document's words in a pipeline of generated code, in which the word array is
passed by reference; what reaches the shuffle is a row for each document and one for each verified window.

Null and empty texts have no words. Repeated rows are judged each for themselves. Items with null text have no windows; a null item id is written as
an empty string. Other columns than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, without

#: Everything but the words, in a text whose A-Z are not yet lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows' bytes that one pass may broadcast.
BROADCAST_BYTES = 48 << 20


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words, before lower-casing; of no text none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _GAP), "")


def windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(window: lower-cased words, items: ids as strings) of all different windows."""
    words = F.split(lower_ascii(F.array_join(words_of(F.col(text_col)), " ")), " ")
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words.alias("words"), F.size(words_of(F.col(text_col))).alias("n")).where("n > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - (window - 1)))
    items = items.select("item", F.explode(F.transform(starts, lambda k: F.slice("words", k, F.least(F.lit(window), F.col("n"))))).alias("window"))
    return items.groupBy("window").agg(F.collect_set("item").alias("items"))


def _frequencies(texts: DataFrame, wins: DataFrame) -> DataFrame:  # a row for each word of the windows
    """How often the documents have each word of the windows; words are compared in full lower case, which is a rougher key than A-Z alone."""
    vocabulary = wins.select(F.explode("window").alias("w")).select(F.lower("w").alias("w")).distinct()
    size = vocabulary.agg(F.sum(F.length("w") + 32)).first()[0] or 0
    vocabulary = F.broadcast(vocabulary) if size <= BROADCAST_BYTES else vocabulary
    found = texts.select(F.explode(words_of(F.col("text"))).alias("w")).select(F.lower("w").alias("w"))
    often = found.join(vocabulary, "w", "left_semi").groupBy("w").agg(F.count("*").alias("n"))
    return F.broadcast(often) if size <= BROADCAST_BYTES else often


def _filed(wins: DataFrame, often: DataFrame) -> DataFrame:
    """Windows under their rarest word: (prefix, at: its place from 0, second, second_at: place relative to the prefix, len, joined, items)."""
    places = wins.select(F.xxhash64("window").alias("id"), "window", "items", F.posexplode("window").alias("k", "w"))
    places = places.withColumn("w", F.lower("w")).join(often, "w", "left")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("k"), F.col("w"))
    first = places.groupBy("window", "items").agg(F.array_sort(F.collect_list(rank)).alias("order"))
    second = F.coalesce(F.get("order", F.lit(1)), F.get("order", F.lit(0)))
    return first.select(
        F.get("order", F.lit(0))["w"].alias("prefix"),
        F.get("order", F.lit(0))["k"].alias("at"),
        second["w"].alias("second"),
        (second["k"] - F.get("order", F.lit(0))["k"]).alias("second_at"),
        F.size("window").alias("len"),
        F.array_join("window", " ").alias("joined"),
        "items",
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, items: sorted ids of the items with windows in the text, contaminated, row) for every row of docs.

    n_hit counts the words inside any occurrence of a window; contaminated: n_hit > 0 and share * n_hit >= n_words."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wins = windows(benchmark, window, item_col, item_text)
    filed = cut(_filed(wins, _frequencies(texts, wins)), few=True)
    bytes_, = filed.agg(F.sum(F.length("joined") + 64 + 24 * F.size("items"))).first()
    passes = max(1, -(-int(bytes_ or 0) // BROADCAST_BYTES))
    # the word array starts with a blank at place 0; it meets the blank prefix, so that every document gives one row
    blank = spark.range(1).select(F.lit("").alias("prefix"), F.lit(0).alias("at"), F.lit("").alias("second"), F.lit(0).alias("second_at"), F.lit(0).alias("len"), F.lit("").alias("joined"), F.lit(None).cast("array<string>").alias("items"))
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_prepend(words_of(F.col("text")), "").alias("words"))
    if passes > 1:  # numbered once, as the passes are put together by these numbers
        rows = cut(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")).select("row", "doc_id", F.array_prepend(words_of(F.col("text")), "").alias("words"))
    hits = []
    for k in range(passes):
        part = filed.where(F.pmod(F.xxhash64("prefix"), F.lit(passes)) == k) if passes > 1 else filed
        part = F.broadcast(part.unionByName(blank) if k == 0 else part)
        start = F.col("place") - F.col("at")
        fits = (F.lower("w") == F.col("prefix")) & ((F.col("len") == 0) & (F.col("place") == 0) | (F.col("len") > 0) & (start >= 1) & (start + F.col("len") <= F.size("words"))
            & (F.lower(F.get("words", F.when(F.col("place") + F.col("second_at") >= 0, F.col("place") + F.col("second_at")).otherwise(0))) == F.col("second"))
            & (lower_ascii(F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")), " ")) == F.col("joined")))
        each = rows.select("row", "doc_id", "words", F.posexplode("words").alias("place", "w"))
        found = each.join(part, fits).select("row", "doc_id", F.when(F.col("len") == 0, F.size("words") - 1).alias("n_words"), F.when(F.col("len") > 0, F.struct(start.alias("a"), (start + F.col("len")).alias("b"))).alias("span"), "items")
        hits.append(found)
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    out = found.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(F.array_sort("spans"), zero, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")), lambda s: s["n"])
    out = out.select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated; rows without an id stay."""
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col).where("contaminated").select(F.col("doc_id").alias(id_col)).distinct()
    return without(docs, bad, id_col)
