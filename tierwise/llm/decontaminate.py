"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every item gives its windows of ten consecutive words, or one window of all its words if it has fewer. Containment must
be whole, so of a window's words ordered by rarity the first alone is the necessary prefix: a text without
the window's rarest word can't hold the window. Words of texts join the prefix words; the place of the prefix word in its window
bounds where the window would start and end in the text; what remains is verified word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwise.llm.shared import written

WINDOW = 10
BLOCK = 50_000  # windows that one pass over the texts takes; each is ten words

#: Fixed value: what separates words, ASCII other than letters and digits.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """The words of a text, A-Z in lower case; of a null none."""
    plain = F.length(text) == F.octet_length(text)  # without other letters, lower() does no more than is wanted
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, SEPARATOR), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows with the item they come from: item_id, window (array of words)."""
    w = items.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("s")
    return w.select("item_id", "w", starts).select("item_id", F.slice("w", F.col("s"), window).alias("window")).distinct()


def _blocks(windows: DataFrame):
    """The windows' distinct texts in blocks of bounded size."""
    distinct = windows.select("window").distinct()
    n = -(-distinct.count() // BLOCK)
    for i in range(n):
        yield distinct if n == 1 else distinct.where(F.pmod(F.xxhash64("window"), F.lit(n)) == i)


def _prefixes(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window with its rarest word and that word's place. Rarity is counted over all texts."""
    asked = windows.select(F.explode("window").alias("word")).distinct()
    counts = texts.select(F.explode("w").alias("word")).join(F.broadcast(asked), "word").groupBy("word").agg(F.count("*").alias("n"))
    places = windows.select("window", F.posexplode("window").alias("place", "word")).join(counts, "word")
    # a window with a word that no text has can't occur, and falls out where not all its places are left
    rarest = F.min(F.struct("n", "word", "place")).alias("p")
    found = places.groupBy("window").agg(rarest, F.count("*").alias("left")).where(F.col("left") == F.size("window"))
    return found.select("window", F.xxhash64("window").alias("window_id"), F.col("p.word").alias("word"), F.col("p.place").alias("place"))


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_key, start (word number from 0), size and window of every occurrence of a window in a text.

    docs has doc_key and w, the words. A pass takes a block of windows, whose size is bounded, as a broadcast table; more
    blocks are more passes.
    """
    passes = []
    for block in _blocks(windows):
        prefix = written(_prefixes(docs, block), "prefixes")
        size = F.size("window")
        at = docs.select("doc_key", "w", F.posexplode("w").alias("i", "word")).join(F.broadcast(prefix), "word")
        start = F.col("i") - F.col("place")
        bounded = (start >= 0) & (start + size <= F.size("w"))
        edges = (F.get("w", start) == F.get("window", F.lit(0))) & (F.get("w", start + size - 1) == F.get("window", size - 1))
        same = F.slice("w", F.greatest(start, F.lit(0)) + 1, size) == F.col("window")
        passes.append(at.where(bounded & edges & same).select("doc_key", start.alias("start"), size.alias("size"), "window"))
    schema = "doc_key long, start int, size int, window array<string>"
    return reduce(DataFrame.unionAll, passes) if passes else docs.sparkSession.createDataFrame([], schema)


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """row (a struct of the columns of docs), n_words, spans (start and stop of occurring windows; null without any) and
    item_ids (as strings, sorted) for every row of docs.

    Null texts and texts without words have no window; null and empty items give none. Items that share a window are all
    reported. Rows that repeat id and text are judged alike. An item with a null item_id hits words but isn't listed.
    """
    key = F.xxhash64("doc_id", "text")  # rows of one id and one text are alike
    keyed = docs.select(key.alias("doc_key"), words("text").alias("w"))
    windows = written(item_windows(items, window), "windows")
    found = written(occurrences(keyed, windows), "occurrences")
    spans = F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop"))).alias("spans")
    named = found.select("doc_key", "window").distinct().join(windows, "window")
    hit = named.groupBy("doc_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    both = found.groupBy("doc_key").agg(spans).join(hit, "doc_key", "left")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(row, key.alias("doc_key"), F.size(words("text")).cast("long").alias("n_words"))
    items_of = F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    return packed.join(both, "doc_key", "left").select("row", "n_words", "spans", items_of)


def n_hit(spans: str = "spans") -> Column:
    """How many different words the spans cover."""
    each = F.transform(spans, lambda s: F.sequence(s["start"], s["stop"] - 1))
    return F.coalesce(F.size(F.array_distinct(F.flatten(each))), F.lit(0)).cast("long")
