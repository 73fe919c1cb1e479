"""Exact duplicates through an extendible-hash index on shared files.

The index is keyed by a 64-bit hash of the normalised text. It lies in the folder all executors share, as three tables:

* cards: a row for each document, with its key, its digest and a number of its own. Texts stay where they are.
* directory: a row for each used slot, the first `depth` bits of a key, with the bucket that the slot points to. A bucket is a
  range of keys; one that is overfull is split by one more bit, which doubles the directory where the bucket was as deep as
  the directory. Buckets that share a slot prefix and are not overfull stay one, so several slots point to them.
* entries: a row for each distinct text, in the order of the keys, so a task owns a range of buckets and a reader of a
  bucket skips the other files. Texts of one key are chained: each has its place in the key's chain.

What decides is the bytes: texts whose key occurs more than once are fetched, brought together by key and compared whole. Copies
are merged on the map side first, so a text that a third of all rows hold travels once a task. Rows find their text in the
chain by its SHA-256; if the bytes ever told apart two texts of one SHA-256, the job stops with an error.

Defined results: a null text is an empty one, and empty texts are equal to each other. White space is cut to one blank, not
trimmed. Of rows with equal texts and equal doc_ids one stays. A null doc_id comes after all others: such a row stays only if
all rows of its text have null ids, and then one of them stays and keep_id is null. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.llm.shared import scratch, written

BUCKET_BYTES = 64 << 20  # texts of a bucket; beyond it the bucket is split
FILTER_BITS = 26  # the filter for texts to be fetched has 2**26 bits (8 MB, broadcast as a million words), whatever the size of the input
HOT = 4096  # texts of more than one row in so many are joined by broadcast: there are fewer than HOT of them


@dataclass
class Index:
    cards: DataFrame
    directory: DataFrame
    entries: DataFrame
    depth: int  # bits of a slot


def normalised(text: str = "text") -> Column:
    """The text with each run of white space as one blank."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def slot(depth: int) -> Column:
    """The first bits of a key."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def _cards(docs: DataFrame, key) -> DataFrame:
    whole = docs.select("doc_id", normalised().alias("text"))
    return whole.select(
        "doc_id", key(F.col("text")).alias("key"), F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row_no"),
    )


def grown(loads: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int]:
    """The directory (slot, bucket, bucket_depth) for keys with their bytes, and its depth.

    Each key counts for all its prefixes up to the directory's depth; a bucket is a prefix that is not overfull and whose parent is.
    While a bucket of several keys is still overfull the directory is doubled, four times at once. The driver sees
    sums only.
    """
    total = loads.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    depth = max(0, math.ceil(math.log2(max(1, total / bucket_bytes)))) + 3
    while True:
        at = loads.select(slot(depth).alias("slot"), "bytes")
        slots = at.groupBy("slot").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("keys"))
        prefixes = slots.select("bytes", "keys", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"), "slot")
        prefixes = prefixes.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {depth} - d)"))
        held = prefixes.groupBy("d", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("keys").alias("keys"))
        held = held.withColumn("full", (F.col("bytes") > bucket_bytes) & (F.col("keys") > 1))
        split = held.where("full").select((F.col("d") + 1).alias("d"), F.col("prefix").alias("parent"))
        at_root = F.col("d") == 0
        leaves = held.where(F.expr(f"not full or d = {depth}")).withColumn("parent", F.shiftright("prefix", 1))
        leaves = leaves.where(at_root).unionByName(leaves.where(~at_root).join(split, ["d", "parent"], "left_semi"))
        leaves = written(leaves.select("d", "prefix", "full"), "buckets")
        if depth >= 60 or leaves.where("full").isEmpty():
            break
        depth = min(60, depth + 4)
    pointers = prefixes.join(leaves.select("d", "prefix"), ["d", "prefix"])
    bucket = F.expr(f"shiftleft(prefix, {depth} - d)").alias("bucket")  # the first slot of its range
    return written(pointers.select("slot", bucket, F.col("d").alias("bucket_depth")), "directory"), depth


def _fetched(docs: DataFrame, repeated: DataFrame, key) -> DataFrame:
    """(key, text) of the rows whose key is in `repeated`, with the texts of few other keys.

    The filter is a bitmap of 2**FILTER_BITS bits, broadcast as at most 2**(FILTER_BITS - 6) words. When so many keys are
    repeated that it lets most texts through, the join that follows moves more of them; results are the same.
    """
    place = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = repeated.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    texts = docs.select(normalised().alias("text")).withColumn("key", key(F.col("text"))).withColumn("place", place)
    may = texts.withColumn("word", F.shiftright("place", 6)).join(F.broadcast(words), "word")
    return may.where(F.col("bits").bitwiseAND(bit) != 0).select("key", "text")


def build(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, key=F.xxhash64) -> Index:
    """The index of all documents. key makes 64 bits of the normalised text; a poor one makes long chains, not wrong ones."""
    spark = docs.sparkSession
    cards = written(_cards(docs, key), "cards")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_no")).alias("first")
    texts = cards.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), first, F.max("bytes").alias("bytes"))
    texts = written(texts, "texts")
    loads = texts.groupBy("key").agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"))
    directory, depth = grown(loads, bucket_bytes)

    repeated = loads.where("rows > 1").select("key")
    # copies are merged before they travel, by all their bytes
    compared = _fetched(docs, repeated, key).groupBy("key", "text").agg(F.count(F.lit(1)).alias("n_equal"))
    chained = compared.select("key", F.unhex(F.sha2("text", 256)).alias("digest"), "n_equal")
    chained = chained.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("different"), F.sum("n_equal").alias("n_equal"))

    entries = texts.join(chained, ["key", "digest"], "left")
    unlike = (F.col("different") > 1) | (F.col("n_equal") != F.col("n"))
    n = F.when(unlike, F.raise_error(F.lit("texts of one SHA-256 differ, or the documents changed meanwhile"))).otherwise(F.col("n"))
    entries = entries.withColumn("n", n.cast("long")).withColumn("slot", slot(depth)).join(directory, "slot")
    chain = W.partitionBy("key").orderBy("digest")  # as long as texts share a 64-bit key
    entries = entries.withColumn("chain", F.row_number().over(chain))
    entries = entries.select("bucket", "bucket_depth", "key", "chain", "digest", "n", "first")
    path = scratch(spark, "entries")
    entries.repartitionByRange("bucket", "key", "digest").sortWithinPartitions("bucket", "key", "chain").write.parquet(path)
    return Index(cards, directory, spark.read.schema(entries.schema).parquet(path), depth)


def duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, key=F.xxhash64) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain."""
    index = build(docs, bucket_bytes, key)
    total = index.cards.count()
    entries = index.entries.select("key", "digest", "n", "first", "bucket", "chain")
    # fewer than HOT texts have more than total / HOT rows each, so their broadcast is bounded and the other keys are not hot
    hot = entries.where(F.col("n") * HOT > total)
    large = F.broadcast(hot.withColumnsRenamed({c: f"hot_{c}" for c in ("n", "first", "bucket", "chain")}))
    cards = index.cards.join(large, ["key", "digest"], "left")
    found = cards.where("hot_n is not null").select(
        "doc_id", "digest", "row_no", *[F.col(f"hot_{c}").alias(c) for c in ("n", "first", "bucket", "chain")]
    )
    rest = cards.where("hot_n is null").join(entries.where(F.col("n") * HOT <= total), ["key", "digest"])
    found = found.unionByName(rest.select(*found.columns))
    return found.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row_no") == F.col("first.row_no")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "bucket", "chain",
    )
