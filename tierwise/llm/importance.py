"""Importance resampling towards a target: documents whose n-grams are more usual in the target than in the corpus.

Features are all runs of one and two words, hashed into BUCKETS buckets. Both corpora are counted whole; a bucket's gain is
the logarithm of its smoothed share in the target over that in the corpus. Documents are drawn without replacement by their mean
gain plus Gumbel noise, which is fixed by the seed and the doc_id.

Text is worked on a batch of columns at a time by Arrow's kernels: ascii_lower, split_pattern_regex and list_flatten give the words of
all texts as one array, dictionary_encode an index for each; the index of a word beside that of the next makes a
pair, dictionary_encode again finds the distinct pairs. Only distinct words and pairs are hashed; their gains are
taken back to the places by `take` and summed by segment.

Defined results: a null or empty text, or one without words, has no features and weight 0. Rows that repeat are documents of
their own. A null doc_id is an empty string to the noise and comes after equal scores. Documents of fewer than LEAST_WORDS words
are counted and scored, never drawn. An empty target has t = T = 0; an empty corpus gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwise.llm.shared import from_zero, parts, written
from tierwise.operators.order import numbered

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
PART_BYTES = 4 << 20  # of text worked on at once
#: What stands between words (of ASCII, all but digits and small letters), and the reflected CRC-32 polynomial.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
POLYNOMIAL = 0xEDB88320

_BLANK = b" "
_LONG = 64  # words of more bytes are hashed one pair at a time


def _crc_table() -> np.ndarray:
    """What a byte of zeros does to each low byte of a CRC."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return table


def _passers() -> np.ndarray:
    """[n, i, byte]: what n zero bytes make of a CRC of which only byte i is set; XOR over i gives any CRC."""
    step = _crc_table()
    out = np.empty((_LONG + 2, 4, 256), np.uint32)
    for i in range(4):
        out[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for n in range(1, _LONG + 2):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ step[out[n - 1] & np.uint32(255)]
    return out


_PASS = _passers()


def _pair_crcs(first: np.ndarray, second: np.ndarray, words: list[bytes], crcs: np.ndarray, tails: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of "first second" for each pair of word numbers, from the CRCs of the words and of " second"."""
    at = np.minimum(sizes[second] + 1, _LONG + 1)
    head = crcs[first]
    out = tails[second].copy()
    for i in range(4):
        out ^= _PASS[at, i, (head >> np.uint32(8 * i)) & np.uint32(255)]
    for j in np.flatnonzero(sizes[second] > _LONG):
        out[j] = zlib.crc32(_BLANK + words[second[j]], int(head[j]))
    return out


class Features:
    """The hashed features of some texts: `buckets` a feature, `of` its document, both for words and then for pairs."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
        flat = pc.list_flatten(lists)
        of = pc.list_parent_indices(lists).to_numpy()
        there = pc.not_equal(flat, "")
        flat, of = flat.filter(there), of[there.to_numpy(zero_copy_only=False)]
        encoded = flat.dictionary_encode()
        words = [w.encode() for w in encoded.dictionary.to_pylist()]
        index = encoded.indices.to_numpy().astype(np.int64)
        crcs = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words))
        tails = np.fromiter((zlib.crc32(_BLANK + w) for w in words), np.uint32, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))

        together = of[:-1] == of[1:]  # a pair lies in one document
        pairs = pa.array((index[:-1] * (len(words) + 1) + index[1:])[together]).dictionary_encode()
        distinct = pairs.dictionary.to_numpy()
        first, second = np.divmod(distinct, len(words) + 1)
        by_pair = _pair_crcs(first, second, words, crcs, tails, sizes) % np.uint32(BUCKETS)
        self.n = len(texts)
        self.word_at, self.pair_at = encoded.indices, pairs.indices
        self.word_buckets, self.pair_buckets = (crcs % np.uint32(BUCKETS)).astype(np.int64), by_pair.astype(np.int64)
        self.word_of, self.pair_of = of, of[:-1][together]

    def counts(self) -> np.ndarray:
        """Features of each bucket."""
        out = np.zeros(BUCKETS, np.int64)
        for buckets, at in ((self.word_buckets, self.word_at), (self.pair_buckets, self.pair_at)):
            # repeats of each distinct word or pair, added to its bucket
            n = np.bincount(at.to_numpy(), minlength=len(buckets))
            np.add.at(out, buckets, n)
        return out

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, features and the sum of the gains of each document."""
        total = np.zeros(self.n, np.int64)
        n_words = np.bincount(self.word_of, minlength=self.n).astype(np.int64)
        n_pairs = np.bincount(self.pair_of, minlength=self.n).astype(np.int64)
        for buckets, at, n in ((self.word_buckets, self.word_at, n_words), (self.pair_buckets, self.pair_at, n_pairs)):
            held = pa.array(gains[buckets]).take(at).to_numpy()
            before = np.r_[0, np.cumsum(held)]
            ends = np.cumsum(n)
            total += before[ends] - before[ends - n]
        return n_words, n_words + n_pairs, total


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a used bucket and task."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in parts(batch, size=PART_BYTES):
            total += Features(from_zero(part.column("text"))).counts()
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n): the features of all texts, repeats counted. At most BUCKETS rows."""
    each = docs.select("text").mapInArrow(_counted, "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain): floor(1000 * ln of the smoothed share in the target over that in the documents), of every bucket."""
    source = bucket_counts(docs).withColumnRenamed("n", "s")
    wanted = bucket_counts(target).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    held = every.join(source, "bucket", "left").join(wanted, "bucket", "left").fillna(0, ["s", "t"])
    # both totals come from the same BUCKETS rows
    held = written(held, "bucket-counts")
    S, T = held.agg(F.sum("s"), F.sum("t")).first()
    up = (F.col("t") + 1) * F.lit(S + BUCKETS)
    down = (F.col("s") + 1) * F.lit(T + BUCKETS)
    return held.select("bucket", F.floor(F.lit(1000.0) * F.log(up.cast("double") / down.cast("double"))).alias("gain"))


def noise(seed: int = SEED) -> Column:
    """The document's Gumbel noise in thousandths, from its doc_id alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, gain: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document. Of the gains BUCKETS numbers go to the tasks."""
    known = np.zeros(BUCKETS, np.int64)
    for bucket, value in gain.collect():  # exactly BUCKETS rows
        known[bucket] = value

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, size=PART_BYTES):
                n_words, n, total = Features(from_zero(part.column("text"))).sums(known)
                mean = np.where(n > 0, total // np.maximum(n, 1), 0)
                columns = [part.column("doc_id"), *map(pa.array, (n_words, n, mean))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(weighed, f"doc_id {kind}, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(seed))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with doc_id, n_features, weight, score and rank; the rank is null for those not drawn.

    Drawn are floor(percent * N / 100) of the N documents with at least least_words words, those of the highest scores. Places in the
    order come from range partitions and their counts, so no task sees all scores.
    """
    rows = written(scored(docs, gains(docs, target), seed), "scores")
    fit = F.col("n_words") >= least_words
    drawn = rows.where(fit).count() * percent // 100
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"))
    placed = numbered(rows.where(fit), *order, position="place")
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).unionByName(
        rows.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank"))
    )
