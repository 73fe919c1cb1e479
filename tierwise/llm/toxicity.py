"""Toxicity by class-conditional Kneser-Ney models.

Two word models, toxic and ordinary, give each word a likelihood after the word before it. A pair's discounted count backs
off to the word's, the word's to its stem's (its first five bytes, so inflected forms help each other), and the last step
is shared: the number of different words that a word follows, whichever the class, with one weight for both. So an
expression that neither class knows says nothing, and a rare one little. A text is judged by the log-likelihood
difference per word, over the whole text and over its most suspicious windows, and a logistic curve over these
and the log of the length turns it into a score.

Counts cover every labelled row and are exact, one row a word or pair in a Spark table, which grows with the corpus; words are
64-bit hashes. The discount is fixed. What both classes share cancels out, so an expression whose counts the discount
takes away in both differs in nothing from its back-off: the table of differences (key, d) leaves it out without loss.
The texts' expressions meet that table in shuffles, block by block of text, as sorted and packed ranges of hashes. A broadcast
bit filter of bounded size spares most expressions that the table lacks the way; what passes it by chance finds nothing there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwise.llm.shared import LOWER, byte_view, mix, parts, removed, word_bounds, word_hashes, written

STEM = 5
PART = 4 << 20  # bytes of text that are scored at once
SMALL = 2 << 20  # bytes of text whose words are looked at at once
BLOCK = 32 << 20  # bytes of text, about, that share a dictionary
SPREAD = 3  # partitions for each block, so few of them meet in one
BATCH = 2000  # rows of text in an Arrow batch while words are counted
SUMMED = 8 << 20  # bytes of text whose words and pairs are summed before they travel
RANGE = 12 << 20  # bytes of text for each range of hashes that one task sums
FILTER_BITS = (16, 28)  # least and greatest size of the bit filter, as powers of two
SLICE = 16  # bits of a filter's slice, as a power of two
LABEL_BITS = 26  # size of the bit map of labelled ids, as a power of two
DISCOUNT = 4.0  # taken from each class count; so much evidence of an expression is no evidence
WINDOWS = (1, 3, 8)  # words of the windows whose largest mean counts
STRONG = 3.0  # what a word's difference must exceed to count by itself
CALIBRATION_ROWS = 20_000  # labelled rows, those of lowest hash, that the curve is fitted on

#: Fixed value: words are runs of ASCII letters and digits and of all other characters beyond ASCII.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_STEM = np.uint64(0x5DEECE66D1CE4E5B)
_COUNTS = ("toxic", "ordinary", "toxic_third", "ordinary_third")
_NEIGHBOURS = ("left", "left_all", "right", "right_all")
_GRAMS = ", ".join(f"{c} long" for c in ("a", "b", *_COUNTS))
_PACKED = pa.schema([("part", pa.int64()), ("pair", pa.bool_()), ("n", pa.int64()), ("packed", pa.binary())])
_CODEC = pa.Codec("zstd", 1)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _different(keys: np.ndarray) -> np.ndarray:
    return pc.unique(pa.array(keys)).to_numpy()  # by hashing, several times faster than by sorting


def _words(text: pa.Array) -> tuple[np.ndarray, ...]:
    """Hashes of each word and of its stem, whether a word of its text comes before it; row of each word; n + 1 first words."""
    data, offsets = byte_view(text)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, _SEPARATOR)
    stem = mix(word_hashes(data, starts, np.minimum(ends, starts + STEM)), _STEM)
    after = np.ones(len(starts), bool)
    after[first[:-1][np.diff(first) > 0]] = False
    return word_hashes(data, starts, ends), stem, after, np.repeat(np.arange(len(first) - 1), np.diff(first)), first


def _pairs(word: np.ndarray) -> np.ndarray:
    """Key of the pair that each word ends; the first has none and gets its own hash."""
    return np.r_[word[:1], mix(word[:-1], word[1:])]


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte, all first bytes first: the leading bytes of sorted steps and of small counts are alike."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _ranked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a and b in ascending order, and their places for each (a, b) as one number of 62 bits."""
    coded = pc.dictionary_encode(pa.array(np.r_[a, b]))
    values = coded.dictionary.to_numpy()
    order = np.argsort(values)
    place = np.empty(len(values), np.uint64)
    place[order] = np.arange(len(values), dtype=np.uint64)
    place = place[coded.indices.to_numpy()]
    return values[order], place[: len(a)] << np.uint64(31) | place[len(a) :]


def _unranked(values: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return values[ranked >> np.uint64(31)], values[ranked & np.uint64((1 << 31) - 1)]


def _summed(a: np.ndarray, b: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct (a, b) in ascending order with the sums of each of their counts."""
    values, ranked = _ranked(a, b)
    order = np.argsort(ranked)
    ranked = ranked[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]][: len(a)])
    sums = [np.add.reduceat(c[order], first, dtype=np.int64) if len(first) else c.astype(np.int64) for c in counts]
    return *_unranked(values, ranked[first]), sums


def _pack(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted rows as bytes: steps of a, b, and the four counts."""
    steps = np.diff(a, prepend=np.uint64(0))
    return _CODEC.compress(_planes(steps) + _planes(b) + _planes(counts), asbytes=True)


def _unpack(packed: pa.Buffer, n: int) -> list[np.ndarray]:
    """a, b and the four counts, which are those of a few MB of text and fit 32 bits."""
    planes = np.frombuffer(_CODEC.decompress(packed, 48 * n, asbytes=True), np.uint8).reshape(-1, n)
    whole = lambda x, kind: np.ascontiguousarray(x.T).view(kind).ravel()
    counts = [whole(planes[i : i + 4], np.uint32) for i in range(16, 48, 8)]  # the low bytes come first
    return [np.cumsum(whole(planes[:8], np.uint64), dtype=np.uint64), whole(planes[8:16], np.uint64), *counts]


def _counted(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Words (word, stem) and pairs (word, word after it) with their counts by class, in the third and in the other rows.

    Sums of about SUMMED bytes of text each, a packed row a range of hashes.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def sums() -> Iterator[pa.RecordBatch]:
        word, stem, kinds, after = (np.concatenate(x) for x in zip(*held))
        held.clear()
        for pair in (False, True):
            if pair:
                del stem
                at = np.flatnonzero(after)  # the word before one that is after another is of the same text
                values, ranked = _ranked(word[at - 1], word[at])
                kind = kinds[at]
                del word, at
            else:
                kind = kinds
                values, ranked = _ranked(word, stem)
            ranked <<= np.uint64(2)
            ranked |= kind
            ranked.sort()  # whole numbers sort faster than places
            kind = (ranked & np.uint64(3)).astype(np.int64)
            ranked >>= np.uint64(2)
            new = np.r_[True, ranked[1:] != ranked[:-1]][: len(ranked)]
            counts = np.bincount((np.cumsum(new) - 1) * 4 + kind, minlength=4 * int(new.sum())).reshape(-1, 4)
            a, b = _unranked(values, ranked[new])
            del values, ranked, kind, new
            hashed = mix(a, b) if pair else a
            at = ((hashed >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            numbers, first = np.unique(at[order], return_index=True)
            for number, these in zip(numbers.tolist(), np.split(order, first[1:])):
                packed = _pack(a[these], b[these], counts[these])
                yield pa.RecordBatch.from_pylist(
                    [{"part": number + pair * ranges, "pair": pair, "n": len(these), "packed": packed}], schema=_PACKED
                )
        pa.default_memory_pool().release_unused()

    size = 0
    for batch in batches:
        for part in parts(batch, size=SMALL):
            word, stem, after, rows, _ = _words(part.column("text"))
            kind = (1 - part.column("label").to_numpy() + 2 * part.column("third").to_numpy())[rows]
            held.append((word, stem, kind.astype(np.uint8), after))
            size += int(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0)
            if size >= SUMMED:
                yield from sums()
                size = 0
    if held:
        yield from sums()


def _entries(table: pa.Table) -> pa.Table:
    """The exact rows of one range: words; or pairs with evidence, and neighbours of words, a partial sum of this range."""
    pair = table.column("pair")[0].as_py()
    rows = [_unpack(x.as_buffer(), n.as_py()) for x, n in zip(table.column("packed"), table.column("n"))]
    columns = []
    for i in range(6):  # column by column, so that the rows are there once
        columns.append(np.concatenate([x[i] for x in rows]))
        for x in rows:
            x[i] = None
    a, b, counts = _summed(columns[0], columns[1], columns[2:])
    del rows, columns

    def entries(pair: bool, a: np.ndarray, b: np.ndarray | None, counts: list[np.ndarray] | None, beside: list[np.ndarray] | None) -> pa.Table:
        zero = [np.zeros(len(a), np.int64)] * 4
        return pa.table(
            [pa.array(np.full(len(a), pair)), _longs(a), pa.nulls(len(a), pa.int64()) if b is None else _longs(b), *map(_longs, [*(counts or zero), *(beside or zero)])],
            ["pair", "a", "b", *_COUNTS, *_NEIGHBOURS],
        )

    if not pair:
        return entries(False, a, b, counts, None)
    # a pair counts once as a follower of its first word and once as a predecessor of its second
    learned = counts[0] + counts[1] > 0
    coded = pc.dictionary_encode(pa.array(np.r_[a, b]))
    words, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    before, after = at[len(a) :], at[: len(a)]
    beside = [np.bincount(x, minlength=len(words)) for x in (before[learned], before, after[learned], after)]
    evident = (counts[0] + counts[2] > DISCOUNT) | (counts[1] + counts[3] > DISCOUNT)
    found = [entries(True, a[evident], b[evident], [c[evident] for c in counts], None), entries(False, words, None, None, beside)]
    pa.default_memory_pool().release_unused()
    return pa.concat_tables(found)


def grams(rows: DataFrame) -> DataFrame:
    """One row a word (a, with its stem b) and a pair (a, b) of rows (text, label, third): its exact counts by class.

    Words also have the number of different words before (left) and after them (right), among the other two thirds and among all
    rows. Pairs of which the discount leaves nothing are no rows, but their words are neighbours.

    Sums of single tasks travel packed, dealt by the hash of the pair, so a frequent word's pairs are dealt evenly. The number of
    ranges grows with the text: a range holds the different words or pairs of RANGE bytes of it at most.
    """
    ranges = 1 + int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE
    packed = rows.mapInArrow(lambda batches: _counted(batches, ranges), "part long, pair boolean, n long, packed binary")
    neighbours = ", ".join(f"{c} long" for c in _NEIGHBOURS)
    each = packed.groupBy("part").applyInArrow(_entries, f"pair boolean, {_GRAMS}, {neighbours}")
    each = written(each, "entries", release=True, batch=BATCH)
    # a pair is whole in its range; words meet their neighbour counts, and the stem is known to the word's own row only
    added = [F.sum(c).alias(c) for c in (*_COUNTS, *_NEIGHBOURS)]
    words = each.where("not pair").groupBy("a").agg(F.max("b").alias("b"), *added)
    words = written(words.select(F.lit(False).alias("pair"), "a", "b", *_COUNTS, *_NEIGHBOURS), "words", release=True)
    return words.where("not pair").unionByName(each.where("pair"))  # each reader of one kind scans one table


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).fill_null(0).to_numpy().view(np.uint64) for c in "ab")
        single = np.asarray(batch.column("b").is_null())
        yield pa.RecordBatch.from_arrays([_longs(np.where(single, a, mix(a, b))), batch.column("d").cast(pa.float32())], ["key", "d"])


def differences(found: DataFrame, everything: bool) -> DataFrame:
    """key and d of all stems, words and pairs with evidence: log-likelihood under the toxic model less that under the ordinary one.

    Counts are those of all rows, or of those that are not of the third.
    """
    t, o = (F.col(c) + F.col(f"{c}_third") if everything else F.col(c) for c in ("toxic", "ordinary"))
    left, right = (F.col(f"{c}_all" if everything else c) for c in ("left", "right"))
    found = found.select("pair", "a", "b", t.alias("t"), o.alias("o"), left.alias("left"), right.alias("right")).where("t + o > 0")
    words = found.where("not pair").withColumnRenamed("b", "stem")
    stems = words.groupBy("stem").agg(F.sum("t").alias("stem_t"), F.sum("o").alias("stem_o"))
    both = F.col("t") + F.col("o")
    total = words.agg(F.sum("t"), F.sum("o"), F.sum(F.least(both, F.lit(DISCOUNT))), F.sum(F.col("left") + 1)).first()
    n_t, n_o, backed, continued = (float(x or 0) for x in total)
    n = {"t": max(1.0, n_t), "o": max(1.0, n_o)}
    back = max(1.0, backed) / max(1.0, n_t + n_o)  # one weight for both classes

    def discounted(count: str) -> Column:
        return F.greatest(F.col(count) - DISCOUNT, F.lit(0.0))

    shared = (F.col("stem_t") + F.col("stem_o") + 1) / (n_t + n_o + stems.count())
    for k in "to":
        stems = stems.withColumn(f"low_{k}", discounted(f"stem_{k}") / n[k] + back * shared)
    lower = (F.col("left") + 1) / max(1.0, continued) / shared
    follow = F.least("right", both) * DISCOUNT / both
    rest = F.least(F.greatest(follow, F.lit(back)), F.lit(1.0))  # of a word's followers, the same for both
    words = words.join(stems, "stem").select(
        F.col("a").alias("word"), "t", "o", rest.alias("rest"), *[(discounted(k) / n[k] + back * lower * F.col(f"low_{k}")).alias(f"p_{k}") for k in "to"],
    )
    words = written(words, "words", release=True)
    pairs = found.where("pair").select("a", "b", "t", "o").where((F.col("t") > DISCOUNT) | (F.col("o") > DISCOUNT))
    pairs = pairs.join(words.select(F.col("word").alias("a"), F.col("t").alias("a_t"), F.col("o").alias("a_o"), "rest"), "a")
    pairs = pairs.join(words.select(F.col("word").alias("b"), "p_t", "p_o"), "b")
    after = {k: discounted(k) / F.greatest(F.col(f"a_{k}"), F.lit(1)) + F.col("rest") * F.col(f"p_{k}") for k in "to"}
    none = F.lit(None).cast("long").alias("b")
    evident = stems.where((F.col("stem_t") > DISCOUNT) | (F.col("stem_o") > DISCOUNT))
    rows = evident.select(F.col("stem").alias("a"), none, F.log(F.col("low_t") / F.col("low_o")).alias("d"))
    known = words.where((F.col("t") > DISCOUNT) | (F.col("o") > DISCOUNT))
    rows = rows.unionByName(known.select(F.col("word").alias("a"), none, F.log(F.col("p_t") / F.col("p_o")).alias("d")))
    rows = rows.unionByName(pairs.select("a", "b", F.log(after["t"] / after["o"]).alias("d")))
    known = written(rows.mapInArrow(_keyed, "key long, d float"), "differences", release=True)
    removed(words)
    return known


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _filter(known: DataFrame) -> np.ndarray:
    """Bits of the places of all keys, 16 places a key as long as the greatest size allows."""
    bits = min(max(math.ceil(math.log2(16 * max(1, known.count()))), FILTER_BITS[0]), FILTER_BITS[1])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = np.unique(_slots(batch.column("key").to_numpy().view(np.uint64), bits))
            numbers, first = np.unique(slots >> SLICE, return_index=True)
            for number, these in zip(numbers.tolist(), np.split(slots & ((1 << SLICE) - 1), first[1:])):
                held.setdefault(number, np.zeros(1 << SLICE, bool))[these] = True
        for number, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([np.packbits(x).tobytes()], pa.binary())], ["number", "marks"])

    dealt = known.select("key").repartition(F.shiftrightunsigned("key", 64 - bits + SLICE))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in dealt.mapInArrow(marked, "number long, marks binary").toLocalIterator():
        at = row.number << (SLICE - 3)
        out[at : at + (1 << (SLICE - 3))] = np.frombuffer(row.marks, np.uint8)
    return out


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a block in each batch, compressed: block, bytes that n bytes of an Arrow stream became."""
    codec = pa.Codec("zstd", 3)
    for batch in batches:
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        numbers, first = np.unique(block[order], return_index=True)
        for number, these in zip(numbers.tolist(), np.split(order, first[1:])):
            sink = pa.BufferOutputStream()
            rows = pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(these))], ["row"])
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            plain = sink.getvalue()
            packed = codec.compress(plain, asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([plain.size]), pa.array([packed], pa.binary())], ["block", "n", "rows"])


def _unbundled(packed: bytes, n: int) -> pa.Table:
    return pa.ipc.open_stream(_CODEC.decompress(packed, n)).read_all()


def _text(rows: pa.Array | pa.ChunkedArray) -> pa.Array:
    text = pc.struct_field(rows, "text")
    return text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text


def _pack_keys(keys: np.ndarray, d: np.ndarray | None = None) -> bytes:
    """Ascending keys as bytes: their steps, and the differences of the keys."""
    planes = _planes(np.diff(keys, prepend=np.uint64(0)))
    return _CODEC.compress(planes + (b"" if d is None else _planes(d.astype(np.float32))), asbytes=True)


def _unpack_keys(packed: bytes, n: int, with_d: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    planes = np.frombuffer(_CODEC.decompress(packed, (8 + 4 * with_d) * n, asbytes=True), np.uint8).reshape(-1, n)
    steps = np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel()
    d = np.ascontiguousarray(planes[8:].T).view(np.float32).ravel() if with_d else None
    return np.cumsum(steps, dtype=np.uint64), d


def _met(known: pa.Table, wanted: pa.Table) -> pa.Table:
    """Of one range of keys, the packed rows (block, n, keys) with only the known keys, and their differences."""
    keys = known.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, d = keys[order], known.column("d").to_numpy()[order]
    blocks, sizes, found = [], [], []
    for block, n, packed in zip(*(wanted.column(c).to_pylist() for c in ("block", "n", "keys"))):
        asked, _ = _unpack_keys(packed, n)
        at = np.searchsorted(keys, asked)
        at[at == len(keys)] = 0
        hit = keys[at] == asked if len(keys) else np.zeros(n, bool)
        if hit.any():
            blocks.append(block)
            sizes.append(int(hit.sum()))
            found.append(_pack_keys(asked[hit], d[at[hit]]))
    return pa.table({"block": pa.array(blocks, pa.int64()), "n": pa.array(sizes, pa.int64()), "keys": pa.array(found, pa.binary())})


def _features(text: pa.Array, keys: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Features of texts; d are the differences of the keys, and a word without one has that of its back-off."""
    word, stem, after, rows, first = _words(text)
    value = np.zeros(len(word))
    places = pc.index_in(_longs(np.r_[stem, word, _pairs(word)]), value_set=_longs(keys)).fill_null(-1).to_numpy()
    for at, some in zip(places.reshape(3, -1), (True, True, after)):
        known = (at >= 0) & some
        value[known] = d[at[known]]
    d = np.clip(value, -12, 12)
    n_rows, size = len(first) - 1, np.diff(first)
    out = np.zeros((n_rows, len(WINDOWS) + 4))
    some = size > 0
    total = np.r_[0.0, np.cumsum(d)]
    out[:, 0] = (total[first[1:]] - total[first[:-1]]) / np.maximum(size, 1)
    out[:, 1] = (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(size, 1))
    for i, w in enumerate(WINDOWS):
        if len(d):
            to = np.minimum(np.arange(len(d)) + w, first[1:][rows])
            mean = (total[to] - total[np.arange(len(d))]) / w
            out[some, 2 + i] = np.maximum.reduceat(mean, first[:-1][some])
    strong = np.r_[0.0, np.cumsum(np.maximum(d - STRONG, 0))]
    out[:, -2] = np.log1p(strong[first[1:]] - strong[first[:-1]])
    out[:, -1] = np.log1p(size)
    return out


def _measured(docs: DataFrame, known: DataFrame) -> DataFrame:
    """row (a struct of the columns of docs) and x, the features of its text.

    Rows are dealt into blocks of about BLOCK bytes of text. A block's expressions that pass the filter meet the known ones range
    by range of their keys, sorted and packed, and come back to it as a dictionary.
    """
    n_blocks = 1 + int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK
    range_bits = n_blocks.bit_length()  # as many ranges of keys as blocks, or up to twice as many
    fits = known.sparkSession.sparkContext.broadcast(_filter(known))
    dealt = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    packed = docs.select(F.pmod(dealt, F.lit(n_blocks)).alias("block"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = packed.schema["row"].dataType.simpleString()
    packed = packed.mapInArrow(_bundled, "block long, n long, rows binary")
    packed = packed.repartition(SPREAD * n_blocks, "block")  # both its readers take this one shuffle

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, held = fits.value, {}
        bits = len(marks).bit_length() + 2
        for batch in batches:
            for number, n, packed_rows in zip(*map(batch.column, range(3))):
                number = number.as_py()
                plain = pa.RecordBatch.from_arrays([_text(_unbundled(packed_rows.as_buffer(), n.as_py()).column("row"))], ["text"])
                for part in parts(plain, size=SMALL):
                    word, stem, after, _, _ = _words(part.column("text"))
                    keys = np.r_[stem, word, _pairs(word)[after]]
                    slots = _slots(keys, bits)
                    keys = _different(keys[marks[slots >> 3] >> (7 - (slots & 7)) & 1 == 1])
                    held.setdefault(number, []).append(keys)
                if len(held.get(number, ())) > 15:
                    held[number] = [_different(np.concatenate(held[number]))]
        while held:
            number, some = held.popitem()
            keys = np.sort(_different(np.concatenate(some)))
            ranges, first = np.unique(_slots(keys, range_bits), return_index=True)
            some = [(r, len(k), _pack_keys(k)) for r, k in zip(ranges.tolist(), np.split(keys, first[1:])) if len(k)]
            if some:
                numbers, sizes, bytes_ = zip(*some)
                columns = [pa.array(numbers, pa.int64()), pa.array([number] * len(some), pa.int64()), pa.array(sizes, pa.int64()), pa.array(bytes_, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["range", "block", "n", "keys"])

    def measured(left: pa.Table, right: pa.Table) -> pa.Table:
        some = [_unpack_keys(x, n, True) for x, n in zip(right.column("keys").to_pylist(), right.column("n").to_pylist())]
        keys, d = (np.concatenate(x) for x in zip(*some)) if some else (np.zeros(0, np.uint64), np.zeros(0, np.float32))
        held, out = [], []
        bundles = list(zip(left.column("rows"), left.column("n")))
        for i, (packed_rows, n) in enumerate(bundles):  # a few bundles at a time; a block's rows are not copied once more
            held.append(_unbundled(packed_rows.as_buffer(), n.as_py()))
            if sum(x.nbytes for x in held) >= PART or i == len(bundles) - 1:
                rows = pa.concat_tables(held).combine_chunks()
                held = []
                plain = pa.RecordBatch.from_arrays([_text(rows.column("row"))], ["text"])
                x = np.concatenate([_features(part.column("text"), keys, d) for part in parts(plain, size=PART)])
                at = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                out.append(pa.table({"row": rows.column("row"), "x": pa.ListArray.from_arrays(at, pa.array(x.ravel()))}))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    dealt = known.select(F.shiftrightunsigned("key", 64 - range_bits).alias("range"), "key", "d")
    asked = packed.mapInArrow(wanted, "range long, block long, n long, keys binary")
    found = dealt.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(_met, "block long, n long, keys binary")
    return packed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(measured, f"row {row}, x array<double>")


@dataclass
class Model:
    """Differences (key, d) of all known expressions; weights are those of the curve over the features, the last one constant."""

    known: DataFrame | None = None
    weights: np.ndarray | None = None
    share: float = 0.0


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, the constant last."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    ridge = np.diag([*[1.0] * x.shape[1], 1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    out = w.copy()
    out[:-1] = w[:-1] / spread
    out[-1] = w[-1] - (w[:-1] * mean / spread).sum()
    return out


def fit(labelled: DataFrame) -> Model:
    """A model from labelled rows (text, label 0 or 1, order: a hash of the text).

    The curve is fitted on up to CALIBRATION_ROWS different texts of a third of the rows, under the counts of the others; the model
    then gets the counts of all. Rows with a null label teach nothing; null and empty texts have no words. Where either
    part lacks a label every score is the share of toxic rows in the third, 0 without any.
    """
    third = (F.pmod("order", F.lit(3)) == 0).cast("long").alias("third")
    labelled = written(labelled.where("label in (0, 1)").select("text", F.col("label").cast("long"), "order", third), "labelled", release=True, compression="zstd")
    found = grams(labelled.select("text", "label", "third"))
    counts = found.where("not pair").agg(F.sum("toxic"), F.sum("ordinary")).first()
    chosen = labelled.where("third = 1").select("order", "text", "label")
    last = chosen.select("order", "label").distinct().orderBy("order").limit(CALIBRATION_ROWS).agg(F.max("order")).first()[0]
    chosen = chosen.where(F.col("order") <= (0 if last is None else last)).dropDuplicates(["order", "label"])
    chosen = written(chosen, "chosen", release=True, compression="zstd")
    share = float(chosen.agg(F.avg("label")).first()[0] or 0)
    if not (0 < share < 1 and counts[0] and counts[1]):
        return Model(share=share)
    known = differences(found, everything=False)
    measured = written(_measured(chosen, known).select("row.label", "x"), "measured", release=True)
    rows = measured.limit(CALIBRATION_ROWS).collect()
    for done in (chosen, measured, known):
        removed(done)
    weights = _logistic(np.array([r.x for r in rows]), np.array([r.label for r in rows], float))
    known = differences(found, everything=True)
    removed(labelled)
    removed(found)
    return Model(known, weights, share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of the columns of docs) and score for every row of docs.

    Null, empty and wordless texts get the score of no evidence. No column but text is read.
    """
    if model.weights is None:
        return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(model.share).alias("score"))
    z = F.lit(float(model.weights[-1]))
    for i, w in enumerate(model.weights[:-1]):
        z += F.col("x")[i] * float(w)
    z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return _measured(docs, model.known).select("row", (1 / (1 + F.exp(-z))).alias("score"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _may_match(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id labels have, and a few more: a broadcast of at most 2**(LABEL_BITS - 6) words of a bit map.

    With more than some tens of millions of labels it lets more rows through; the join that follows then moves more, and
    results are the same.
    """
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - LABEL_BITS)
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = labels.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    placed = docs.withColumn("place", place).withColumn("word", F.shiftright("place", 6))
    return placed.join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "place", "bits")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows that are not held out. Of several labels of an id the highest counts.

    Labels whose id the documents' type of id can't hold match nothing. Equal texts are in the same third.
    """
    labels = labels.withColumn("doc_id", F.col("doc_id").try_cast(docs.schema["doc_id"].dataType)).where("doc_id is not null")
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("label")).where(~held_out() & F.col("label").isNotNull())
    texts = _may_match(docs.select("doc_id", "text").where(~held_out()), labels)
    # by merging at every size: labels grow with the documents, so a plan that broadcasts few of them says nothing about many
    rows = texts.join(labels.hint("merge"), "doc_id").select("text", "label", F.xxhash64("text").alias("order"))
    return fit(rows)
