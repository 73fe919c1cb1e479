"""MinHash near-duplicates by a multi-index Hamming join.

A text's set are its distinct five-word shingles. Its signature has 64 minima, each cut to 16 bits, so two texts of
similarity s differ in about 64 (1 - s) values. Pairs that differ in at most 31 values are all found: 16 chunks of four
values can't all have two errors, so some chunk has one at most, and leaving out each value of a chunk in turn
enumerates the allowed errors. At a similarity of 0.75 a pair has 16 errors on average and more than 31
in about one case of 100,000; at 0.8 in one of ten million. Found pairs are confirmed on their full sets.

Equal sets are one class from the start. In each bucket every class is first compared with the bucket's smallest and
largest class; what these links join needs no further comparison. Buckets that still hold several components are compared
in tiles of bounded size, pairs of one component left out, and confirmed block by block. So a group of thousands of copies costs a star of links, not
all its pairs, and still no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwise.llm.graph import components
from tierwise.llm.shared import LOWER, SPACE, byte_view, mix, parts, runs, word_bounds, word_hashes, written

WORDS = 5
PERCENT = 75
VALUES, CHUNK = 64, 4
MOST_ERRORS = 2 * VALUES // CHUNK - 1
TILE = 1024  # classes of a bucket that are compared at once
BLOCK = 500_000  # shingles of the sets that are held at once, from each of two blocks
BATCH = 500  # texts or pairs of sets in an Arrow batch: a large group's pairs meet in one task

_SEEDS = np.random.default_rng(7).integers(1, 2**63, (2, VALUES), dtype=np.uint64) | np.uint64(1)


def shingles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row's text, sorted, and the n + 1 offsets into them."""
    data, offsets = byte_view(batch.column("text"))
    starts, ends, first = word_bounds(LOWER[data], offsets, SPACE)
    words = word_hashes(LOWER[data], starts, ends)
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(counts)), counts)
    grams = np.zeros(len(words), np.uint64)
    full = runs(words, WORDS)
    grams[: len(full)] = full
    usable = np.arange(len(words)) + WORDS <= first[1:][rows]
    for r in np.flatnonzero((counts > 0) & (counts < WORDS)):  # the whole sequence is the one shingle
        grams[first[r]] = runs(words[first[r] : first[r + 1]], int(counts[r]))[0]
        usable[first[r]] = True
    rows, grams = rows[usable], grams[usable]
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    rows, grams = rows[new], grams[new]
    return grams, np.searchsorted(rows, np.arange(len(counts) + 1))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch):
            grams, offsets = shingles(part)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            sums = np.zeros((2, len(sizes)), np.uint64)
            values = np.zeros((len(sizes), VALUES), np.uint16)
            if len(full):
                for i in range(2):
                    sums[i, full] = np.add.reduceat(mix(grams, _SEEDS[i, :1]), offsets[full])
                for i in range(VALUES):
                    x = (grams ^ _SEEDS[0, i]) * _SEEDS[1, i]
                    x ^= x >> np.uint64(32)
                    values[full, i] = (np.minimum.reduceat(x, offsets[full]) * _SEEDS[0, i] >> np.uint64(48)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    pa.array([row.tobytes() for row in values], pa.binary()),
                ],
                ["doc_id", "n_shingles", "h1", "h2", "signature"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (a 128-bit sum over the set) and signature; one row a document."""
    return docs.select("doc_id", "text").mapInArrow(
        _signatures, "doc_id long, n_shingles long, h1 long, h2 long, signature binary"
    )


def _buckets(classes: DataFrame) -> DataFrame:
    """A row for each chunk and each of its values left out: key, id."""
    keys = []
    for c in range(VALUES // CHUNK):
        for left_out in range(CHUNK):
            bytes_ = [F.substring("signature", 2 * (c * CHUNK + i) + 1, 2) for i in range(CHUNK) if i != left_out]
            keys.append(F.xxhash64(F.lit(c), F.lit(left_out), *bytes_))
    return classes.select("id", F.posexplode(F.array(*keys)).alias("number", "key"))


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and grams, the sorted shingle hashes, of the documents with these ids."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                grams, offsets = shingles(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([grams[i:j].tobytes() for i, j in zip(offsets, offsets[1:])], pa.binary())],
                    ["id", "grams"],
                )

    asked = docs.select("doc_id", "text").join(ids.toDF("doc_id"), "doc_id", "left_semi")
    return written(asked.mapInArrow(sets, "id long, grams binary"), "sets", batch=BATCH)


def _confirm(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of document ids whose full sets are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                ok.append(_similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long").distinct()


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose signatures differ in few values; adds the number of errors."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, VALUES) for c in ("x", "y"))
        errors = (x != y).sum(axis=1)
        out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(errors, pa.int64())], ["a", "b", "errors"])
        yield out.filter(pa.array(errors <= MOST_ERRORS))


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs across components within each tile, packed by the two blocks they lie in; a tile's rows are few."""

    def pairs(tile):
        _, number, side, ids, group, block, values = tile
        a, b = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
        for i in a:  # side 1: a tile against itself
            near = b[(group[b] != group[i]) & ((ids[b] > ids[i]) | (side[b] == 2))]
            near = near[(values[near] != values[i]).sum(axis=1) <= MOST_ERRORS]
            near = near[_first_bucket(values[near] == values[i]) == number[0]]  # a pair counts in one of its buckets
            if len(near):
                swap = block[near] < block[i]
                yield (np.where(swap, block[near], block[i]), np.where(swap, block[i], block[near]),
                       np.where(swap, ids[near], ids[i]), np.where(swap, ids[i], ids[near]))

    for tile in _groups(batches, ("key", "i", "j"), ("number", "side", "id", "component", "block"), _values):
        found = list(pairs(tile))
        if found:
            low, high, a, b = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((high, low))
            low, high, a, b = low[order], high[order], a[order], b[order]
            cuts = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            at = pa.array(np.r_[cuts, len(a)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(low[cuts]), pa.array(high[cuts]), pa.ListArray.from_arrays(at, pa.array(a)), pa.ListArray.from_arrays(at, pa.array(b))],
                ["low", "high", "a", "b"],
            )


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, VALUES)


def _groups(batches: Iterator[pa.RecordBatch], key: tuple, columns: tuple, more) -> Iterator[list[np.ndarray]]:
    """Arrays of each run of equal keys; rows come sorted by key, and a run may go on in the next batch."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in key], axis=1)
        arrays = [keys, *(batch.column(c).to_numpy() for c in columns), more(batch)]
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            if held and (held[0][0][0] != keys[lo]).any():
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            held.append([x[lo:hi] for x in arrays])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids that the packed pairs of two blocks name."""
    for batch in batches:
        rows = [(lo, hi, np.unique(np.r_[a.values.to_numpy(), b.values.to_numpy()])) for lo, hi, a, b in zip(*map(batch.column, ("low", "high", "a", "b")))]
        if rows:
            n = [len(x[2]) for x in rows]
            low, high = (pa.array(np.repeat(np.array([x[k].as_py() for x in rows], np.int64), n)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([low, high, pa.array(np.concatenate([x[2] for x in rows]))], ["low", "high", "id"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirms packed pairs: of two blocks first the sets come, then the pairs. What links before have joined is not looked at."""

    def at_end(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    now, sets, root = None, {}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x] = root[root[x]]
        return x

    for batch in batches:
        out = []
        for low, high, id_, grams, a, b in zip(*map(batch.column, ("low", "high", "id", "grams", "a", "b"))):
            if now != (low.as_py(), high.as_py()):
                now, sets, root = (low.as_py(), high.as_py()), {}, {}
            if grams.is_valid:
                sets.setdefault(id_.as_py(), []).append(np.frombuffer(grams.as_buffer(), np.uint64))  # a repeated id has several
                continue
            for u, v in zip(a.values.to_pylist(), b.values.to_pylist()):
                if (p := find(u)) != (q := find(v)) and any(_similar(x, y) for x in sets[u] for y in sets[v]):
                    root[p] = q
                    out.append((u, v))
        yield at_end(out)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    n = len(x) + len(y)
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (n - both)


def _first_bucket(equal: np.ndarray) -> np.ndarray:
    """The number of the first bucket in which two signatures meet, for rows of equal values."""
    chunks = equal.reshape(-1, VALUES // CHUNK, CHUNK)
    others = chunks.sum(axis=2, keepdims=True) - chunks  # equal ones besides the value left out
    return np.argmax((others == CHUNK - 1).reshape(-1, VALUES), axis=1)


def _across(buckets: DataFrame, classes: DataFrame, groups: DataFrame, stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between classes of different components, from all pairs that share a bucket and have near signatures.

    Buckets above the tile size are cut into tiles, and each two tiles meet in a task of their own. Classes of one leader form
    blocks of bounded size; pairs travel packed by the two blocks they lie in, and each block's sets are sent once for them.
    """
    below = stars.where("leader < id").groupBy("id").agg(F.min("leader").alias("family"))
    member = classes.join(groups, "id", "left").join(below, "id", "left").select(
        "id", "signature", "n_shingles", F.coalesce("component", "id").alias("component"), F.coalesce("family", "id").alias("family")
    )
    families = member.groupBy("family").agg(F.ceil(F.sum("n_shingles") / BLOCK).alias("blocks"))
    block = F.xxhash64("family", F.pmod(F.xxhash64("id"), F.col("blocks")))
    member = member.join(families, "family").select("id", "signature", "component", block.alias("block"))
    rows = buckets.join(member, "id")
    mixed = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = mixed.where("low <> high").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    rows = rows.join(mixed, "key").withColumn("t", tile).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select(
        "key", "number", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "id", "component", "block", "signature",
        F.when(F.col("t") == F.col("o"), 1).when(F.col("t") < F.col("o"), 0).otherwise(2).alias("side"),
    )
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    packed = written(rows.mapInArrow(_tile_pairs, "low long, high long, a array<long>, b array<long>"), "pairs")
    asked = packed.mapInArrow(_asked, "low long, high long, id long").distinct().join(sets, "id")
    none = F.lit(None)
    both = asked.select("low", "high", "id", "grams", none.cast("array<long>").alias("a"), none.cast("array<long>").alias("b")).unionByName(
        packed.select("low", "high", none.cast("long").alias("id"), none.cast("binary").alias("grams"), "a", "b")
    )
    both = both.repartition("low", "high").sortWithinPartitions("low", "high", F.col("grams").isNull())
    return both.mapInArrow(_linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text; others are ignored).

    component_id is the smallest doc_id that links of similarity 0.75 or more reach. Null and empty texts and texts
    of white space have empty sets and link with nothing. Rows that repeat a doc_id are one node; each gets its row. A null
    doc_id can't be named in a link: its row gets a null component and is kept.
    """
    sets = written(signatures(docs), "signatures", batch=BATCH)
    named = sets.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"))
    classes = written(classes, "classes")
    ids = classes.groupBy("id").agg(F.first("signature").alias("signature"))  # a repeated doc_id may have two texts
    buckets = _buckets(classes)
    leaders = buckets.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    shared = written(buckets.join(leaders, "key"), "buckets")  # a bucket of one class has no pair
    stars = shared.select("id", F.explode(F.array("low", "high")).alias("leader")).where("id <> leader")
    stars = stars.groupBy("id", "leader").agg(F.count("*").alias("n"))
    best = F.max_by(F.col("leader"), F.struct("n", F.col("leader").alias("l")))  # with it a class shares most buckets
    chosen = stars.groupBy("id", (F.col("leader") < F.col("id")).alias("below")).agg(best.alias("leader"))
    chosen = written(chosen, "stars")
    stars = chosen.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    near = (
        stars.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").select("a", "b", "x", "y")
        .mapInArrow(_near, "a long, b long, errors long")
    )
    sets_of = _sets(docs, shared.select("id").distinct())
    links = written(_confirm(sets_of, near.select("a", "b")), "confirmed", batch=BATCH)
    same = named.join(classes.select("h1", "h2", "n_shingles", "id"), ["h1", "h2", "n_shingles"])
    same = written(same.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct(), "copies")
    first = components(links.union(same))
    first = written(first, "components")
    late = written(_across(shared.select("key", "number", "id"), classes, first, chosen, sets_of), "confirmed", batch=BATCH)
    final = first if late.isEmpty() else components(first.toDF("a", "b").union(late))
    out = sets.join(final.toDF("doc_id", "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
