"""Hard negatives by vertical scans with bounds (BOND): rows of another label whose score lies in a window below a positive's.

Vectors are stored in blocks of columns: of each dimension all values of the block lie together, beside their least and largest
one. For an anchor the dimensions are read in the order of its own descending magnitude. What the unread dimensions can still
add, at least and at most, bounds each row's score; rows whose bounds miss the wanted scores leave the candidate bitmap, the
scores of the others become exact when the last dimension is read. A block whose bounds miss them is skipped unread.

Anchors go to the tasks a block of ANCHOR_VALUES components at a time, each block against all rows: once for the positives,
whose threshold rises as a task finds better ones, once for the windows. A task keeps the best rows of each window; a window
function merges those of the tasks. Blocks of rows are dealt by ranges of (label, vec_id), so a frequent label lies in many.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part. Vectors of different
lengths are multiplied over the shorter one; an empty vector has score 0 with all. Rows that repeat a vec_id are rows of
their own, "other" is another row. A null vec_id comes last in ties and is no anchor (the id 2**63 - 1 means the same).
Anchors without positives or negatives give no rows. Components beyond 2**31 or scores beyond 2**53 stop the job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.llm.shared import scratch, written
from tierwise.operators.order import numbered

BLOCK_VALUES = 1 << 20  # components of a block of rows
ANCHOR_VALUES = 1 << 21  # components of the anchors that the tasks hold at once
STEP = 8  # dimensions read between two looks at the bounds
NAMELESS = (1 << 63) - 1
_NONE = -(1 << 62)  # no score yet

_BLOCK = "block long, dims int, n int, ids binary, labels binary, anchors binary, columns binary, least binary, largest binary"


def _packed(scale: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 33
        for batch in batches:
            vectors = batch.column("embedding")
            values = np.floor(pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
            sizes = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            labels = batch.column("label").cast(pa.int64())
            starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
            odd = np.r_[0, np.cumsum(~np.isfinite(values))]  # a null component has become NaN
            whole = (sizes >= 0) & (odd[starts + np.maximum(sizes, 0)] == odd[starts]) & ~np.asarray(labels.is_null())
            ids = batch.column("vec_id").cast(pa.int64()).fill_null(NAMELESS).to_numpy()
            labels = labels.fill_null(0).to_numpy()
            anchors = batch.column("is_anchor").fill_null(False).to_numpy(zero_copy_only=False) & (ids != NAMELESS)
            for dims in np.unique(sizes[whole]):
                rows = np.flatnonzero(whole & (sizes == dims))
                most = max(1, BLOCK_VALUES // max(1, int(dims)))
                for at in range(0, len(rows), most):
                    some = rows[at : at + most]
                    columns = values[starts[some] + np.arange(dims)[:, None]]
                    if columns.size and np.abs(columns).max() >= 1 << 31:
                        raise OverflowError("a component is beyond 2**31")
                    columns = columns.astype("<i4")
                    held = (
                        ids[some].tobytes(), labels[some].tobytes(), anchors[some].tobytes(), columns.tobytes(),
                        columns.min(axis=1).tobytes(), columns.max(axis=1).tobytes(),
                    )
                    names = [x.split()[0] for x in _BLOCK.split(", ")]
                    numbers = [pa.array([made]), pa.array([dims], pa.int32()), pa.array([len(some)], pa.int32())]
                    yield pa.RecordBatch.from_arrays(numbers + [pa.array([x], pa.binary()) for x in held], names)
                    made += 1

    return pack


def blocks(vectors: DataFrame, anchor: Column, scale: int = 256) -> DataFrame:
    """The written blocks of (vec_id, label, embedding); each component x becomes floor(scale * x)."""
    rows = vectors.select("vec_id", "label", "embedding", anchor.alias("is_anchor")).where("label is not null and embedding is not null")
    dealt = rows.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id")
    return written(dealt.mapInArrow(_packed(scale), _BLOCK), "vectors")


class Block:
    """A block of rows, by columns."""

    def __init__(self, row: dict):
        n, dims = row["n"], row["dims"]
        self.number, self.n, self.dims = row["block"], n, dims
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.anchors = np.frombuffer(row["anchors"], bool)
        self.columns = np.frombuffer(row["columns"], "<i4").reshape(dims, n)
        self.least, self.largest = (np.frombuffer(row[x], "<i4").astype(np.float64) for x in ("least", "largest"))
        self.most = float(np.abs(self.columns).max(initial=0))

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch]) -> Iterator["Block"]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield cls(batch.slice(i, 1).to_pylist()[0])

    def scores(self, anchor: np.ndarray, low: float, high: float, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of those rows of the bitmap `alive` whose score is in [low, high]."""
        dims = min(len(anchor), self.dims)
        order = np.argsort(-np.abs(anchor[:dims]), kind="stable")
        a = anchor[order].astype(np.float64)
        if np.abs(a).sum() * self.most >= 1 << 53:
            raise OverflowError("a score is beyond 2**53")
        ends = np.stack([a * self.least[order], a * self.largest[order]])
        # what the dimensions from the k-th on can add, at least and at most
        add_least = np.r_[np.cumsum(ends.min(axis=0)[::-1])[::-1], 0.0]
        add_most = np.r_[np.cumsum(ends.max(axis=0)[::-1])[::-1], 0.0]
        places, sums = np.flatnonzero(alive), None
        if add_most[0] < low or add_least[0] > high or not len(places):
            return places[:0], np.zeros(0, np.int64)
        sums = np.zeros(len(places))
        for k in range(0, dims, STEP):
            read = order[k : k + STEP]
            held = self.columns[read] if len(places) == self.n else self.columns[read[:, None], places]
            sums += a[k : k + STEP] @ held
            to = min(k + STEP, dims)
            can = (sums + add_most[to] >= low) & (sums + add_least[to] <= high)
            if not can.all():
                places, sums = places[can], sums[can]
                if not len(places):
                    break
        if not dims:
            can = (sums >= low) & (sums <= high)
            places, sums = places[can], sums[can]
        return places, sums.astype(np.int64)


class Best:
    """The best rows of each (anchor, window): highest score first, then smallest id."""

    def __init__(self, anchors: int, windows: int, keep: int):
        self.scores = np.full((anchors, windows, keep), _NONE, np.int64)
        self.ids = np.full((anchors, windows, keep), NAMELESS, np.int64)

    def add(self, anchor: int, window: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = self.scores.shape[2]
        if len(scores) > 4 * keep:  # what is below the keep-th score can't stay; ties with it can
            edge = np.partition(scores, len(scores) - keep)[len(scores) - keep]
            scores, ids = scores[scores >= edge], ids[scores >= edge]
        scores, ids = np.r_[self.scores[anchor, window], scores], np.r_[self.ids[anchor, window], ids]
        order = np.lexsort((ids, -scores))[:keep]
        self.scores[anchor, window], self.ids[anchor, window] = scores[order], ids[order]

    def rows(self, numbers: np.ndarray) -> pa.RecordBatch:
        a, w, k = np.nonzero(self.scores != _NONE)
        columns = [numbers[a], w, self.ids[a, w, k], self.scores[a, w, k]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "window", "id", "score"])


_FOUND = "anchor long, window long, id long, score long"


class Anchors:
    """Some anchors as the tasks hold them; windows are the allowed scores of each anchor's negatives."""

    def __init__(self, rows: list):
        self.numbers = np.array([r.position for r in rows], np.int64)
        self.labels = [r.label for r in rows]
        self.at = [(r.block, r.place) for r in rows]
        self.vectors = [np.frombuffer(r.vector, "<i4") for r in rows]
        self.windows: list[list[tuple[int, int]]] = [[] for _ in rows]

    def positives(self, keep: int):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(self.labels), 1, keep)
            for block in Block.of(batches):
                alike = {label: block.labels == label for label in np.unique(block.labels).tolist()}
                for i, label in enumerate(self.labels):
                    if label not in alike:
                        continue
                    alive = alike[label]
                    number, place = self.at[i]
                    if number == block.number:
                        alive = alive.copy()
                        alive[place] = False
                    places, scores = block.scores(self.vectors[i], best.scores[i, 0, -1], np.inf, alive)
                    if len(places):
                        best.add(i, 0, scores, block.ids[places])
            yield best.rows(self.numbers)

        return search

    def negatives(self, keep: int):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(self.labels), max(map(len, self.windows), default=0) or 1, keep)
            for block in Block.of(batches):
                unlike = {label: block.labels != label for label in set(self.labels)}
                for i, windows in enumerate(self.windows):
                    # scores below a window's keep-th best of this task can't be among its best of all
                    open_ = [(max(low, int(best.scores[i, w, -1])), high, w) for w, (low, high) in enumerate(windows)]
                    open_ = [x for x in open_ if x[0] <= x[1]]
                    if not open_:
                        continue
                    low, high = min(x[0] for x in open_), max(x[1] for x in open_)
                    places, scores = block.scores(self.vectors[i], low, high, unlike[self.labels[i]])
                    if len(places):
                        ids = block.ids[places]
                        for low, high, w in open_:
                            if (inside := (scores >= low) & (scores <= high)).any():
                                best.add(i, w, scores[inside], ids[inside])
            yield best.rows(self.numbers)

        return search


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in Block.of(batches):
        at = np.flatnonzero(block.anchors)
        columns = [
            pa.array(np.full(len(at), block.number)), pa.array(at), pa.array(block.ids[at]), pa.array(block.labels[at]),
            pa.array([block.columns[:, i].tobytes() for i in at], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["block", "place", "anchor_id", "label", "vector"])


def _merged(found: DataFrame, keep: int) -> DataFrame:
    """The best of what the tasks have found, with their rank."""
    order = W.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors has vec_id, label and embedding; `anchor` tells which rows are anchors. An anchor's positives are its best other rows of the
    same label. For each of them the negatives are the best rows of another label with scores from low to high percent of
    the positive's.
    """
    spark = vectors.sparkSession
    stored = blocks(vectors, anchor, scale)
    anchors = stored.mapInArrow(_anchor_rows, "block long, place long, anchor_id long, label long, vector binary")
    anchors = numbered(anchors, F.col("block"), F.col("place"))
    n, size = anchors.agg(F.count(F.lit(1)), F.max(F.length("vector"))).first()
    at_once = max(1, ANCHOR_VALUES * 4 // max(1, size or 0))
    at_once = min(at_once, ANCHOR_VALUES >> 6)  # what is kept of each anchor is about 64 numbers a vector at least
    path = scratch(spark, "negatives")
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], kinds).write.parquet(path)
    for first in range(1, n + 1, at_once):
        some = anchors.where(F.col("position").between(first, first + at_once - 1))
        held = Anchors(some.collect())  # at most ANCHOR_VALUES components
        near = written(_merged(stored.mapInArrow(held.positives(positives), _FOUND), positives), "positives")
        place = {number: i for i, number in enumerate(held.numbers.tolist())}
        for r in near.orderBy("anchor", "rank").collect():  # at most `positives` of each of these anchors
            held.windows[place[r.anchor]].append((-(-low * r.score // 100), high * r.score // 100))
        found = _merged(stored.mapInArrow(held.negatives(negatives), _FOUND), negatives).withColumnRenamed("id", "negative_id")
        own = near.select("anchor", (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        named = found.join(own, ["anchor", "window"]).join(some.select(F.col("position").alias("anchor"), "anchor_id"), "anchor")
        nameless = F.lit(NAMELESS)
        named.select(
            "anchor_id", F.nullif("positive_id", nameless).alias("positive_id"), "rank", F.nullif("negative_id", nameless).alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(path)
    return spark.read.schema(kinds).parquet(path)
