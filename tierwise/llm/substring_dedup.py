"""Removal of word passages that occur more than once, by hashes of windows that are grouped by their minimizers.

This replaces prefix-partitioned suffix trees: no tree is built and no group is a prefix of its suffixes. Only whole windows of
35 words are judged, so of a tree nothing but its nodes at that depth would be read, and a node there with two leaves
is a window hash that two windows share. Neighbouring repeated windows join to maximal repeats. Groups fit into memory:

* Anchor: the windows of up to 31 neighbouring places share an anchor, the smallest five-word hash within
  the window, which depends on the window's words only. Equal windows have equal anchors at equal places, so a group is
  what meets under one anchor. One record holds the hashes (nodes) of all
  windows of an anchor, and a group of one record holds no repeat and is passed over.
* Window: a group that grows beyond GROUP records is split by its whole windows, which are counted with partial sums.

Copies within a batch are found before the shuffle: of equal records one travels on, the others are repeats already. Windows are
told apart by the anchor's 64-bit hash together with the window's, of which all 64 bits travel; words are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwise.llm.shared import SPACE, byte_view, mix, parts, runs, word_bounds, word_hashes, written

WINDOW = 35
GRAM = 5
GROUP = 1 << 16  # records of a group that are held in memory
_SPAN, _DEFERRED, _RECORD = 1, 2, 0


def _smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """For each start the place of the leftmost smallest of width values."""
    n = len(grams) - width + 1
    best, at, size = grams, np.arange(len(grams)), 1

    def pick(shift: int, m: int):
        left = best[:m] <= best[shift : shift + m]
        return np.where(left, best[:m], best[shift : shift + m]), np.where(left, at[:m], at[shift : shift + m])

    while size * 2 <= width:
        best, at = pick(size, len(best) - size)
        size *= 2
    if size < width:
        best, at = pick(width - size, n)
    return at[:n]


def _records(part: pa.RecordBatch):
    """Arrays of this part's records: gram, row, first window's word number, windows; and all window hashes."""
    data, offsets = byte_view(part.column("text"))
    starts, ends, first = word_bounds(data, offsets, SPACE)
    words = word_hashes(data, starts, ends)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    windows = runs(words, WINDOW)
    good = np.flatnonzero(np.arange(len(windows)) + WINDOW <= first[1:][rows[: len(windows)]])
    if not len(good):
        return None
    grams = runs(words, GRAM)
    anchor = _smallest(grams, WINDOW - GRAM + 1)[good]
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1] + 1)])
    at = good[cut]
    return grams[anchor[cut]], rows[at], at - first[rows[at]], np.diff(np.r_[cut, len(good)]), windows[good]


_OUT = ["kind", "gram", "doc_id", "text_key", "start", "stop", "nodes"]
_SCHEMA = "kind byte, gram long, doc_id long, text_key int, start int, stop int, nodes binary"


def _out(kind, gram, doc_id, text_key, start, stop, nodes=None) -> pa.RecordBatch:
    n = len(gram)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, kind, np.int8)), pa.array(np.asarray(gram).view(np.int64)), pa.array(doc_id, pa.int64()),
            pa.array(text_key, pa.int32()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()),
            pa.nulls(n, pa.binary()) if nodes is None else nodes,
        ],
        _OUT,
    )


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records to group, once per batch, and the spans of those that a batch holds twice."""
    for batch in batches:
        found, base = [], 0
        for part in parts(batch):
            if (x := _records(part)) is not None:
                found.append((x[0], x[1] + base, *x[2:]))
            base += part.num_rows
        if not found:
            continue
        gram, row, start, count, windows = (np.concatenate(x) for x in zip(*found))
        upto = np.cumsum(count)
        whole = np.add.reduceat(_placed(windows, upto - count, count), upto - count)
        order = np.lexsort((whole, gram))
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (gram[order][1:] == gram[order][:-1]) & (whole[order][1:] == whole[order][:-1])
        twice, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
        twice[order] = same[:-1] | same[1:]
        later[order] = same[:-1]
        ids = batch.column("doc_id")
        keys = batch.column("text_key").to_numpy()
        take = np.flatnonzero(twice)
        if len(take):
            spread = mix(keys[row[take]].astype(np.uint64), start[take].astype(np.uint64))  # no group: dealt evenly
            yield _out(_SPAN, spread, ids.take(pa.array(row[take])), keys[row[take]], start[take], start[take] + count[take] - 1 + WINDOW)
        take = np.flatnonzero(~later)
        nodes = windows[np.repeat(~later, count)]
        ends = np.r_[0, np.cumsum(count[take]) * 8].astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(take), [None, pa.py_buffer(ends), pa.py_buffer(nodes)])
        yield _out(_RECORD, gram[take], ids.take(pa.array(row[take])), keys[row[take]], start[take], start[take], blobs)


def _placed(windows: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Window hashes mixed with their place in the record, so that their sum tells records apart."""
    return mix(windows, (np.arange(len(windows)) - np.repeat(first, count)).astype(np.uint64))


def _nodes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of records: each window's node, the record it belongs to, and its place in it."""
    column = batch.column("nodes")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
    count = np.diff(offsets) // 8
    record = np.repeat(np.arange(len(count)), count)
    return raw, record, np.arange(len(raw)) - np.repeat(np.cumsum(count) - count, count)


def _subtrees(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of each group as spans; the rows come sorted by gram. Groups that grow too large are deferred."""
    held: list[pa.RecordBatch] = []
    deferred = None  # the gram of a group too large to hold

    def later(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.set_column(0, "kind", pa.array(np.full(batch.num_rows, _DEFERRED, np.int8)))

    def solve(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        gram = batch.column("gram").to_numpy()
        alike = np.zeros(len(gram) + 1, bool)
        alike[1:-1] = gram[1:] == gram[:-1]
        batch = batch.filter(pa.array(alike[1:] | alike[:-1]))  # others have one leaf
        if not batch.num_rows:
            return
        gram = batch.column("gram").to_numpy()
        node, record, place = _nodes(batch)
        order = np.lexsort((node, gram[record]))
        n, g = node[order], gram[record][order]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (n[1:] == n[:-1]) & (g[1:] == g[:-1])
        deep = np.zeros(len(order), bool)
        deep[order] = same[1:] | same[:-1]
        record, place = record[deep], place[deep]
        if not len(record):
            return
        new = np.r_[True, (record[1:] != record[:-1]) | (place[1:] != place[:-1] + 1)]
        at = np.flatnonzero(new)
        long = np.diff(np.r_[at, len(record)])
        rows = batch.take(pa.array(record[at]))
        start = rows.column("start").to_numpy() + place[at]
        yield _out(_SPAN, rows.column("gram").to_numpy(), rows.column("doc_id"), rows.column("text_key"), start, start + long - 1 + WINDOW)

    for batch in batches:
        spans = batch.column("kind").to_numpy() == _SPAN
        if spans.any():
            yield batch.filter(pa.array(spans))
            batch = batch.filter(pa.array(~spans))
        if not batch.num_rows:
            continue
        gram = batch.column("gram").to_numpy()
        if deferred is not None:
            n = int(np.searchsorted(gram, deferred, "right"))
            if n:
                yield later(batch.slice(0, n))
                batch, gram = batch.slice(n), gram[n:]
            if not batch.num_rows:
                continue
            deferred = None
        tail = int(np.searchsorted(gram, gram[-1], "left"))  # the last group may go on in the next batch
        if held and held[0].column("gram")[0].as_py() != int(gram[-1]):
            whole = pa.concat_batches([*held, batch.slice(0, tail)]) if tail else pa.concat_batches(held)
            yield from solve(whole)
            held = []
        elif tail:
            yield from solve(batch.slice(0, tail))
        held.append(batch.slice(tail))
        if sum(x.num_rows for x in held) > most:
            deferred = int(gram[-1])
            yield from map(later, held)
            held = []
    if held:
        yield from solve(pa.concat_batches(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window of the records."""
    for batch in batches:
        node, record, place = _nodes(batch)
        rows = batch.take(pa.array(record))
        yield pa.RecordBatch.from_arrays(
            [rows.column("gram"), pa.array(node.view(np.int64)), rows.column("doc_id"), rows.column("text_key"),
             pa.array((rows.column("start").to_numpy() + place).astype(np.int32))],
            ["gram", "node", "doc_id", "text_key", "start"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    """Repeated ids are told apart by their texts."""
    return docs.select("doc_id", "text", F.hash("text").alias("text_key"))


def repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, text_key and spans: word ranges [start, stop) of each text that repeated windows cover."""
    records = _keyed(docs).mapInArrow(_anchored, _SCHEMA).repartition("gram").sortWithinPartitions("gram")
    found = written(records.mapInArrow(lambda x: _subtrees(x, group), _SCHEMA), "repeats")
    windows = found.where(F.col("kind") == _DEFERRED).mapInArrow(
        _windows, "gram long, node long, doc_id long, text_key int, start int"
    )
    again = windows.groupBy("gram", "node").agg(F.count("*").alias("n")).where("n > 1").select("gram", "node")
    more = windows.join(again, ["gram", "node"]).select("doc_id", "text_key", "start", (F.col("start") + WINDOW).alias("stop"))
    spans = found.where(F.col("kind") == _SPAN).select("doc_id", "text_key", "start", "stop").union(more)
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n_words, n_removed = [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            words = (text or b"").split()  # of bytes: at blank and 9 to 13
            n_words.append(len(words))
            if spans:
                left, at = [], 0
                for start, stop in sorted((s["start"], s["stop"]) for s in spans):
                    left += words[at : max(at, start)]
                    at = max(at, stop)
                words = left + words[at:]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["row", "n_words", "n_removed", "kept_text"],
        )


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """row (a struct of the columns of docs but text), n_words, n_removed and kept_text for every row of docs.

    kept_text has the kept words joined by one blank. A word goes if a window of 35 words over it starts at another place
    too, in any row, its own included. Rows that repeat both id and text are places of their own, so their windows go
    from all of them. Null and empty texts have no words and an empty kept_text; texts of fewer than 35 words have no
    window. A null doc_id is an id like others. Other columns of docs, whatever their names, are carried in row.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*others).alias("row"), "text", "doc_id", F.hash("text").alias("text_key"))
    spans = repeats(docs, group).toDF("id", "key", "spans")
    joined = keyed.join(spans, keyed.doc_id.eqNullSafe(spans.id) & (keyed.text_key == spans.key), "left").select("row", "text", "spans")
    return joined.mapInArrow(_cut, f"row {joined.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept_text string")
