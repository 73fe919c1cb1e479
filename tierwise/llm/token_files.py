"""Token ids in files: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

Every id is replaced by its rank in the order of frequency over all documents, so the frequent half of a text takes a byte an id.
A rank takes 1 to 4 bytes, little-endian; the lengths of four ranks share one control byte, and control bytes and data bytes are
kept apart, so a decoder looks all lengths up in a table of 256 rows and gathers the values at once.

A file is a sequence of blocks. A block: "TWV1", then as unsigned little-endian integers the numbers of documents, ids and data
bytes (32 bits each) and the ids before the block in the whole corpus (64 bits); for each document its id (64 bits, signed), a
null mark (8 bits) and its number of ids (32 bits); the control bytes; the data bytes. ranks.bin lists the ids by
rank (32 bits each). Blocks are in ascending order of document, files in that of their names.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwise.llm.files import commit, made, put
from tierwise.llm.shared import LOWER, SPACE, byte_view, parts, scratch, word_bounds, written

END = 1  # the id after each document
FILE_BYTES = 16 << 20  # a file is closed once it has so many
BLOCK_IDS = 1 << 20
REMEMBERED = 300_000  # words in each generation
_HEAD = "<4sIIIQ"
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u4")])

#: Lengths of the four values of each control byte.
LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    sizes = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    four = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    four[: len(values)] = sizes - 1
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < sizes[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values behind control and data bytes."""
    sizes = LENGTHS[control].ravel()[:n]
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    padded = np.r_[data, np.zeros(3, np.uint8)]
    four = np.empty((n, 4), np.uint8)
    for i in range(4):
        four[:, i] = padded[starts + i]
    return four.view("<u4").ravel() & _MASKS[sizes]


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


#: ASCII letters and the bytes of accented Latin ones; ASCII punctuation but for the apostrophe and the low line.
_LETTER = _bytes((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xBF), (0xC3, 0xC3))
_MARK = _bytes((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x5E), (0x60, 0x60), (0x7B, 0x7E))
_LATIN_LEAD, _SIGNS = 0xC3, (0x97, 0xB7)  # the lead byte of accented Latin letters, and the two signs among them


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts' units, which the tokenizer encodes each by itself, and how many each text has.

    Texts fall apart at ASCII white space, which the tokenizer drops. A word of Latin letters with marks behind it is two units, the
    letters in lower case and the marks; any other word is one as it stands.
    """
    starts, ends, first = word_bounds(data, offsets, SPACE)
    letter, mark = _LETTER[data], _MARK[data]
    before = np.r_[np.uint8(0), data[:-1]]
    lead = before == _LATIN_LEAD
    odd = ~(letter | mark | SPACE[data])
    follows = (data >= 0x80) & (data < 0xC0)  # a second byte
    odd |= follows & (~lead | (data == _SIGNS[0]) | (data == _SIGNS[1]))
    after_mark = np.r_[False, mark[:-1]]
    odd |= letter & after_mark
    odd[starts] |= mark[starts]
    if len(starts):
        strange = np.logical_or.reduceat(odd, starts)
        edges = np.zeros(len(data) + 1, np.int8)
        edges[starts[strange]] += 1
        edges[ends[strange]] -= 1
        as_is = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
        cuts = np.flatnonzero(mark & ~after_mark & ~as_is)
        data = np.where(as_is, data, LOWER[data])
    else:
        cuts = starts
    starts, ends = np.sort(np.r_[starts, cuts]), np.sort(np.r_[ends, cuts])
    kept = np.repeat(starts - np.r_[0, np.cumsum(ends - starts)[:-1]], ends - starts) + np.arange((ends - starts).sum())
    bounds = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[kept])])
    return units, np.diff(np.searchsorted(starts, offsets))


class Words:
    """A tokenizer of a file whose texts fall apart at white space; ids of words are remembered."""

    _LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)  # as loaded: a special token's string in a text is that token
        self.size = self.tokenizer.get_vocab_size()
        self.ending = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.size)])
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _known(self, wanted: set[bytes]) -> list[bytes]:
        missing = []
        for x in wanted.difference(self.new):
            if x in self.old:
                self.new[x] = self.old[x]
            else:
                missing.append(x)
        return missing

    def _encode_units(self, units: list[bytes]) -> None:
        """Remembers the ids of units. Words of letters are encoded many at a time: each ends with an id that ends a word."""
        texts = [u.decode() for u in units]
        plain = [t for t in texts if self._LETTERS(t)]
        others = [t for t in texts if not self._LETTERS(t)]
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            (encoded,) = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(encoded.ids, "<i4")
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.ending[ids]) + 1) * 4).tolist()
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not end each word")
            self.new.update(zip([t.encode() for t in some], [raw[i:j] for i, j in zip([0, *ends], ends)]))
        for t, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            self.new[t.encode()] = array("i", e.ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts as 32-bit integers, END after each, and how many each has.

        The texts' bytes are cut into units, Arrow numbers the different ones, Python sees each of these once, and their
        ids are gathered by number.
        """
        units, per_text = cut(*byte_view(texts))
        found = units.dictionary_encode()
        wanted = found.dictionary.to_pylist()
        self._encode_units(self._known(set(wanted)))
        ids = [self.new[u] for u in wanted]
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        ids.append(np.array([END], "<i4").tobytes())
        ends = np.cumsum(per_text)
        numbers = np.insert(found.indices.to_numpy(), ends, len(ids) - 1)
        taken = pa.array(ids, pa.large_binary()).take(pa.array(numbers))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(numbers) + 1]
        bounds = offsets[np.r_[0, ends + np.arange(1, len(texts) + 1)]] // 4
        return np.frombuffer(taken.buffers()[2], "<i4")[: bounds[-1]], np.diff(bounds)


@lru_cache(maxsize=1)
def _words(vocabulary: str) -> Words:
    return Words(public_tokenizers.path(vocabulary))


_ENCODED = "shard int, place long, before long, doc_id long, n long, ids binary, counts binary"


def _encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Ids of each document, by shards in ascending order; the last row of a shard has its count of every id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _words(vocabulary)
        shard, place, before = TaskContext.get().partitionId(), 0, 0
        counts = np.zeros(max(w.size, END + 1), np.int64)
        names = [x.split()[0] for x in _ENCODED.split(", ")]

        def rows(doc_id, n, ids, counts):
            k = len(n)
            starts = before + np.cumsum(n) - n
            return pa.RecordBatch.from_arrays(
                [pa.array([shard] * k, pa.int32()), pa.array(range(place, place + k), pa.int64()), pa.array(starts, pa.int64()),
                 doc_id, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names)

        for batch in batches:
            for part in parts(batch):
                ids, n = w.encode(part.column("text"))
                counts += np.bincount(ids, minlength=len(counts))
                ids = ids.astype("<u4" if len(counts) > 1 << 16 else "<u2")
                ends = np.r_[0, np.cumsum(n)] * ids.itemsize
                small = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                yield rows(part.column("doc_id"), n, small, [None] * len(n))
                place, before = place + len(n), before + int(n.sum())
        if place:
            yield rows(pa.nulls(1, pa.int64()), np.zeros(1, np.int64), [None], [counts.tobytes()])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, _ENCODED)


def _ranks(encoded: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """The ids by frequency, ties by id, and the ids before each shard. The driver gets a sum a shard and one count an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                total = total + np.frombuffer(blob, np.int64)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["id", "n"])

    last = encoded.where("counts is not null")
    counts = last.select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = np.array([r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))], np.int64)
    shards = sorted((r.shard, r.before) for r in last.select("shard", "before").collect())  # its last row stands after all ids
    starts, at = {}, 0
    for shard, n in shards:
        starts[shard], at = at, at + n
    return order, starts


def write(docs: DataFrame, vocabulary: str) -> tuple[str, DataFrame]:
    """Writes the files of docs (doc_id, text); gives their folder and the manifest (file, first, documents, ids, bytes).

    Documents are in ascending doc_id, nulls first, rows that repeat an id by their texts. Null and empty texts
    have END only. Without rows there is no file.
    """
    folder = made(scratch(docs.sparkSession, "token-files"))
    compression = {"compression": "zstd"}
    path = scratch(docs.sparkSession, "ids")
    _encoded(docs, vocabulary).write.options(**compression).parquet(path)
    encoded = docs.sparkSession.read.schema(_ENCODED).parquet(path)
    order, starts = _ranks(encoded)
    rank_of = np.zeros(len(order), np.uint32)
    rank_of[order] = np.arange(len(order))
    width = "<u4" if len(order) > 1 << 16 else "<u2"

    def block(docs: list, ids: bytes, start: int) -> bytes:
        values = rank_of[np.frombuffer(ids, width)]
        control, data = pack(values)
        table = np.array([(0 if d is None else d, d is None, n) for d, n in docs], _DOC)
        return struct.pack(_HEAD, b"TWV1", len(docs), len(values), len(data), start) + table.tobytes() + control + data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[bytes] = []
        held: list = []
        ids: list[bytes] = []
        first = start = size = n_docs = n_ids = held_ids = 0
        shard, name = -1, ""

        def close_block():
            nonlocal held, ids, size, held_ids, n_ids
            if held:
                blocks.append(block(held, b"".join(ids), start))
                size += len(blocks[-1])
                n_ids += held_ids
            held, ids, held_ids = [], [], 0

        def close_file():
            nonlocal blocks, size, n_docs, n_ids
            close_block()
            if blocks:
                commit(folder, put(folder, name, b"".join(blocks)), name)
                yield pa.RecordBatch.from_pylist(
                    [{"file": name, "first": first, "documents": n_docs, "ids": n_ids, "bytes": size}]
                )
            blocks, size, n_docs, n_ids = [], 0, 0, 0

        for batch in batches:
            for s, place, before, doc_id, n, blob in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if s != shard or size >= FILE_BYTES:
                    yield from close_file()
                    shard, name, first = s, f"part-{s:06d}-{place:012d}.twv", starts[s] + before
                if not held:
                    start = starts[s] + before
                held.append((doc_id, n))
                ids.append(blob)
                held_ids += n
                n_docs += 1
                if held_ids >= BLOCK_IDS:
                    close_block()
        yield from close_file()

    rows = encoded.where("counts is null").select("shard", "place", "before", "doc_id", "n", "ids")
    manifest = written(rows.mapInArrow(run, "file string, first long, documents long, ids long, bytes long"), "manifest")
    name = "ranks.bin"

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                commit(folder, put(folder, name, order.astype("<u4").tobytes()), name)
            yield batch

    docs.sparkSession.range(1).mapInArrow(ranks, "id long").collect()
    return folder, manifest


def read(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers) of every document in the files of a folder.

    A folder without files of tokens gives no rows. Damaged files raise an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, listed in zip(batch.column("content"), batch.column("ranks")):
                order = np.frombuffer(listed.as_buffer(), "<u4")
                data, at = np.frombuffer(content.as_buffer(), np.uint8), 0
                while at < len(data):
                    mark, n_docs, n_ids, n_bytes, start = struct.unpack(_HEAD, data[at : at + struct.calcsize(_HEAD)].tobytes())
                    if mark != b"TWV1":
                        raise ValueError("not a file of tokens")
                    at += struct.calcsize(_HEAD)
                    docs = data[at : at + n_docs * _DOC.itemsize].view(_DOC)
                    at += docs.nbytes
                    n_control = -(-n_ids // 4)
                    control, at = data[at : at + n_control], at + n_control
                    values = order[unpack(control, data[at : at + n_bytes], n_ids)].astype("<u4")
                    at += n_bytes
                    ends = np.cumsum(docs["n"].astype(np.int64))
                    ids = pa.Array.from_buffers(
                        pa.binary(), n_docs, [None, pa.py_buffer(np.r_[0, ends * 4].astype(np.int32)), pa.py_buffer(values)]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs["doc_id"].astype(np.int64), mask=docs["null"].astype(bool)), pa.array(start + ends - docs["n"]),
                         pa.array(docs["n"].astype(np.int64)), ids],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    schema = "doc_id long, start long, n_tokens long, ids binary"
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = files.option("pathGlobFilter", "*.twv").load(folder).select("content")
    ranks = files.option("pathGlobFilter", "ranks.bin").load(folder).select(F.col("content").alias("ranks"))
    return found.join(F.broadcast(ranks)).mapInArrow(run, schema)  # one row, as long as the vocabulary
