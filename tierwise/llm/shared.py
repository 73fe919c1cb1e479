"""What several document operators use: tables, written steps, and words of Arrow texts as numpy arrays."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tierwise.llm.files import folder
from tierwise.sources.store import shared_dir

#: White space of the contracts: blank and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R1, _R2, _R3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_32, _29, _31 = np.uint64(32), np.uint64(29), np.uint64(31)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)


_READY: set[str] = set()
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers can import this package.

    Where it is neither installed nor on their path, Spark ships it to them once an application.
    """
    context = spark.sparkContext
    if context.applicationId not in _READY:

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import importlib.util

            known = importlib.util.find_spec("tierwise") is not None
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([known] * batch.num_rows, pa.bool_())], ["known"])

        if not spark.range(1).mapInArrow(found, "known boolean").first().known:
            package = Path(__file__).resolve().parents[1]
            made = tempfile.mkdtemp(prefix="tierwise-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            with zipfile.ZipFile(f"{made}/tierwise.zip", "w", zipfile.ZIP_DEFLATED) as out:
                for file in sorted(package.rglob("*.py")):
                    out.write(file, file.relative_to(package.parent))
            context.addPyFile(out.filename)  # Spark's driver serves it to the executors
        _READY.add(context.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark)}/tierwise-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, release: bool = False, batch: int | None = None, **options: str) -> DataFrame:
    """df as a written table, options as Spark's writer takes them: cuts the lineage, and a lost executor costs a re-read.

    With release, the shuffles of df go when the table is there. Whoever uses df itself again has them made anew. batch is the most rows
    of an Arrow batch meanwhile, for rows that are large.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    meanwhile = {_RELEASE: str(release).lower()} | ({_ROWS: str(batch)} if batch else {})
    before = {key: spark.conf.get(key, None) for key in meanwhile}
    try:
        for key, value in meanwhile.items():
            spark.conf.set(key, value)
        df.write.options(**options).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes a table that `written` made and nothing reads any more. Where Arrow doesn't know the kind of folder, it stays."""
    for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
        try:
            system, base = folder(path)
        except pa.ArrowInvalid:
            continue
        system.delete_dir(base)


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of each ordered pair."""
    x = (b ^ (b >> _31)) * _R2
    x = x + a * _R1
    x ^= x >> _29
    x *= _R3
    x ^= x >> _32
    return x


def texts(column: pa.Array) -> pa.Array:
    """Null texts become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def parts(batch: pa.RecordBatch, column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about so many bytes of text each, so arrays over words stay small."""
    offsets = np.frombuffer(texts(batch.column(column)).buffers()[1], np.int64)[: batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets into them."""
    column = texts(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def from_zero(column: pa.Array) -> pa.Array:
    """The texts as an array whose offsets start at 0, as Arrow's ascii kernels need them; those of a slice don't."""
    data, offsets = byte_view(column)
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def word_bounds(data: np.ndarray, offsets: np.ndarray, delimiter: np.ndarray):
    """Starts and ends of words, and the n + 1 word numbers where texts begin."""
    inside = ~delimiter[data]
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    before[offsets] = False  # the byte before a text's first belongs to another text
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, byte by byte over all words that are long enough."""
    sizes = ends - starts
    out = sizes.astype(np.uint64) * _R3
    order = np.argsort(-sizes, kind="stable") if len(sizes) else np.zeros(0, np.int64)
    at, h = starts[order], out[order]
    longer = np.searchsorted(-sizes[order], -np.arange(1, min(int(sizes.max(initial=0)), 48) + 1), "right")
    for j, n in enumerate(longer):
        x = h[:n]
        x ^= _BYTE[data[at[:n] + j]]
        x *= _R1
        x ^= x >> _32
    for i in np.flatnonzero(sizes[order] > 48):  # very long words are rare
        x = h[i : i + 1]
        tail = data[at[i] + 48 : ends[order[i]]]
        block = np.frombuffer(tail.tobytes() + bytes(-len(tail) % 8), np.uint64)
        # a sum of values mixed with their places keeps one long word a vector operation
        x[:] = mix(x, np.array([mix(block, np.arange(len(block), dtype=np.uint64)).sum(dtype=np.uint64)]))
    out[order] = h
    return out


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values; shorter input gives none. Ranges double, the last two overlap."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size, h = 1, hashes
    while size * 2 <= k:
        h = mix(h[: len(h) - size], h[size:])
        size *= 2
    if size < k:
        h = mix(h[:n], h[k - size : k - size + n])
    return mix(h[:n], np.array([k], np.uint64))
