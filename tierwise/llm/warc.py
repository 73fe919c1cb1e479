"""Deterministic sharded WARC files.

Pages are range-sorted by page_id; each task writes its range as files of gzip members, one a record, and starts a new file once
the compressed size is reached. Headers and digests are made from the rows, dates from a parameter, so equal tables
in equal layout give equal bytes. Tasks write under temporary names and report them; a second job moves the reported files to
their last names, and the manifest is written after that: what it lists is complete.

A payload that an earlier page has is written as a revisit: the HTTP headers without the body, and a reference to that page.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.llm.files import commit, made, put
from tierwise.llm.shared import scratch, written

FILE_BYTES = 16 << 20  # compressed size from which a file is closed
LEAST_REVISIT = 0  # bytes of payload from which equal ones are revisits
STEP = 1 << 14
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None, turn: int) -> str:
    """The name of the turn-th row of a page_id."""
    return f"<urn:x-page:{'null' if page_id is None else page_id}{f':{turn}' if turn else ''}>"


def record(page_id: int | None, turn: int, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record; with refers_to a revisit of that page."""
    digest = _sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:x-page:no-url")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, turn)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to, 0)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _rows(pages: DataFrame, least: int) -> DataFrame:
    """The pages, and before them a row with the first page of their payload where several have it; sorted by page."""
    body = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", body.alias("html"), F.sha2(body, 256).alias("key"))
    ids = keyed.where(F.octet_length("html") >= least).select("page_id", "key")
    first = ids.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    marks = ids.join(first, "key").select("page_id", "key", "first").distinct()
    none = F.lit(None)
    rows = keyed.select("page_id", "key", F.lit(1).alias("kind"), "url", "html", none.cast("long").alias("first")).unionByName(
        marks.select("page_id", "key", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("string").alias("html"), "first")
    )
    return rows.repartitionByRange("page_id").sortWithinPartitions("page_id", "key", "kind", "url")


def write(pages: DataFrame, date: str = DATE, file_bytes: int = FILE_BYTES, least: int = LEAST_REVISIT) -> tuple[str, DataFrame]:
    """Writes pages (page_id, url, html); gives the folder and the manifest (file, records, bytes, sha1).

    A null html is an empty payload, a null url a placeholder URI; control characters and blanks in a URL are escaped.
    Of equal payloads of at least so many bytes the page of smallest page_id is the response; rows that repeat page_id and payload
    revisit it too. Rows with a null page_id come first, and revisit only pages that have an id. Without pages
    there is no file.
    """
    folder = made(scratch(pages.sparkSession, "warc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        members: list[bytes] = []
        size = turn = 0
        last = mark = done = object()

        def close():
            nonlocal members, size, number
            if members:
                name, data = f"part-{shard:06d}-{number:06d}.warc.gz", b"".join(members)
                yield pa.RecordBatch.from_pylist(
                    [{"file": name, "written": put(folder, name, data), "records": len(members), "bytes": size, "sha1": _sha1(data)}]
                )
                members, size, number = [], 0, number + 1

        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for page_id, key, kind, url, html, first in zip(*(part.column(i).to_pylist() for i in range(6))):
                    if not kind:
                        mark = (page_id, key, first)
                        continue
                    turn = turn + 1 if last == (page_id,) else 0
                    last = (page_id,)
                    refers_to = mark[2] if isinstance(mark, tuple) and mark[:2] == (page_id, key) else None
                    if refers_to == page_id and done != (page_id, key):
                        refers_to, done = None, (page_id, key)
                    data = record(page_id, turn, url, html.encode(), refers_to, date)
                    members.append(gzip.compress(data, 6, mtime=0))
                    size += len(members[-1])
                    if size >= file_bytes:
                        yield from close()
        yield from close()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name in zip(batch.column("written").to_pylist(), batch.column("file").to_pylist()):
                commit(folder, path, name)
            yield batch.drop_columns(["written"])

    schema = "file string, {}records long, bytes long, sha1 string"
    found = written(_rows(pages, least).mapInArrow(run, schema.format("written string, ")), "warc-written")
    return folder, written(found.mapInArrow(move, schema.format("")), "warc-manifest")


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    return {k: v for k, _, v in (x.partition(": ") for x in lines)}, rest


def _page(name: str) -> int | None:
    found = name.removeprefix("<urn:x-page:").removesuffix(">").split(":")[0]
    return None if found == "null" else int(found)


_READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every record of the files that the manifest lists.

    payload_bytes and payload_digest are those of the full payload: computed for responses and compared with their
    headers, for revisits from their headers. A damaged or missing file raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _READ.split(", ")]
        for batch in batches:
            for name, content, sha1 in zip(*(batch.column(c) for c in ("file", "content", "sha1"))):
                content = content.as_buffer() if content.is_valid else None
                if content is None or _sha1(content) != sha1.as_py():
                    raise ValueError(f"{name} is not what the manifest lists")
                view, at, out = memoryview(content), 0, []
                while at < len(view):
                    member, pieces = zlib.decompressobj(31), []
                    while not member.eof:  # in steps, as what is left over is copied
                        if at >= len(view):
                            raise ValueError(f"{name}: a record is cut off")
                        pieces.append(member.decompress(view[at : at + STEP]))
                        at = min(at + STEP, len(view)) - len(member.unused_data)
                    data = b"".join(pieces)
                    head, rest = _headers(data)
                    block = rest[: int(head["Content-Length"])]
                    http, payload = _headers(block)
                    size, digest = int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Block-Digest"] != f"sha1:{_sha1(block)}":
                        raise ValueError(f"{name}: a block is damaged")
                    response = head["WARC-Type"] == "response"
                    if response and (len(payload), _sha1(payload)) != (size, digest):
                        raise ValueError(f"{name}: a payload is damaged")
                    refers_to = None if response else _page(head["WARC-Refers-To"])
                    out.append((_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], refers_to, size, digest,
                                payload.decode() if response else None))
                    if len(out) >= 512:
                        yield _batch(out, names)
                        out = []
                yield _batch(out, names)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = files.option("pathGlobFilter", "*.warc.gz").load(folder)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return manifest.select("file", "sha1").join(found, "file", "left").select("file", "content", "sha1").mapInArrow(run, _READ)


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
