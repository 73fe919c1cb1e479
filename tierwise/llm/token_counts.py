"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, as a whole. The tokens' byte lengths add up to its bytes, so their running sums are token spans, and
counted characters turn them into character spans. Token spans and section spans are both in ascending order, so their
interval join is a binary search for each token. A token that crosses a boundary is allocated by a rule:

* "largest": to the section it shares most characters with, of equal ones the first;
* "first": to the first section it touches;
* "share": to every section it touches, by the share of its characters that lie in sections.

A token that touches no section counts in section -1, so the counts of a document always add up to its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwise.llm.shared import byte_view, parts

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("largest", "first", "share")


@lru_cache(maxsize=1)
def _encoding(vocabulary: str):
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last byte of every line; a text of n line feeds has n + 1 lines, an empty one none."""
    feeds = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, feeds, "right") - 1
    some = np.flatnonzero(np.diff(offsets))
    rows = np.r_[some, row]
    starts, stops = np.r_[offsets[some], feeds + 1], np.r_[feeds, offsets[some + 1]]
    order = np.argsort(starts, kind="stable")
    return np.sort(rows), starts[order], np.sort(stops)


def allocate(starts: np.ndarray, stops: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens [first, last) against ascending, disjoint sections [starts, stops): each section's count, and what a token leaves over."""
    counts, over = np.zeros(len(starts)), np.ones(len(first))
    a = np.searchsorted(stops, first, "right")
    b = np.searchsorted(starts, last, "left") - 1
    one = np.flatnonzero(a == b)
    one = one[stops[a[one]] > starts[a[one]]]  # an empty section can lie within a token, but not be touched
    np.add.at(counts, a[one], 1.0)
    over[one] = 0
    for t in np.flatnonzero(a < b):
        s = np.arange(a[t], b[t] + 1)
        common = np.maximum(np.minimum(stops[s], last[t]) - np.maximum(starts[s], first[t]), 0)
        if not common.any():
            continue
        if rule == "share":
            counts[s] += common / common.sum()
        elif rule == "first":
            counts[s[np.argmax(common > 0)]] += 1
        else:
            counts[s[np.argmax(common)]] += 1
        over[t] = 0
    return counts, over


def count(docs: DataFrame, sections: str | None = None, rule: str = "largest", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, section, start, stop (characters) and n_tokens (double) for every row of docs and each of its sections.

    sections names a column of docs, an array of structs (start, stop); without it the lines are the sections. Sections
    are numbered in order of start and stop; one that overlaps those before begins where they end, and bounds are cut to
    the text; nulls among them are passed over. Every row of docs also has section -1, with null bounds, for what no section has.
    Null and empty texts have no tokens. Rows that repeat an id are counted each.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _encoding(vocabulary)
        for batch in batches:
            for part in parts(batch):
                data, offsets = byte_view(part.column("text"))
                ids = [encoding.encode_ordinary(x) for x in part.column("text").to_pylist() if x]
                lengths = sizes[np.concatenate([np.array(x, np.int64) for x in ids])] if ids else np.zeros(0, np.int64)
                ends = np.cumsum(lengths)
                chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # characters that begin before each byte
                first = chars[np.minimum(ends - lengths + 1, len(data))] - 1
                last = chars[ends]
                begin = chars[offsets]
                if sections:
                    rows, starts, stops = [], [], []
                    for r, spans in enumerate(part.column(sections).to_pylist()):
                        at, size = 0, int(begin[r + 1] - begin[r])
                        given = [(s["start"], s["stop"]) for s in spans or [] if s and None not in (s["start"], s["stop"])]
                        for start, stop in sorted(given):
                            start = min(max(start, at), size)
                            at = max(start, min(stop, size))
                            rows.append(r), starts.append(begin[r] + start), stops.append(begin[r] + at)
                    rows, starts, stops = (np.array(x, np.int64) for x in (rows, starts, stops))
                else:
                    rows, starts, stops = _lines(data, offsets)
                    starts, stops = chars[starts], chars[stops]
                counts, over = allocate(starts, stops, first, last, rule)
                token_rows = np.searchsorted(offsets, ends - lengths, "right") - 1
                n = part.num_rows
                left = np.bincount(token_rows, over, minlength=n)
                number = np.arange(len(rows)) - np.searchsorted(rows, rows)
                all_rows = np.r_[np.arange(n), rows]
                order = np.argsort(all_rows, kind="stable")
                none = np.r_[np.ones(n, bool), np.zeros(len(rows), bool)]
                columns = (np.r_[np.full(n, -1), number], np.r_[np.zeros(n, np.int64), starts - begin[rows]],
                           np.r_[np.zeros(n, np.int64), stops - begin[rows]], np.r_[left, counts])
                section, start, stop, tokens = (c[order] for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(all_rows[order])), pa.array(section, pa.int32()),
                     pa.array(start, pa.int64(), mask=none[order]), pa.array(stop, pa.int64(), mask=none[order]), pa.array(tokens)],
                    ["doc_id", "section", "start", "stop", "n_tokens"],
                )

    wanted = ["doc_id", "text", *([sections] if sections else [])]
    return docs.select(*wanted).mapInArrow(run, "doc_id long, section int, start long, stop long, n_tokens double")


def with_sections(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the spans of a table sections (doc_id, start, stop) as a column for count()."""
    spans = sections.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("sections"))
    return docs.select("doc_id", "text").join(spans, "doc_id", "left")
