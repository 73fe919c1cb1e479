"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All new pre-tokens of a part of the texts are merged in one run: their bytes are one linked list, in which no pair crosses
an edge between pre-tokens. The queue has a bucket of positions for each merge rank and three levels of 64-bit maps over
the buckets, so the next rank is three find-first-set steps away, whatever the length. A bucket is worked off from the left;
when a merge makes a pair of lower rank, the rest of the bucket waits for it. An entry whose pair has changed since is
stale and skipped. n bytes take about n steps, and a very long pre-token is no hazard.

Texts are cut at blanks before the pattern runs, which changes nothing where each blank precedes a visible character, and
the ids of such pieces and of pre-tokens are remembered in two generations of bounded size. A pre-token with its blank is a
piece itself, so it is remembered once. Pieces of Latin letters and final ASCII marks are cut without the pattern.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from tierwise.llm.shared import parts

PIECES, PRETOKENS = 150_000, 20_000  # remembered in each generation
PART = 1 << 20  # bytes of text whose new pre-tokens are merged at once

#: The characters that the pattern's \s means.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Letters up to U+024F, and the ASCII marks, which are neither letters, numbers nor white space.
PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-/:-@\[-`{-~]*)").fullmatch


class RankQueue:
    """Buckets of positions by rank, lowest rank first; ranks below 2 ** 18."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low, self.mid, self.top = [0] * 4096, [0] * 64, 0

    def put(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions from left to right."""
        a = (self.top & -self.top).bit_length() - 1
        m = self.mid[a]
        b = a << 6 | (m & -m).bit_length() - 1
        x = self.low[b]
        rank = b << 6 | (x & -x).bit_length() - 1
        self.low[b] = x & (x - 1)
        if not self.low[b]:
            self.mid[a] = m & (m - 1)
            if not self.mid[a]:
                self.top &= self.top - 1
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class Codec:
    """One rank file and pattern; a worker keeps it for all its tasks."""

    def __init__(self, file: str, pattern: str):
        with open(file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        self.pairs = np.full(1 << 16, -1, np.int32)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.singles = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.longest = max(map(len, self.ranks))
        explicit = pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.matches = regex.compile(explicit).findall
        self.joined = re.compile(r" (?:\s|\Z)").search
        self.queue = RankQueue()
        self.pieces: list[dict[str, bytes]] = [{}, {}]  # this generation and the one before
        self.known: list[dict[str, bytes]] = [{}, {}]  # the same for pre-tokens

    def merge(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens one after another, and the n + 1 places where each one's begin."""
        data = b"".join(pretokens)
        n = len(data)
        ends = np.cumsum([0, *map(len, pretokens)])
        raw = np.frombuffer(data, np.uint8)
        first = np.full(n, -1, np.int32)
        first[:-1] = self.pairs[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        first[ends[1:][ends[1:] > 0] - 1] = -1
        order = np.argsort(first, kind="stable")[np.count_nonzero(first < 0) :]
        cuts = np.flatnonzero(np.diff(first[order], prepend=-2)).tolist() if len(order) else []
        queue, buckets, rank_of, longest = self.queue, self.queue.buckets, self.ranks.get, self.longest
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            queue.put(int(first[order[lo]]), order[lo:hi].tolist())
        now = first.tolist()  # rank of the pair that starts here, or -1
        ids = self.singles[raw].tolist()
        alive = bytearray(b"\1") * n
        edge = bytearray(n + 1)
        for e in ends.tolist():
            edge[e] = 1
        after, before = list(range(1, n + 1)), list(range(-1, n))
        put = queue.put
        while queue.top:
            rank, positions = queue.pop()
            for at, i in enumerate(positions):
                if now[i] != rank:
                    continue  # stale
                ids[i] = rank
                j = after[i]
                k = after[i] = after[j]
                alive[j] = 0
                now[j] = -1
                r = q = None
                if not edge[k]:
                    before[k] = i
                    end = after[k]
                    if end - i <= longest:
                        r = rank_of(data[i:end])
                if r is None:
                    now[i] = -1
                else:
                    now[i] = r
                    if r in buckets:
                        buckets[r].append(i)
                    else:
                        put(r, [i])
                if not edge[i]:
                    h = before[i]
                    if k - h <= longest:
                        q = rank_of(data[h:k])
                    if q is None:
                        now[h] = -1
                    else:
                        now[h] = q
                        if q in buckets:
                            buckets[q].append(h)
                        else:
                            put(q, [h])
                if (r is not None and r < rank) or (q is not None and q < rank):
                    if rank in buckets:
                        buckets[rank] += positions[at + 1 :]
                    elif at + 1 < len(positions):
                        put(rank, positions[at + 1 :])
                    break
        kept = np.frombuffer(alive, np.uint8)
        return np.array(ids, np.int32)[kept == 1], np.r_[0, np.cumsum(kept, dtype=np.int64)][ends]

    def _new(self, wanted: set[str], generations: list[dict[str, bytes]]) -> list[str]:
        """What this generation lacks, once the one before has handed over what it has."""
        new, old = generations
        missing = []
        for x in wanted.difference(new):
            if x in old:
                new[x] = old[x]
            else:
                missing.append(x)
        return missing

    def _found(self, pretokens: list[str]) -> list[bytes]:
        """The ids of each pre-token; one that is a token needs no merge."""
        raw = [x.encode() for x in pretokens]
        whole = [self.ranks.get(x) for x in raw]
        ids, ends = self.merge([x for x, rank in zip(raw, whole) if rank is None])
        packed, at = ids.tobytes(), zip((ends * 4).tolist(), (ends[1:] * 4).tolist())
        return [packed[slice(*next(at))] if rank is None else rank.to_bytes(4, sys.byteorder) for rank in whole]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        cut: list = []
        wanted, tokens, first_parts = set(), set(), set()
        for text in texts:
            if self.joined(text):
                cut.append((self.matches(text), ()))
            else:
                first, *rest = text.split(" ")
                cut.append((self.matches(first), rest))
                wanted.update(rest)
            tokens.update(cut[-1][0])
        parts_of = {}  # of pieces: the piece of its first pre-token, and the pre-tokens after it
        for p in self._new(wanted, self.pieces):
            if plain := PLAIN(p):
                head, marks = plain.groups()
                after = (marks,) if marks else ()
            else:
                head, *after = self.matches(" " + p)
                head = head[1:]
            first_parts.add(head)
            if after:
                parts_of[p] = head, after
                tokens.update(after)
        known, pieces = self.known[0], self.pieces[0]
        heads, missing = self._new(first_parts, self.pieces), self._new(tokens, self.known)
        ids = self._found([*[" " + x for x in heads], *missing])
        pieces.update(zip(heads, ids))
        known.update(zip(missing, ids[len(heads) :]))
        for piece, (head, after) in parts_of.items():
            pieces[piece] = b"".join([pieces[head], *map(known.__getitem__, after)])
        out = [b"".join([*map(known.__getitem__, a), *map(pieces.__getitem__, b)]) for a, b in cut]
        for generations, most in ((self.pieces, PIECES), (self.known, PRETOKENS)):
            if len(generations[0]) > most:
                generations[:] = {}, generations[0]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(file: str, pattern: str) -> Codec:
    return Codec(file, pattern)


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, pattern: str | None = None) -> Iterator[pa.RecordBatch]:
    c = codec(public_tokenizers.path(vocabulary), pattern or public_tokenizers.PATTERN)
    for batch in batches:
        for part in parts(batch, size=PART):
            found = c.encode([x or "" for x in part.column("text").to_pylist()])
            ends = np.cumsum([0, *map(len, found)]) // 4
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    c = codec(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
    for batch in batches:
        ids = batch.column("ids")
        values = ids.values.to_numpy()
        ends = ids.offsets.to_numpy()
        texts = [c.decode(values[i:j]) for i, j in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, vocabulary: str, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) for every row of docs; null and empty texts have no ids.

    vocabulary names a rank file of the tokenizer package, which each worker reads from its own installation.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _encoded(batches, vocabulary, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded (doc_id, ids) with the column decoded: the bytes that the ids stand for; null ids are empty.

    An id outside the vocabulary is an error.
    """
    return encoded.select("doc_id", "ids").mapInArrow(
        lambda batches: _decoded(batches, vocabulary), "doc_id long, ids array<int>, decoded binary"
    )


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """What decode gives for encode's rows, in one Python worker a task.

    Two steps in a row take two workers, each with its own codec; all of them stay for later jobs and take turns there, so
    an executor holds the most memory that any step needs four times instead of twice on two cores.
    """
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _decoded(_encoded(batches, vocabulary), vocabulary), "doc_id long, ids array<int>, decoded binary"
    )
