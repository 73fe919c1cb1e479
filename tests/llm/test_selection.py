"""Exact duplicates, hard negatives and importance resampling against plain versions."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm.brute import ITEM_WORDS, ascii_lower
from llm.test_documents import COLUMNS, EDGES, rows_of, same, small
from pyspark.sql import functions as F

from tierwise.llm import exact_dedup, hard_negatives, importance, shared

MORE = [
    (20, "a b"), (21, "a\t\n b"), (22, " a b"), (23, "a b "), (24, "a b "), (25, "a b"), (26, "A b"), (27, "ab"), (28, "  "), (29, " "),
    (30, "漢字  é"), (31, "漢字 é"), (32, "x" * 300_000), (-5, "a b"), (None, "only nameless"), (None, "only  nameless"), (33, "a b"), (33, "a b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "r", 1, None, "n", 2, "k", 3) for r in EDGES + MORE], COLUMNS)


def plain_copies(rows):
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    held = collections.defaultdict(list)
    for (d, _), t in zip(rows, texts):
        held[t].append(d)
    out, done = [], set()
    for d, t in sorted(zip([d for d, _ in rows], texts), key=lambda x: (x[0] is None, x[0] or 0)):
        named = [x for x in held[t] if x is not None]
        out.append((d, min(named) if named else None, len(held[t]), t not in done, hashlib.sha256(t.encode()).hexdigest()))
        done.add(t)
    return out


def copies(df):
    return rows_of(df, "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_duplicates(spark, docs):
    same(copies(exact_dedup.duplicates(docs)), plain_copies(EDGES + MORE))
    rows = rows_of(small(spark), "doc_id", "text")
    expected = plain_copies(rows)
    same(copies(exact_dedup.duplicates(small(spark))), expected)
    assert exact_dedup.duplicates(docs.limit(0)).isEmpty()


def test_exact_duplicates_of_one_large_group(spark):
    rows = [(i, "the same text" if i % 3 else f"another text {i}") for i in range(9000)]
    same(copies(exact_dedup.duplicates(spark.createDataFrame(rows, "doc_id long, text string"))), plain_copies(rows))


def test_texts_of_one_key_are_chained(spark, docs):
    """A key of three values: bytes tell the texts apart, and each has its place in the chain of its key."""
    poor = lambda text: F.shiftleft((F.length(text) % 3).cast("long"), 61)
    found = exact_dedup.duplicates(docs, 1, poor)  # a bucket a key
    same(copies(found), plain_copies(EDGES + MORE))
    chains = collections.defaultdict(set)
    for r in found.collect():
        chains[r.bucket].add((r.chain, r.text_sha256))
    for held in chains.values():
        assert sorted(c for c, _ in held) == list(range(1, len(held) + 1))


@pytest.mark.parametrize("bucket_bytes", [200, 5_000, 1 << 30])
def test_directory_splits_overfull_buckets(spark, bucket_bytes):
    rng = random.Random(1)
    # half of the keys start with the same 20 bits
    rows = [(rng.getrandbits(64) >> (20 if i % 2 else 0), rng.randrange(1, 90)) for i in range(3000)]
    rows = [(k - (1 << 64) if k >> 63 else k, n) for k, n in dict(rows).items()]
    directory, depth = exact_dedup.grown(spark.createDataFrame(rows, "key long, bytes long"), bucket_bytes)
    slots = {r.slot: (r.bucket, r.bucket_depth) for r in directory.collect()}
    load, keys = collections.Counter(), collections.Counter()
    for key, n in rows:
        slot = (key % (1 << 64)) >> (64 - depth)
        bucket, d = slots[slot]
        assert bucket <= slot < bucket + (1 << (depth - d)) and bucket % (1 << (depth - d)) == 0
        load[bucket, d] += n
        keys[bucket, d] += 1
    assert all(n <= bucket_bytes or keys[b] == 1 for b, n in load.items())
    parents = collections.Counter()
    for (bucket, d), n in load.items():
        parents[bucket >> (depth - d + 1), d - 1] += n
    # a bucket was split only where its parent was overfull; the parent's other half may have been split again
    for (bucket, d), n in load.items():
        if d:
            low = bucket >> (depth - d + 1) << (depth - d + 1)
            inside = sum(m for (b, _), m in load.items() if low <= b < low + (1 << (depth - d + 1)))
            assert inside > bucket_bytes
    assert (len(load) == 1) == (bucket_bytes == 1 << 30)


def test_index_is_in_the_order_of_its_buckets(spark):
    index = exact_dedup.build(small(spark), bucket_bytes=20_000)
    assert index.entries.select("bucket").distinct().count() > 5
    within = index.entries.groupBy(F.input_file_name().alias("f")).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).collect()
    ranges = sorted((r.a, r.b) for r in within)
    assert all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:]))


def plain_negatives(rows, is_anchor, positives=5, negatives=10):
    held = []
    for i, (vec_id, label, vector) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        held.append((i, vec_id, label, [math.floor(256 * x) for x in vector]))
    last = lambda v: (v is None, v or 0)
    out = []
    for i, a, label, q in held:
        if a is None or not is_anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(q, other)), v, l) for j, v, l, other in held if j != i]
        near = sorted((-s, last(v), v) for s, v, l in scored if l == label)[:positives]
        for s, _, p in near:
            fit = sorted((-n, last(v), v) for n, v, l in scored if l != label and 30 * -s <= 100 * n <= 90 * -s)[:negatives]
            out += [(a, p, k, v, -s, -n) for k, (n, _, v) in enumerate(fit, 1)]
    return out


NEGATIVE = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def vectors_of(n, dims, seed, coarse=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=dims)
        v = np.round(v) / 4 if coarse else v / np.linalg.norm(v)
        rows.append((i, int(rng.integers(4)), [float(np.float32(x)) for x in v]))
    return rows


ODD = [
    (500, None, [1.0] * 8), (500, 1, None), (600, 1, []), (600, 2, []), (700, 1, [1.0, None] + [0.0] * 6), (700, 2, [float("nan")] * 8),
    (800, 3, [float("inf")] + [1.0] * 7), (None, 1, [1.0] * 8), (None, 2, [0.5] * 8), (900, 1, [1.0] * 3), (900, 2, [0.5] * 12), (1000, 1, [0.0] * 8),
    (100, 1, [1.0] * 8), (100, 1, [1.0] * 8), (101, 2, [0.6] * 8), (101, 2, [0.6] * 8), (1100, 77, [1.0] * 8), (-100, 2, [0.5] * 8),
]


@pytest.mark.parametrize("rows", [vectors_of(900, 24, 1), vectors_of(400, 8, 2, coarse=True) + ODD, ODD], ids=["smooth", "ties", "odd"])
def test_hard_negatives(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], "vec_id long, label int, embedding array<float>, score int, anchor int, block string")
    expected = plain_negatives(rows, lambda v: v % 50 == 0)
    same(rows_of(hard_negatives.mine(df, F.col("vec_id") % 50 == 0), *NEGATIVE), expected)
    assert expected
    monkeypatch.setattr(hard_negatives, "ANCHOR_VALUES", 200)  # several blocks of anchors
    same(rows_of(hard_negatives.mine(df, F.col("vec_id") % 50 == 0), *NEGATIVE), expected)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).isEmpty()
    assert hard_negatives.mine(df, F.lit(False)).isEmpty()


def test_bounds_leave_out_what_cannot_match():
    """Few columns are read of a block, and what is found is what a whole product finds."""
    rng = np.random.default_rng(4)
    columns = np.sort(rng.integers(-200, 200, (32, 1)) + rng.integers(-9, 9, (32, 500)), axis=1).astype("<i4")
    row = {"block": 0, "n": 500, "dims": 32, "ids": np.arange(500).tobytes(), "labels": np.zeros(500, np.int64).tobytes(), "anchors": bytes(500),
           "columns": columns.tobytes(), "least": columns.min(axis=1).tobytes(), "largest": columns.max(axis=1).tobytes()}
    block = hard_negatives.Block(row)
    a = rng.integers(-200, 200, 32)
    whole = a @ columns
    for low, high in ((np.quantile(whole, 0.99), np.inf), (np.quantile(whole, 0.2), np.quantile(whole, 0.3)), (whole.max() + 1, np.inf)):
        places, scores = block.scores(a, low, high, np.ones(500, bool))
        expected = np.flatnonzero((whole >= low) & (whole <= high))
        assert places.tolist() == expected.tolist() and scores.tolist() == whole[expected].tolist()
    with pytest.raises(OverflowError):
        block.scores(np.full(32, 1 << 45), 0, 1, np.ones(500, bool))


def plain_resampled(rows, target):
    def features(text):
        w = ITEM_WORDS.findall(ascii_lower(text or ""))
        return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for d, text in rows:
        n, held = features(text)
        weight = sum(gain[bucket(f)] for f in held) // len(held) if held else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((-x[4], x[0] is None, x[0] or 0, x[2], x[3]) for x in out if x[1] >= 20)
    rank = collections.defaultdict(list)
    for i, x in enumerate(fit[: 25 * len(fit) // 100], 1):
        rank[-x[0], None if x[1] else x[2], x[3], x[4]].append(i)
    return [(d, n, w, s_, rank[s_, d, n, w].pop() if words >= 20 and rank[s_, d, n, w] else None) for d, words, n, w, s_ in out]


SAMPLED = ["doc_id", "n_features", "weight", "score", "rank"]
LONGER = [(40 + i, " ".join(f"{'Q' * (i % 90)}w{(i * j) % 37}é" for j in range(18 + i % 5))) for i in range(60)] + [(40, "a b c " * 9)] * 3


def test_importance_resampling(spark, docs):
    rows = EDGES + MORE + LONGER
    df = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], "doc_id long, text string, score int, rank int, n string")
    target = [PART for _, PART in LONGER[:9]] + [None, "", "...", "a b a b \x1c été"]
    wanted = spark.createDataFrame([(1, t) for t in target], "n int, text string")
    expected = plain_resampled(rows, target)
    same(rows_of(importance.resampled(df, wanted), *SAMPLED), expected)
    assert sum(x[4] is not None for x in expected) == 25 * sum(len(ITEM_WORDS.findall(ascii_lower(t or ""))) >= 20 for _, t in rows) // 100
    same(rows_of(importance.resampled(df, wanted.limit(0)), *SAMPLED), plain_resampled(rows, []))
    assert importance.resampled(df.limit(0), wanted).isEmpty()


def test_crcs_of_pairs():
    """From the CRCs of the words, for words of any length."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab1é漢") for _ in range(n)) for n in [*range(1, 30), 20, 63, 64, 65, 200] * 3})
    texts = [" ".join(rng.choices(words, k=300)), "", "one"]
    held = importance.Features(pa.array(texts, pa.large_string()))
    plain = collections.Counter(zlib.crc32(f.encode()) % 10000 for t in texts for w in [t.split()] for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    assert {b: n for b, n in enumerate(held.counts().tolist()) if n} == plain


def test_features_of_slices():
    texts = ["Aé b", None, "C漢 d " * 50, "", "é" * 30 + " Zz"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    for i in range(5):
        for j in range(i, 5):
            part = batch.slice(i, j - i)
            assert shared.from_zero(part.column("text")).to_pylist() == [t or "" for t in texts[i:j]]
            whole = importance.Features(pa.array([t or "" for t in texts[i:j]], pa.large_string()))
            assert (importance.Features(shared.from_zero(part.column("text"))).counts() == whole.counts()).all()
