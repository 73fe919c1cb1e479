"""Each operator against its plain version, on edge cases and on the small tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm import brute

import corpus_pipeline
from tierwise.llm import (
    byte_bpe, decontaminate, graph, near_dedup, queries, shared, spot_signatures, substring_dedup, token_counts, token_files,
    toxicity, url_templates, warc,
)

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"word{i}" for i in range(60))
EDGES = [
    (1, "one two three four five six seven eight"),
    (2, "one two three four five six seven eight"),
    (2, "one two three four five six seven eight"),  # a repeated row
    (2, "another text of the same id, with Some more words in it"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b "),
    (6, "short one"),
    (7, "Short  ONE"),
    (8, f"before {PASSAGE} after"),
    (9, f"elsewhere\n{PASSAGE}\ttoo"),
    (10, " ".join(["same"] * 200)),
    (11, "漢字 été ß 🙂 \x1c\x85 half"),
    (12, "x" * 300_000),
    (13, " ".join(f"w{i % 977}" for i in range(100_000))),
    (None, f"nameless {PASSAGE}"),
    (None, None),
]
COLUMNS = "doc_id long, text string, row string, spans int, kept_text string, n_words string, component_id int, key string, n int"


@pytest.fixture(scope="module")
def docs(spark):
    """The edge cases, with columns whose names the operators use too."""
    return spark.createDataFrame([(*r, "r", 1, None, "n", 2, "k", 3) for r in EDGES], COLUMNS)


def small(spark, name="documents"):
    return shared.table(spark, SF, name)


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_words_of_arrow_texts():
    texts = ["a bb  c\n", None, "", " x", "é ü" + "z" * 60, "q" * 100, "q" * 101]
    data, offsets = shared.byte_view(pa.array(texts))
    starts, ends, first = shared.word_bounds(data, offsets, shared.SPACE)
    assert [bytes(data[i:j]).decode() for i, j in zip(starts, ends)] == [w for t in texts if t for w in t.split()]
    assert list(np.diff(first)) == [len((t or "").split()) for t in texts]
    assert len(set(shared.word_hashes(data, starts, ends))) == 8
    h = shared.word_hashes(data, starts, ends)
    assert list(shared.runs(np.r_[h, h], 5))[:4] == list(shared.runs(np.r_[h, h], 5))[8:]


def test_components(spark):
    random.seed(3)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    found = dict(rows_of(graph.components(spark.createDataFrame(links, "a long, b long")), "id", "component"))
    root = {x: x for pair in links for x in pair}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in links)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def near(df):
    return rows_of(df, "doc_id", "n_shingles", "component_id", "kept")


def expected_near(rows):
    held = collections.defaultdict(list)
    for d, t in rows:
        if d is not None:
            held[d].append(t)
    of = brute.components(held)
    return [(d, len(brute.shingles(t)), of.get(d), d is None or of[d] == d) for d, t in rows]


def test_near_duplicates(spark, docs):
    same(near(near_dedup.near_duplicates(docs)), expected_near(EDGES))
    rows = rows_of(small(spark), "doc_id", "text")
    same(near(near_dedup.near_duplicates(small(spark))), expected_near(rows))
    assert near_dedup.near_duplicates(docs.limit(0)).isEmpty()


def test_near_duplicates_around_the_threshold(spark):
    """Chains of texts that share most words: links exactly at 0.75, just below, and chains of links."""
    random.seed(5)
    rows = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(random.choice([6, 7, 12, 40, 300]))]
        for _ in range(20):
            words = [w if random.random() > 0.02 else f"e{random.random()}" for w in words]
            rows.append((len(rows), " ".join(words)))
    same(near(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))), expected_near(rows))


def test_tiles_find_every_pair_once():
    random.seed(2)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, near_dedup.VALUES, dtype=np.uint16)
    values = np.array([np.where(rng.random(64) < rng.choice([0.2, 0.5, 0.9]), rng.integers(0, 1 << 16, 64), base) for _ in range(60)], np.uint16)
    expected, found = set(), collections.Counter()
    for i in range(60):
        for j in range(i + 1, 60):
            equal = (values[i] == values[j])[None]
            if (~equal).sum() <= near_dedup.MOST_ERRORS:
                expected.add((i, j))
                found[i, j] += near_dedup._first_bucket(equal)[0] >= 0
                chunks = equal.reshape(16, 4)
                assert (chunks.sum(axis=1) >= 3).any()  # the pigeonhole
    assert expected and set(found) == expected


def cut(df):
    return [(r.row.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()]


def test_substring_dedup(spark, docs):
    same(cut(substring_dedup.remove_repeats(docs)), brute.without_repeats(EDGES))
    rows = rows_of(small(spark), "doc_id", "text")
    expected = brute.without_repeats(rows)
    same(cut(substring_dedup.remove_repeats(small(spark))), expected)
    same(cut(substring_dedup.remove_repeats(small(spark), group=2)), expected)  # nearly all groups take the long prefix
    assert sum(x[2] for x in expected) > 1000
    assert substring_dedup.remove_repeats(docs.limit(0)).isEmpty()


ITEMS = [(1, PASSAGE), (2, "One, two THREE four five"), (3, None), (4, "..."), (None, "short one"), (1, PASSAGE), (5, "été"), (6, "same " * 9)]


def test_substring_dedup_keeps_whole_hashes():
    """All 64 bits of the window hashes travel with the records."""
    text = " ".join(f"w{i}" for i in range(300))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": [text], "text_key": pa.array([5], pa.int32())})
    sent = pa.concat_batches(list(substring_dedup._anchored(iter([batch]))))
    windows = substring_dedup._records(batch)[4]
    assert set(substring_dedup._nodes(sent)[0].tolist()) == set(windows.tolist()) and (windows >> np.uint64(48)).any()


def leaks(df):
    return [(r.row.doc_id, r.n_words, r.hit, r.item_ids) for r in df.withColumn("hit", decontaminate.n_hit()).collect()]


def test_decontamination(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(leaks(decontaminate.find_leaks(docs, items)), brute.leaks(EDGES, ITEMS))
    rows, given = rows_of(small(spark), "doc_id", "text"), rows_of(small(spark, "benchmark"), "item_id", "text")
    expected = brute.leaks(rows, given)
    assert any(x[2] for x in expected)
    same(leaks(decontaminate.find_leaks(small(spark), small(spark, "benchmark"))), expected)
    assert not any(x[2] for x in leaks(decontaminate.find_leaks(docs, items.limit(0))))
    assert decontaminate.find_leaks(docs.limit(0), items).isEmpty()


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 20)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(leaks(decontaminate.find_leaks(docs, items)), brute.leaks(EDGES, ITEMS))


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, docs, tiktoken_encoding):
    name = "byte_bpe_multi_50k.tiktoken"
    for df, rows in ((docs, EDGES), (small(spark), rows_of(small(spark), "doc_id", "text"))):
        found = rows_of(byte_bpe.decode(byte_bpe.encode(df, name), name), "doc_id", "ids", "decoded")
        same(found, [(d, tiktoken_encoding.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows])
    assert byte_bpe.encode(docs.limit(0), name).isEmpty()


def test_byte_bpe_of_odd_texts(tiktoken_encoding):
    random.seed(1)
    codec = byte_bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    letters = " \n\t\x0b\x1c\x85\xa0　ab'stéΣ中½²٣.!? \r_漢🙂é"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 14))) for _ in range(5000)]
    texts += ["a" * 50_000, "ab" * 20_000, " " * 9_000, "the" * 9_000, "é" * 9_000]
    for t, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == tiktoken_encoding.encode_ordinary(t), t[:50]


def test_rank_queue():
    queue, held = byte_bpe.RankQueue(), collections.defaultdict(list)
    random.seed(4)
    for _ in range(2000):
        rank, position = random.randrange(1 << 18), random.randrange(99)
        held[rank].append(position)
        if rank in queue.buckets:
            queue.buckets[rank].append(position)
        else:
            queue.put(rank, [position])
    out = []
    while queue.top:
        out.append(queue.pop())
    assert out == [(r, sorted(p)) for r, p in sorted(held.items())]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in queries.op2_toxicity(spark, sf).collect()}
    labels = rows_of(shared.table(spark, sf, "labels"), "doc_id", "toxic")
    assert len(found) == shared.table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in found.items())
    held = [(found[d].score, t) for d, t in labels if found[d].held_out]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([np.mean([b > g for g in good]) for b in bad])
    assert auc > 0.93
    assert np.mean([s >= 0.3 for s in good]) < 0.05 and np.mean([s >= 0.3 for s in bad]) > 0.7


def test_toxicity_keeps_evidence_in_a_large_corpus(spark):
    """A pair of common words tells the classes apart, however many other pairs there are; only its order differs."""
    rng = random.Random(2)
    rows = []
    for i in range(60):
        fill = " ".join(f"{rng.getrandbits(64):016x}" for _ in range(9000))
        rows.append((f"{fill} {'alpha beta' if i % 2 else 'beta alpha'}", i % 2, i))
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int, order long"))
    probes = spark.createDataFrame([(1, "alpha beta"), (0, "beta alpha")], "toxic int, text string")
    found = {r.toxic: r.score for r in toxicity.score(probes, model).select("row.toxic", "score").collect()}
    assert found[1] > 0.5 > found[0]


def test_toxicity_counts_are_exact(spark):
    """Counts and numbers of different neighbours, far beyond 310 of a word, against a plain count."""
    rng = random.Random(3)
    rows = [(" ".join(f"hub w{rng.randrange(3000)}" for _ in range(200)), i % 2, i % 3 == 0) for i in range(30)]
    rows += [("rare w1 rare w2", 1, False), ("", 0, True), (None, 1, False)]
    given = spark.createDataFrame(rows, "text string, label long, third boolean").selectExpr("text", "label", "cast(third as long) third")
    found = toxicity.grams(given).collect()
    hashed = lambda word: int(toxicity._words(pa.array([word]))[0].view(np.int64)[0])
    words, pairs = collections.defaultdict(lambda: [0] * 4), collections.defaultdict(lambda: [0] * 4)
    for text, label, third in rows:
        split = [hashed(w) for w in (text or "").split()]
        for seen, these in ((words, split), (pairs, zip(split, split[1:]))):
            for x in these:
                seen[x][1 - label + 2 * third] += 1
    expected = {(True, *p): tuple(n) for p, n in pairs.items() if n[0] + n[2] > 4 or n[1] + n[3] > 4}
    assert {(True, r.a, r.b): tuple(r[c] for c in toxicity._COUNTS) for r in found if r.pair} == expected and expected
    for w, n in words.items():
        before = [(a, p[0] + p[1] > 0) for (a, b), p in pairs.items() if b == w]
        behind = [(b, p[0] + p[1] > 0) for (a, b), p in pairs.items() if a == w]
        words[w] = (*n, sum(x for _, x in before), len(before), sum(x for _, x in behind), len(behind))
    assert {r.a: tuple(r[c] for c in (*toxicity._COUNTS, *toxicity._NEIGHBOURS)) for r in found if not r.pair} == words
    assert words[hashed("hub")][-1] > 1000


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (8, None), (13, 0)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        found = toxicity.score(docs, toxicity.learn(docs, given))
        assert found.count() == len(EDGES) and found.where("score between 0 and 1").count() == len(EDGES)
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.learn(empty, labels)).isEmpty()


def test_lines_and_sections(spark):
    encoding, sizes = token_counts._encoding(token_counts.VOCABULARY)

    def plain(text, sections, rule):
        at, number, place, out = 0, -1, [], collections.Counter()
        for x in text.encode():
            number += x & 0xC0 != 0x80
            place.append(number)
        for t in encoding.encode_ordinary(text):
            first, last = place[at], place[at + int(sizes[t]) - 1] + 1
            at += int(sizes[t])
            common = [(min(e, last) - max(s, first), i) for i, (s, e) in enumerate(sections) if min(e, last) > max(s, first)]
            if not common:
                out[-1] += 1
            elif rule == "share":
                for n, i in common:
                    out[i] += n / sum(x for x, _ in common)
            else:
                out[common[0][1] if rule == "first" else max(common, key=lambda x: (x[0], -x[1]))[1]] += 1
        return out

    rows = [(d, t) for d, t in rows_of(small(spark), "doc_id", "text")][:60]
    rows += [(9001, None), (9002, ""), (9003, "\n\n"), (9004, "a\n"), (9005, "漢字🙂\nfoo")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, section string, n_tokens int")
    random.seed(2)
    cuts = {d: sorted(random.choices(range(len(t or "") + 3), k=3)) for d, t in rows}
    given = [(d, a, b) for d, (x, y, z) in cuts.items() for a, b in ((x, y), (y, z))]
    spans = spark.createDataFrame(given + [(None, 1, 2), (0, None, 3)], "doc_id long, start int, stop int")
    for rule in token_counts.RULES:
        for sections in (None, "sections"):
            source = token_counts.with_sections(df, spans) if sections else df
            found = collections.defaultdict(dict)
            for r in token_counts.count(source, sections, rule).collect():
                found[r.doc_id][r.section] = r.n_tokens
            for d, t in rows:
                n = len(t or "")
                if sections:
                    at = [min(c, n) for c in cuts[d]]
                    parts = [(at[0], at[1]), (at[1], at[2])]
                else:
                    ends = [i for i, c in enumerate(t or "") if c == "\n"] + [n]
                    parts = list(zip([0, *[e + 1 for e in ends[:-1]]], ends)) if t else []
                expected = plain(t or "", parts, rule)
                assert len(found[d]) == len(parts) + 1
                assert all(abs(found[d][k] - expected[k]) < 1e-6 for k in found[d]), (d, rule, sections)
    assert token_counts.count(df.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        token_counts.count(df, rule="none")


def test_byte_aligned_coding():
    v = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 5], np.uint32)
    for n in range(len(v) + 1):
        control, data = token_files.pack(v[:n])
        assert len(control) == -(-n // 4)
        assert (token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == v[:n]).all()


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    special = [(70, "a <|endoftext|> b"), (71, "Word<|startoftext|>word <|ENDOFTEXT|>,"), (72, "<|endoftext|>" * 3), (73, "<|endoftext")]
    assert 49407 in tokenizer.encode(special[0][1], add_special_tokens=False).ids
    given = spark.createDataFrame(special, "doc_id long, text string")
    for df, rows in ((given, special), (docs, EDGES), (small(spark), rows_of(small(spark), "doc_id", "text"))):
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
        expected, start = [], 0
        for d, t in ordered:
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
            expected.append((d, start, len(ids), np.array(ids, "<u4").tobytes()))
            start += len(ids)
        folder, manifest = token_files.write(df, "word_bpe_49k.json")
        same(rows_of(token_files.read(spark, folder), "doc_id", "start", "n_tokens", "ids"), expected)
        assert manifest.agg({"documents": "sum"}).first()[0] == len(rows)
    folder, _ = token_files.write(docs.limit(0), "word_bpe_49k.json")
    assert token_files.read(spark, folder).isEmpty()


def test_words_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    random.seed(3)
    words = token_files.Words(public_tokenizers.path("word_bpe_49k.json"))
    letters = " \n\t\x0b\x1c\x85\xa0ab'stéΣßÉ中½²٣.!? \r_漢🙂é,;'İſ<|endoftext|>"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 14))) for _ in range(5000)] + ["a <|endoftext|> b"]
    texts += ["".join(random.choices(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "a", "É.", " ", "!"], k=6)) for _ in range(3000)]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch(texts, add_special_tokens=False)
    ids, n = words.encode(pa.array(texts))
    for t, a, b in zip(texts, np.split(ids, np.cumsum(n)[:-1]), plain, strict=True):
        assert a.tolist() == [*b.ids, 1], t


def warc_expected(rows):
    first, out = {}, []
    for p, h in sorted(rows):
        body = (h or "").encode()
        f = first.setdefault(body, p)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((p, len(body), digest, "response" if f == p else "revisit", None if f == p else f))
    return out


def test_warc(spark):
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    rows = [(i, "http://a b\n/", [None, "", "x", "é", "x" * 100_000][i % 5], "clash") for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, first string")
    folder, manifest = warc.write(df, file_bytes=500)
    found = warc.read(spark, folder, manifest)
    same(rows_of(found, *columns), warc_expected([(r[0], r[2]) for r in rows]))
    assert manifest.count() > 10 and {r.url for r in found.collect()} == {"http://a%20b%0A/"}
    assert sorted(manifest.collect()) == sorted(warc.write(df, file_bytes=500)[1].collect())  # equal bytes
    pages = small(spark, "pages")
    same(rows_of(warc.read(spark, *warc.write(pages)), *columns), warc_expected(rows_of(pages, "page_id", "html")))
    odd = [(None, None, None), (None, None, None), (3, None, "a"), (3, None, "a"), (3, None, "b"), (None, "u", "a")]
    odd = spark.createDataFrame(odd, "page_id long, url string, html string")
    same(
        rows_of(warc.read(spark, *warc.write(odd)), "page_id", "record_type", "refers_to"),
        [(None, "response", None)] * 2 + [(None, "revisit", 3)] + [(3, "response", None)] * 2 + [(3, "revisit", 3)],
    )
    least = rows_of(warc.read(spark, *warc.write(df, least=2)), "page_id", "record_type")
    assert all((kind == "response") == (p % 5 < 3 or p < 5) for p, kind in least)
    assert warc.read(spark, *warc.write(df.limit(0))).isEmpty()


def test_damaged_warc_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    folder, manifest = warc.write(df)
    altered = spark.createDataFrame([(r.file, r.records, r.bytes, "0" * 32) for r in manifest.collect()], manifest.schema)
    with pytest.raises(Exception, match="is not what the manifest lists"):
        warc.read(spark, folder, altered).collect()


def test_spot_signatures(spark, docs, monkeypatch):
    monkeypatch.setattr(spot_signatures, "BUCKET_ROWS", 20)
    for df, rows in ((docs, EDGES), (small(spark), rows_of(small(spark), "doc_id", "text"))):
        ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        expected = []
        for (d, t), (_, following) in zip(ordered, [*ordered[1:], ordered[0]]):
            half = len(t) // 2
            expected.append((d, len(t), t[: len(t) - half] + following[:half]))
        same(rows_of(spot_signatures.edited(df), "doc_id", "n_chars", "edited_text"), expected)
    signed = spot_signatures.signatures(small(spark).select("doc_id", "text"))
    by_text = collections.defaultdict(set)
    for r in signed.collect():
        by_text[r.text].add(tuple(r.signatures))
    assert all(len(x) == 1 and all(x) for x in by_text.values())
    assert spot_signatures.edited(docs.limit(0)).isEmpty()


def test_spot_signature_pairs(spark):
    signed = spot_signatures.signatures(shared.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"))
    pairs, members = spot_signatures.near_pairs(signed)
    classes = {}
    for r in sorted(signed.collect()):
        classes.setdefault(tuple(r.signatures), r.doc_id)
    sets = [(i, set(s)) for s, i in classes.items()]
    expected = {}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 0.75 * len(a) <= len(b) and 0.75 * len(b) <= len(a) and (both := len(a & b)) >= 0.75 * (len(a) + len(b) - both):
                expected[min(i, j), max(i, j)] = both / (len(a) + len(b) - both)
    assert {(r.a, r.b): r.likeness for r in pairs.collect()} == pytest.approx(expected)
    assert expected and members.count() == signed.count()


def url_parts(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    i = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    path = rest[i:]
    host, path = brute.ascii_lower(rest[:i]), path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(h + p, a) for a, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda x: len(x[0]), default=None)


def test_url_rules(spark):
    urls = [None, "", "nourl", "HTTP://EXAMPLE.NET", "http://a.example.net/en/x?y#z", "x://net/?q", "ftp://É.ORG/fr/1\n2", "a://b://c/d"]
    urls += ["http://net?x/", "http://xnet/", "http://n.net#/", "http://a.org/" + "/".join("abcdefghijkl")]
    rows = list(enumerate(urls)) + [(0, urls[4])] + [(100 + p, u) for p, u in rows_of(small(spark, "pages"), "page_id", "url")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, host string, n int")
    found = url_templates.judge(df, queries.URL_RULES).collect()
    expected = [(p, u, h, q, r and r[0], r[1] if r else None) for p, u in rows for h, q, r in [url_parts(u)]]
    same([(r.page_id, r.url, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in found], expected)
    assert {r.verdict for r in found} <= {"allow", "block"}
    assert url_templates.judge(df.limit(0), queries.URL_RULES).isEmpty()


def test_url_tree(spark):
    rows = [f"http://h.example.com/de/{i}" for i in range(400)] + ["http://h.example.com/fr/7"]
    rows += [f"http://h.example.com/tag/w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400)]
    rows += [f"http://s.example.com/{'de' if i % 50 else 'en'}/{i}" for i in range(400)]
    rows += [f"http://q.org/{'fr' if i % 3 else 'es'}/{i}.html" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    found = {r.url: (r.template, r.verdict) for r in url_templates.judge(df, queries.URL_RULES).collect()}
    assert found["http://h.example.com/fr/7"][1] == "allow" and found["http://h.example.com/de/7"][1] == "block"
    assert {v for u, v in found.items() if "/tag/" in u} == {("/tag/*", "allow")}
    assert found["http://s.example.com/en/0"] == ("/+/{n}", "block")  # nearly all of its template is blocked
    assert found["http://q.org/es/0.html"][1] == "allow"


def plain_tree(urls):
    """template and purity of each (host, path, label), one host at a time: see url_templates."""
    t = url_templates
    fixed = lambda x: "{x}" if re.fullmatch("[0-9a-fA-F-]{8,}", x) and re.search("[0-9]", x) and re.search("[a-fA-F-]", x) else x
    rows = [[h, [re.sub("[0-9]+", "{n}", fixed(x)) for x in p.split("/") if x], label] for h, p, label in sorted(set(urls), key=str)]

    def at(place):
        nodes = collections.defaultdict(lambda: collections.defaultdict(list))
        for row in rows:
            if len(row[1]) > place:
                nodes[row[0], tuple(row[1][:place])][row[1][place]].append(row)
        return nodes.values()

    deepest = max((len(r[1]) for r in rows), default=0)
    for place in range(deepest):
        for node in at(place):
            sizes = [len(x) for x in node.values()]
            if t.BRANCHES * sum(n * n for n in sizes) < sum(sizes) ** 2:
                for row in sum(node.values(), []):
                    row[1][place] = "*"
    for place in reversed(range(deepest)):
        for node in at(place):
            alike = collections.defaultdict(list)
            for token, members in node.items():
                if len(members) >= t.EVIDENCE:
                    seen = collections.Counter(r[1][place + 1] if len(r[1]) > place + 1 else "" for r in members)
                    children = tuple(sorted(c for c, n in seen.items() if n * t.CHILDREN >= len(members)))
                    bad, good = (sum(r[2] == x for r in members) for x in ("block", "allow"))
                    kind = None if not bad + good else "bad" if bad >= t.PURITY * (bad + good) else "good" if good >= t.PURITY * (bad + good) else "mixed"
                    alike[children].append((token, kind))
            groups = []
            for branches in alike.values():
                split = len({k for _, k in branches} - {None}) > 1
                for kind in {k for _, k in branches} if split else [0]:
                    tokens = sorted(x for x, k in branches if not split or k == kind)
                    if len(tokens) > 1:
                        groups.append((-sum(len(node[x]) for x in tokens), tokens))
            for i, (_, tokens) in enumerate(sorted(groups, key=lambda g: (g[0], g[1][0]))):
                for row in sum((node[x] for x in tokens), []):
                    row[1][place] = "+" + tokens[0] * (i > 0)
    by_template = collections.defaultdict(lambda: [0, 0])
    for h, segments, label in rows:
        if label:
            by_template[h, tuple(segments)][label == "allow"] += 1
    bad, good = (sum(x[i] for x in by_template.values()) for i in (0, 1))
    share = min(0.5, bad / max(1, bad + good))
    found = {}
    for (h, p, _), (_, segments, _) in zip(sorted(set(urls), key=str), rows):
        b, g = by_template[h, tuple(segments)]
        found[h, p] = ("/" + "/".join(segments), round((b + t.SMOOTHING * share) / (b + g + t.SMOOTHING), 9))
    return found


def test_url_tree_is_the_plain_one(spark):
    """Templates, purity and verdicts against a plain tree: hosts with two kinds of sections, ties, deep and contradictory branches."""
    rng = random.Random(5)
    urls = [url for _, url in rows_of(small(spark, "pages"), "page_id", "url")] + [None, "", "http://empty.org"]
    urls += [f"http://two.com/s{chr(97 + i)}/{'a' if i < 5 else 'b'}/{j}" for i in range(10) for j in range(9)]
    urls += [f"http://odd.com/{s}/{rng.choice('pqr')}/w{rng.randrange(40)}" for s in ("de", "en", "fr", "it") for _ in range(12)]
    urls += [f"http://deep.com/de/{'/'.join('bcdefghijkl')}/{x}/{i}" for x in ("blog", "shop/item") for i in range(6)]
    urls += [f"http://x.net/{s}/{w}{i}" for s in ("en", "us", "uk", "au") for w in "vw" for i in range(7)]
    urls += [f"http://big.example.com/{s}/{i}.html" for s in ("de", "en", "fr") for i in range(30)]  # the rule is on one of three alike
    urls += [f"http://tags.com/{'de/' * (i % 2)}tag/{chr(97 + i % 26)}{chr(97 + i // 26)}y/{i}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_templates.judge(df, queries.URL_RULES).collect()
    parts_of = [url_parts(u) for u in urls]
    plain = plain_tree([(h, p, r[1] if r else None) for h, p, r in parts_of])
    assert {(r.host, r.path): (r.template, round(r.purity, 9)) for r in found} == plain
    assert all(r.verdict == ("block" if r.purity >= url_templates.PURITY else "allow") for r in found if r.rule is None)
    assert {"block", "allow"} == {r.verdict for r in found if r.rule is None}
    two = {r.template for r in found if r.host == "two.com"}
    assert len(two) == 2 and len({r.template for r in found if r.host == "deep.com"}) == 2
    ten = url_templates.judge(df.crossJoin(spark.range(10)).select("page_id", "url"), queries.URL_RULES)
    assert {(r.page_id, r.template, r.verdict) for r in ten.collect()} == {(r.page_id, r.template, r.verdict) for r in found}


def test_pipeline_stages(spark):
    """Each stage against its plain version, on what the stage before has kept."""
    sf = "/root/testdata/sf0.01"
    docs = shared.table(spark, sf, "documents")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "substring dedup", "decontamination", "byte-level bpe"]
    before = rows_of(docs, "doc_id", "text")
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, sf), "stage")
        after = rows_of(docs, "doc_id", "text")
        if name != names[-1]:
            assert docs.columns == columns
        if name == "toxicity":
            assert set(after) <= set(before) and 0.85 < len(after) / len(before) < 0.99
        elif name == "near duplicates":
            kept = {x[0] for x in expected_near(before) if x[3]}
            same(after, [r for r in before if r[0] in kept])
        elif name == "substring dedup":
            same(after, [(d, k if n else t) for (d, t), (_, _, n, k) in zip(before, brute.without_repeats(before))])
        elif name == "decontamination":
            hit = {x[0] for x in brute.leaks(before, rows_of(small_benchmark(spark, sf), "item_id", "text")) if x[2]}
            same(after, [r for r in before if r[0] not in hit])
        else:
            same(after, before)
        before = after


def test_pipeline_drops_what_is_predicted_toxic(spark):
    """Labelled toxic rows that op2 predicts go, and most of those that are held out."""
    sf = "/root/testdata/sf0.1"
    predicted = {r.doc_id: r for r in queries.op2_toxicity(spark, sf).collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, shared.table(spark, sf, "documents"), sf).select("doc_id").collect()}
    toxic = {d for d, t in rows_of(shared.table(spark, sf, "labels"), "doc_id", "toxic") if t}
    assert {d for d in toxic if predicted[d].predicted}.isdisjoint(kept)
    held = {d for d in toxic if predicted[d].held_out}
    assert len(held & kept) <= 0.12 * len(held)


def small_benchmark(spark, sf):
    return shared.table(spark, sf, "benchmark")


def test_pipeline_edges(spark, docs, tmp_path):
    """Nulls, repeated rows, columns of clashing names; and an empty table."""
    given = docs.selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars", "row", "spans", "kept_text", "key")
    for df, n in ((given, 1), (given.limit(0), 0)):
        current = df
        for name, stage in corpus_pipeline.STAGES:
            current = shared.written(stage(spark, current, SF), "stage")
            assert name == "byte-level bpe" or current.columns == df.columns
        assert current.where("doc_id is null").count() == 2 * n and current.where("doc_id = 2").count() == 0


@pytest.mark.parametrize("key", list(queries.oracle_sql()))
def test_matches_sql(spark, con, key):
    from oracle_check import differences

    assert differences(queries.queries()[key](spark, SF), con, queries.oracle_sql()[key]) == []


def test_workers_get_the_package(spark):
    assert shared.ready(spark) is spark and spark.sparkContext.applicationId in shared._READY


def test_byte_bpe_takes_one_worker_a_task(spark, docs, tiktoken_encoding):
    """pipeline: encoding and decoding are one Python step, so later steps of an executor find no more workers than cores."""
    steps = (corpus_pipeline.tokenize(spark, docs, SF), queries.op8_byte_level_bpe(spark, SF))
    for df in steps:
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = rows_of(byte_bpe.round_trip(docs, "byte_bpe_multi_50k.tiktoken"), "doc_id", "ids", "decoded")
    same(found, [(d, tiktoken_encoding.encode_ordinary(t or ""), (t or "").encode()) for d, t in EDGES])


def test_byte_bpe_plain_pieces_need_no_pattern():
    """F-op8: words of letters and marks are cut without the pattern, and a pre-token with its blank is remembered once."""
    import public_tokenizers

    text = "Ein größeres, don't — it's x² ﬁn Éa's 12a a12 ŉb ×c ÷d a×b ɏz ɐz _a a_ 'sa s' áb .\n\nnext," + " wort" * 9
    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec, plain = byte_bpe.Codec(file, public_tokenizers.PATTERN), byte_bpe.Codec(file, public_tokenizers.PATTERN)
    found = [plain.merge([m.encode()])[0].tobytes() for m in plain.matches(text)]
    assert codec.encode([text, "", text]) == [b"".join(found), b"", b"".join(found)]
    codec, cut = byte_bpe.Codec(file, public_tokenizers.PATTERN), []
    pattern = codec.matches
    codec.matches = lambda x: cut.append(x) or pattern(x)
    codec.encode(["eins zwei, drei!! zwei größe."])
    assert cut == ["eins"]
    assert set(codec.pieces[0]) == {"zwei,", "zwei", "drei!!", "drei", "größe.", "größe"} and " zwei" not in codec.known[0]


def test_toxicity_keys_travel_packed(spark):
    """op2: a wanted key takes less than 7 bytes on its way, one that is known less than 11, and none is lost at the ends of a range."""
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 59, 30_000, dtype=np.uint64)) | np.uint64(31 << 59)
    keys[-1] = np.uint64(2**64 - 1)
    known = {int(k): np.float32(v) for k, v in zip(keys[::2], rng.normal(size=len(keys)))} | {int(keys[-1]): np.float32(7)}
    packed = toxicity._pack_keys(keys)
    assert len(packed) < 7 * len(keys)
    order = rng.permutation(len(known))
    left = pa.table({"key": np.array(list(known), np.uint64).view(np.int64)[order], "d": np.array(list(known.values()))[order]})
    right = pa.table({"block": [3, 4], "n": [len(keys), 1], "keys": [packed, toxicity._pack_keys(keys[1:2])]})
    met = toxicity._met(left, right).to_pylist()
    assert [(x["block"], x["n"]) for x in met] == [(3, len(known))] and len(met[0]["keys"]) < 11 * len(known)
    found, d = toxicity._unpack_keys(met[0]["keys"], met[0]["n"], True)
    assert dict(zip(found.tolist(), d)) == known
    assert toxicity._met(left.slice(0, 0), right).num_rows == 0
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    made = shared.written(spark.range(0, 25, 1, 1).mapInArrow(sizes, "n long"), "sizes", batch=10)
    assert max(r.n for r in made.collect()) == 10 and spark.conf.get(rows) == before


def test_near_duplicates_travel_in_small_batches(spark, docs, monkeypatch):
    """op10: steps whose rows hold texts or sets bound the rows of an Arrow batch; all pairs of a large group are one task's."""
    asked, write = {}, near_dedup.written

    def noted(df, name, **options):
        asked.setdefault(name, []).append(options.get("batch"))
        return write(df, name, **options)

    monkeypatch.setattr(near_dedup, "written", noted)
    copies = [(i, f"{'lorem ipsum dolor sit amet ' * 3}{' '.join(f'w{j}' for j in range(60))} end{i}") for i in range(1200)]
    found = near_dedup.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0} and len(found) == 1200
    for name in ("signatures", "sets", "confirmed"):
        assert all(n and n <= 500 for n in asked[name]), (name, asked)


def test_toxicity_sums_hold_their_rows_once():
    """pipeline: what a range's rows take while they are summed; before, more than 300 bytes a row of pairs."""
    import tracemalloc

    rng, packs = np.random.default_rng(1), []
    words = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    expected = collections.Counter()
    for _ in range(20):
        a, b = words[(rng.random((2, 10_000)) ** 3 * len(words)).astype(int)]
        counts = rng.integers(0, 4, (10_000, 4))
        order = np.lexsort((b, a))
        packs.append(toxicity._pack(a[order], b[order], counts[order]))
        for x, y, n in zip(a.tolist(), b.tolist(), counts[:, 0].tolist()):
            expected[x, y] += n
    table = pa.table({"part": [1] * 20, "pair": [True] * 20, "n": [10_000] * 20, "packed": pa.array(packs, pa.binary())})
    tracemalloc.start()
    found = toxicity._entries(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * 200_000, peak
    rows = found.to_pylist()
    after = collections.Counter(x for x, _ in expected)
    mask = 2**64 - 1
    assert {x["a"] & mask: x["right_all"] for x in rows if not x["pair"] and x["right_all"]} == after
    pairs = {(x["a"] & mask, x["b"] & mask): x["toxic"] for x in rows if x["pair"]}
    assert pairs and all(expected[k] == n for k, n in pairs.items())
