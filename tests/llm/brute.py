"""Plain versions of the operators, one text at a time."""

from __future__ import annotations

import re
from collections import defaultdict

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, k=5):
    words = SPACE_WORDS.findall(ascii_lower(text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(texts: dict) -> dict:
    """doc_id -> smallest doc_id that links of 0.75 reach; texts are doc_id -> list of texts."""
    sets = [(d, shingles(t)) for d, ts in texts.items() for t in ts]
    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(i)
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in holders[g]:
                if j > i:
                    common[j] += 1
        for j, both in common.items():
            if 100 * both >= 75 * (len(s) + len(sets[j][1]) - both):
                a, b = sorted((find(d), find(sets[j][0])))
                root[b] = a
    return {d: find(d) for d in texts}


def without_repeats(rows: list, window=35) -> list:
    """(doc_id, text) rows -> (doc_id, n_words, n_removed, kept text)."""
    seen = defaultdict(int)
    words = [SPACE_WORDS.findall(t or "") for _, t in rows]
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] += 1
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(rows: list, items: list, window=10) -> list:
    """(doc_id, text) rows -> (doc_id, n_words, n_hit, sorted item ids as strings)."""
    held = defaultdict(set)
    for item, text in items:
        w = ITEM_WORDS.findall(ascii_lower(text or ""))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            held[tuple(w[i : i + window])].add(item)
    sizes = sorted({len(w) for w in held})
    out = []
    for d, text in rows:
        w, hit, found = ITEM_WORDS.findall(ascii_lower(text or "")), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in held:
                    hit.update(range(i, i + n))
                    found |= held[x]
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out
