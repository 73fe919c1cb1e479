"""Clusters of every brand month and their matching, against a plain version."""

from __future__ import annotations

import itertools
import random

import pytest

from tierwise.operators import clusters, order

COLUMNS = "brand_name string, year_month string, period_type string, entity string, growth double, deviation double, rank double"
AXES = ("growth", "deviation", "rank")


def plain(rows, k, steps):
    """(brand, month, period, entity) -> (now, before, changed)"""
    def div(a, b):
        return int(a / b) if abs(a) < 1 << 40 else (abs(a) // b) * (1 if a > 0 else -1)

    groups = {}
    for brand, month, period, entity, *xyz in rows:
        groups.setdefault((brand, period), {}).setdefault(month, {})[entity] = tuple(round(x * clusters.UNIT) for x in xyz)
    away = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    out = {}
    for (brand, period), months in groups.items():
        last = None
        for month in sorted(months):
            points = months[month]
            ends = [(min(x), max(x)) for x in zip(*points.values())]
            centres = [tuple(a + div((b - a) * (2 * j + 1), 2 * k) for a, b in ends) for j in range(k)]
            near = lambda x: min(range(k), key=lambda j: (away(x, centres[j]), j))  # noqa: B023, E731
            for _ in range(steps):
                of = {e: near(x) for e, x in points.items()}
                for j in range(k):
                    held = [points[e] for e in points if of[e] == j]
                    if held:
                        centres[j] = tuple(div(sum(x), len(held)) for x in zip(*held))
            of = {e: near(x) for e, x in points.items()}
            if last:
                before, was = last
                way = min(itertools.permutations(range(k)), key=lambda w: (sum(away(before[i], centres[j]) for i, j in enumerate(w)), w))
                for e in points:
                    if e in was:
                        out[brand, month, period, e] = (of[e], way[was[e]], way[was[e]] != of[e])
            last = centres, of
    return out


def made(seed, entities, months=5):
    rng = random.Random(seed)
    rows = []
    for brand, period in (("a", "MAT"), ("a", "Month"), ("b", "MAT")):
        n = entities if (brand, period) == ("a", "MAT") else 7
        for m in range(months):
            if (brand, m) == ("b", 2):
                continue  # a month without points
            for e in range(n):
                if rng.random() < 0.1:
                    continue
                at = (e % 4) * 3 + (m if e == 5 else 0) * 2.5
                rows.append((brand, f"2020-{m + 1:02}", period, f"e{e}", *[round(rng.gauss(at, 1) * s, 3) for s in (1, -0.3, 0.5)]))
    rows += [("c", f"2021-{m + 1:02}", "MAT", f"e{e}", 1.0, 1.0, 1.0) for m in range(2) for e in range(9)]  # all in one place
    rows += [("d", "2021-01", "MAT", "e1", 0.0, 0.0, 0.0), ("d", "2021-02", "MAT", "e1", -9.0, 0.0, 0.0)]  # fewer points than clusters
    return rows


@pytest.mark.parametrize("salt_rows", [100_000, 40])
def test_cluster_change(spark, monkeypatch, salt_rows):
    """With 40 points a task the large brand month is dealt to several."""
    monkeypatch.setattr(order, "LARGE", salt_rows)
    rows = made(3, 300)
    found = clusters.cluster_change(spark.createDataFrame(rows, COLUMNS)).collect()
    expected = plain(rows, clusters.CLUSTERS, clusters.STEPS)
    assert {(r.brand_name, r.year_month, r.period_type, r.entity): (r.cluster_now, r.cluster_before, r.changed) for r in found} == expected
    assert 0 < sum(x[2] for x in expected.values()) < len(expected) / 2
    assert all((r.strength == "high") == r.changed and r.name_now.startswith(("High", "Low")) for r in found)


def test_renumbered_centres_are_matched(spark):
    """Two groups that swap their places in the order of the start stay what they are."""
    rows = []
    for m, (x, y) in enumerate(((0.0, 10.0), (6.0, 5.0), (12.0, 0.0))):
        for e in range(6):
            rows += [("a", f"2020-0{m + 1}", "MAT", f"low{e}", x + e / 10, 0.0, 0.0), ("a", f"2020-0{m + 1}", "MAT", f"high{e}", y + e / 10, 40.0, 40.0)]
    found = clusters.cluster_change(spark.createDataFrame(rows, COLUMNS), k=2).collect()
    assert len(found) == 24 and not any(r.changed for r in found)


def test_no_points(spark):
    assert clusters.cluster_change(spark.createDataFrame([], COLUMNS)).isEmpty()
