"""Tier 5: findings framed for a persona as text, or silence."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.functions.numeric import half_up, short_number
from tierwise.specs import FindingSpec, Framing

PLACEHOLDER = re.compile(r"\{\{([^}]+)\}\}")


def variables(spec: FindingSpec) -> dict[str, Column]:
    """Template variables of a classified row, as text columns."""

    def number(name: str) -> Column:
        return short_number(half_up(F.col(name), 2))

    out = {
        "region": F.col("entity"),
        "territory": F.coalesce(F.col("territory_name"), F.lit("")),
        "rank": F.col("mat_rank").cast("string"),
        "finding": F.col("finding_key"),
        "finding_label": F.col("finding_label"),
        "severity_band": F.col("severity_band"),
        "severity_score": F.col("severity_score").cast("string"),
        "months_red": F.col("months_red").cast("string"),
    }
    for a in spec.axes:
        for part in ("now", "oldest", "net", "coherence", "magnitude"):
            out[f"{a.name}_{part}"] = number(f"{a.name}_{part}")
        out[f"{a.name}_shape"] = F.col(f"{a.name}_shape")
    return out


def render(template: str, known: dict[str, Column]) -> Column:
    """The template as one concat of literals and columns; unknown names are marked in the text."""
    pieces: list[Column] = []
    last = 0
    for m in PLACEHOLDER.finditer(template):
        pieces.append(F.lit(template[last : m.start()]))
        name = m.group(1).strip()
        pieces.append(F.coalesce(known[name], F.lit("")) if name in known else F.lit(f"{{{{UNKNOWN:{name}}}}}"))
        last = m.end()
    pieces.append(F.lit(template[last:]))
    return F.concat(*pieces)


def gate(framing: Framing) -> Column:
    """Silence unless some surface condition holds (or none is set) and no suppress condition does."""
    surface = F.lit(not framing.surface)
    for condition in framing.surface:
        surface = surface | F.coalesce(F.expr(condition), F.lit(False))
    for condition in framing.suppress:
        surface = surface & ~F.coalesce(F.expr(condition), F.lit(False))
    return surface


def insights(rows: DataFrame, spec: FindingSpec, framings: Sequence[Framing]) -> DataFrame:
    """One row per finding and framing of its key: the text, and whether it surfaces.

    Framings are configuration and unfold in place: there are few finding keys, so a join on them
    would be as skewed as the findings are.
    """
    known = variables(spec)
    matching = [
        F.when(
            F.col("finding_key") == f.finding_key,
            F.struct(F.lit(f.id).alias("framing_id"), F.lit(f.persona).alias("persona")),
        )
        for f in framings
    ]
    joined = rows.select("*", F.inline(F.array_compact(F.array(*matching))))
    text, shown = F.lit(None).cast("string"), F.lit(False)
    for f in framings:
        mine = F.col("framing_id") == f.id
        text = F.when(mine, render(f.template, known)).otherwise(text)
        shown = F.when(mine, gate(f)).otherwise(shown)
    return joined.withColumns({"text": text, "surfaces": shown})


def top_insights(rows: DataFrame, n: int = 5) -> DataFrame:
    """The n most severe findings per framing and brand, ties by rank and name."""
    order = W.partitionBy("framing_id", "brand_name").orderBy(
        F.desc("severity_score"), F.desc("mat_rank"), "entity"
    )
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
