"""Document fingerprints of spot signatures, in DataFrame functions only.

A spot is a common word; its signature is the word with the chain of content words that follow it, common words left out. As
lists and other languages lack these words, a word whose hash falls into one of eight classes is a spot too, and so is the
beginning of a text. A fingerprint is the set of a text's signatures, and two are compared by their Jaccard likeness.

For pairs above a threshold the sets are partitioned by length: sets of likeness t have lengths within a factor t, so a set
meets those of its own level of lengths and of the next. Within a level a set is looked up by its rarest signatures, as many as two
alike sets can't both miss, and pairs whose lengths or remaining signatures can't reach the threshold are pruned before
they are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierwise.llm.decontaminate import words
from tierwise.llm.shared import written

CHAIN = 2
CLASSES = 8
BUCKET_ROWS, MOST_BUCKETS = 5_000, 4_096

#: Common words of English, German, French and Spanish.
COMMON = (
    "the of and to in a is that it was for on are as with they at be this from or by not but had were an "
    "der die das und ist von mit den zu im ein eine nicht auf dem es sich "
    "le la les de des et un une du en est que qui dans pour au sur par pas "
    "el los las y por con para del se no como más"
).split()


def signatures(docs: DataFrame, text: str = "text", name: str = "signatures") -> DataFrame:
    """docs with the sorted distinct signatures (64-bit) of a text column; null texts are like empty ones.

    Where no chain is complete the one signature is that of all words together.
    """
    common = [F.lit(x) for x in COMMON]
    w, places, content = (f"_{name}_{x}" for x in ("words", "places", "content"))
    docs = docs.withColumn(w, words(text))
    at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*common), i)), lambda i: i.isNotNull())
    docs = docs.withColumn(places, at).withColumn(content, F.filter(w, lambda x: ~x.isin(*common)))
    # before the k-th common word at place i stand i - k content words
    chain = F.transform(places, lambda i, k: F.when(
        i - k + CHAIN <= F.size(content), F.xxhash64(F.get(w, i), F.slice(content, i - k + 1, CHAIN))))
    after_common = F.filter(chain, lambda x: x.isNotNull())
    marks = F.filter(F.transform(content, lambda x, i: F.when(
        (F.pmod(F.xxhash64(x), F.lit(CLASSES)) == 0) & (i + CHAIN < F.size(content)), F.xxhash64(x, F.slice(content, i + 2, CHAIN)))),
        lambda x: x.isNotNull())
    begin = F.when(F.size(content) >= CHAIN, F.array(F.xxhash64(F.lit(""), F.slice(content, 1, CHAIN)))).otherwise(F.array(F.xxhash64(w)))
    found = F.array_sort(F.array_distinct(F.concat(begin, after_common, marks)))
    return docs.withColumn(name, found).drop(w, places, content)


def fingerprint(signatures: str) -> Column:
    """A set of signatures as text: hexadecimal, in ascending order."""
    return F.array_join(F.transform(signatures, lambda x: F.hex(x)), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with bucket, by quantiles of doc_id (_id), and the number of buckets; the driver gets their bounds."""
    n, low = docs.agg(F.count("*"), F.min("_id")).first()
    size = min(MOST_BUCKETS, max(1, math.ceil(n / BUCKET_ROWS)))
    shares = [i / size for i in range(1, size)]
    bounds = docs.agg(F.percentile_approx("_id", shares, 20 * MOST_BUCKETS)).first()[0] if shares else []
    bounds = [low, *sorted(set(bounds) - {low})] if n else []
    step = math.isqrt(max(1, len(bounds))) + 1
    coarse = F.size(F.filter(F.lit(bounds[::step] or [0]), lambda b: b <= F.col("_id"))) - 1
    fine = F.slice(F.lit(bounds or [0]), F.greatest(coarse, F.lit(0)) * step + 1, step)
    bucket = F.greatest(coarse, F.lit(0)) * step + F.size(F.filter(fine, lambda b: b <= F.col("_id"))) - 1
    return docs.withColumn("bucket", bucket.cast("int")), len(bounds)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with next, a struct of these columns of the next row in ascending doc_id; after the last comes the first.

    Nulls come first, rows that repeat an id are ordered by their texts. The rows are cut into buckets of neighbouring ids, and a
    bucket's first row is also dealt to the bucket before, so one shuffle puts each row beside its next, and no task gets all.
    """
    docs = docs.withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63))))
    docs, n = _bucketed(docs)
    firsts = {r.bucket: r.first for r in docs.groupBy("bucket").agg(F.min("_id").alias("first")).collect()}
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}  # of the first bucket the last
    first = F.lit([firsts.get(b, 0) for b in range(max(n, 1))])
    previous = F.lit([before.get(b, 0) for b in range(max(n, 1))])
    own = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(F.get(previous, F.col("bucket")).alias("b"), F.lit(1).alias("guest"))
    dealt = F.when(F.col("_id") == F.get(first, F.col("bucket")), F.array(own, guest)).otherwise(F.array(own))
    rows = docs.withColumn("_d", F.explode(dealt)).withColumn("_b", F.col("_d.b")).withColumn("_guest", F.col("_d.guest"))
    w = Window.partitionBy("_b").orderBy("_guest", "_id", "text")
    rows = rows.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("_guest = 0")
    return rows.drop("_id", "_d", "_b", "_guest", "bucket")


def edited(docs: DataFrame) -> DataFrame:
    """Each row of docs (doc_id, text) with n_chars, signatures, next_signatures, edited_text and edited_signatures.

    In the edited text the second half of the characters gives way to the beginning of the next text. Null texts are like empty ones.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, ["text"])  # texts travel, signatures are made on both sides: they are longer than packed texts
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    text = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", F.col("next.text").alias("next_text"), text.alias("edited_text"))
    rows = signatures(signatures(rows, "text"), "next_text", "next_signatures").drop("text", "next_text")
    return signatures(rows, "edited_text", "edited_signatures")


def near_pairs(docs: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) between classes of equal sets, and the classes' members (doc_id, class_id).

    docs has doc_id and signatures; a class is named by its smallest doc_id. Rows with a null doc_id are passed over.
    """
    rows = docs.where("doc_id is not null").select("doc_id", "signatures", F.xxhash64("signatures").alias("key"))
    classes = rows.groupBy("key", "signatures").agg(F.min("doc_id").alias("id"))
    classes = written(classes.select("id", "key", "signatures", F.size("signatures").alias("n")), "spot-classes")
    members = rows.join(classes.select("key", "signatures", "id"), ["key", "signatures"]).select("doc_id", F.col("id").alias("class_id"))
    each = classes.select("id", "n", F.explode("signatures").alias("s"))
    counts = each.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("f", F.lit(1)), "s"))
    ranked = each.join(counts, "s", "left").withColumn("place", order)
    needed = ranked.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & F.col("f").isNotNull())
    level = F.floor(F.log("n") / F.log(F.lit(1 / threshold)) + 1e-9)
    a = needed.select("s", "id", "n", "place", F.explode(F.array(level, level + 1)).alias("level"))
    b = needed.select("s", F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), level.alias("level"))
    most = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) + F.least("place", "place_b")
    fits = (F.col("n") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n"))
    fits &= most >= threshold / (1 + threshold) * (F.col("n") + F.col("n_b")) - 1e-9
    fits &= (F.col("n") < F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("id") < F.col("id_b")))
    found = a.join(b, ["s", "level"]).where(fits).select("id", "id_b").distinct()
    x = classes.select("id", F.col("signatures").alias("x"))
    y = classes.select(F.col("id").alias("id_b"), F.col("signatures").alias("y"))
    pairs = found.join(x, "id").join(y, "id_b").withColumn("likeness", likeness("x", "y")).where(F.col("likeness") >= threshold)
    return pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"), "likeness"), members
