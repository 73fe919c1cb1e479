"""URL filters: rules first, then a tree of path templates for each host, in DataFrame functions only.

A rule names a host and a path; it fits the host and its subdomains where the path begins so, and the longest decides. What rules
decide are the labels of the tree. A path is cut into segments; runs of digits and long hexadecimal names become wildcards at
once. Then, from the root down, a place becomes a wildcard where its URLs spread over more than BRANCHES branches in effect
(the inverse of the summed squares of their shares). From the leaves up, branches of one place merge that have the same main
children, each at least 1 in CHILDREN of the branch's URLs; where labelled ones among them contradict each other, each kind merges
by itself. A template's purity is the blocked share of its labelled URLs, smoothed towards the share over all labelled
URLs (a half at most) by SMOOTHING pseudo-URLs; templates from PURITY on are blocked.

Evidence are different URLs without query and fragment, so repeated pages change nothing, and everything but EVIDENCE, the URLs
a branch needs to be known at all, is a share. Paths are told apart at any depth; the steps visit the places where paths part only. All
steps work on distinct generalised paths with their counts, which partial sums collapse before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwise.llm.shared import written

BRANCHES = 16  # a place with more branches in effect is variable
CHILDREN = 8  # a main child has at least one in so many of its branch's URLs
EVIDENCE = 5  # different URLs that a branch needs to be compared
SMOOTHING = 5.0
PURITY = 0.8
WILD, SIMILAR = "*", "+"  # a variable segment, merged branches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: str) -> tuple[Column, Column]:
    """What follows the first :// up to /, ? or #, in ASCII lower case, and what follows it up to ? or #; else both empty."""
    host = F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matched(rules: list[tuple[str, str, str]], host: str, path: str) -> Column:
    """The longest rule (action, host, path) that fits, as a struct (rule, action); null where none does."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit(f".{h}"))) & F.startswith(F.col(path), F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def segments(path: str) -> Column:
    """The segments of a path with fixed wildcards: {n} for digits, {x} for hexadecimal names of eight characters or more."""
    s = F.filter(F.split(path, "/"), lambda x: x != "")
    named = F.transform(s, lambda x: F.when(x.rlike("^[0-9a-fA-F-]{8,}$") & x.rlike("[0-9]") & x.rlike("[a-fA-F-]"), "{x}").otherwise(x))
    return F.transform(named, lambda x: F.regexp_replace(x, "[0-9]+", "{n}"))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "bad", "good")]


def _replaced(place: int, token: Column) -> Column:
    """template with another token at a place."""
    after = F.slice("template", F.lit(place + 2), F.greatest(F.size("template") - place - 1, F.lit(0)))
    return F.concat(F.slice("template", 1, place), F.array(token), after)


def _next_place(paths: DataFrame, place: int) -> int | None:
    """The first place from here on where paths part that agree before it."""
    nodes = paths.where(F.size("template") > place).select("host", "template", F.posexplode("template").alias("place", "token"))
    before = F.xxhash64(F.slice("template", F.lit(1), F.col("place"))).alias("before")
    nodes = nodes.where(F.col("place") >= place).groupBy("host", "place", before)
    return nodes.agg(F.min("token").alias("first"), F.max("token").alias("last")).where("first < last").agg(F.min("place")).first()[0]


def _generalised(paths: DataFrame, place: int) -> DataFrame:
    """template with a wildcard at a place that has many branches in effect; the places before are settled."""
    before, here = F.slice("template", 1, place), F.get("template", F.lit(place))
    branches = paths.where(F.size("template") > place).groupBy("host", before.alias("before"), here.alias("token")).agg(F.sum("n").alias("n"))
    spread = F.sum(F.col("n").cast("double") * F.col("n"))
    variable = branches.groupBy("host", "before").agg(F.sum("n").cast("double").alias("n"), spread.alias("squares"))
    variable = variable.where(BRANCHES * F.col("squares") < F.col("n") * F.col("n")).select("host", "before", F.lit(True).alias("variable"))
    joined = paths.withColumn("before", before).join(variable, ["host", "before"], "left")
    wild = F.when(F.col("variable") & (F.size("template") > place), _replaced(place, F.lit(WILD))).otherwise(F.col("template"))
    return joined.withColumn("template", wild).drop("before", "variable")


def _merged(paths: DataFrame, place: int) -> DataFrame:
    """template with SIMILAR at a place for branches that are alike; of several such groups all but the largest are named too."""
    node, branch = ["host", "before"], ["host", "before", "token"]
    before, here = F.slice("template", 1, place), F.get("template", F.lit(place))
    child = F.coalesce(F.get("template", F.lit(place + 1)), F.lit("")).alias("child")
    each = paths.where(F.size("template") > place).groupBy("host", before.alias("before"), here.alias("token"), child).agg(*_sums())
    whole = each.groupBy(*branch).agg(*_sums()).where(F.col("n") >= EVIDENCE)
    main = each.join(whole.select(*branch, F.col("n").alias("total")), branch).where(F.col("n") * CHILDREN >= F.col("total"))
    main = main.groupBy(*branch).agg(F.array_sort(F.collect_set("child")).alias("children"))  # CHILDREN at most
    labelled = F.col("bad") + F.col("good")
    kind = F.when(labelled == 0, None).when(F.col("bad") >= PURITY * labelled, "bad").when(F.col("good") >= PURITY * labelled, "good").otherwise("mixed")
    known = whole.select(*branch, "n", kind.alias("kind")).join(main, branch)
    kinds = known.groupBy(*node, "children").agg(F.min("kind").alias("first_kind"), F.max("kind").alias("last_kind"))
    agreed = F.coalesce(F.col("first_kind") == F.col("last_kind"), F.lit(True))
    part = F.when(agreed, "").otherwise(F.coalesce("kind", F.lit("none")))
    known = known.join(kinds, [*node, "children"]).withColumn("part", part)
    groups = known.groupBy(*node, "children", "part").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("token").alias("first")).where("k > 1")
    largest = groups.groupBy(*node).agg(F.min_by("first", F.struct(-F.col("n"), F.col("first"))).alias("largest"))
    name = F.when(F.col("first") == F.col("largest"), SIMILAR).otherwise(F.concat(F.lit(SIMILAR), "first"))
    groups = groups.join(largest, node).select(*node, "children", "part", name.alias("name"))
    alike = known.join(groups, [*node, "children", "part"]).select(*branch, "name")
    joined = paths.withColumn("before", before).withColumn("token", here).join(alike, branch, "left")
    new = F.when(F.col("name").isNotNull(), _replaced(place, F.col("name"))).otherwise(F.col("template"))
    return joined.withColumn("template", new).drop("before", "token", "name")


def tree(urls: DataFrame) -> DataFrame:
    """host, segments, template (text), purity and labelled (different URLs) of every distinct generalised path.

    urls has host, path, segments (of the path), and label: "block", "allow" or null. Of several labels of a path "block" counts.
    """
    different = urls.groupBy("host", "path").agg(F.any_value("segments").alias("segments"), F.max("label").alias("label"))
    count = lambda label: F.count(F.when(F.col("label") == label, 1))
    paths = different.groupBy("host", "segments").agg(F.count("*").alias("n"), count("block").alias("bad"), count("allow").alias("good"))
    paths = written(paths.withColumn("template", F.col("segments")), "paths")
    places, place = [], _next_place(paths, 0)
    while place is not None:
        places.append(place)
        paths = written(_generalised(paths, place), "paths")
        place = _next_place(paths, place + 1)
    for place in reversed(places):
        paths = written(_merged(paths, place), "paths")
    bad, good = paths.agg(F.sum("bad"), F.sum("good")).first()
    share = min(0.5, (bad or 0) / max(1, (bad or 0) + (good or 0)))
    labelled = F.col("bad") + F.col("good")
    purity = (F.col("bad") + SMOOTHING * share) / (labelled + SMOOTHING)
    templates = paths.groupBy("host", "template").agg(*_sums()).select("host", "template", purity.alias("purity"), labelled.alias("labelled"))
    return paths.select("host", "segments", "template").join(templates, ["host", "template"]).select(
        "host", "segments", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", "labelled"
    )


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, url, host, path, rule, verdict (block or allow), template and purity for every row of pages (page_id, url).

    A null url, or one without ://, has an empty host and path; such URLs are one template. Rows that repeat a page are
    judged each. Without labelled URLs every purity is 0.
    """
    host, path = host_and_path("url")
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("found", matched(rules, "host", "path")).withColumn("segments", segments("path"))
    known = tree(urls.select("host", "path", "segments", F.col("found.action").alias("label")))
    verdict = F.coalesce("found.action", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return urls.join(known, ["host", "segments"], "left").select(
        "page_id", "url", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "purity"
    )
