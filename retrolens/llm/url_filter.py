"""URL filter: explicit rules first, then a learnt tree of path templates.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end. A rule (host,
path) fits its host and all subdomains if the path starts with its path; the
longest rule wins.

Template tree, per host: segments that are numbers or hexadecimal strings, or
that contain digits, are generalised by shape. The addresses are then counted
by host and shape, so that all further work is on that small table. Level by
level, below each prefix, a prefix merges its variable segments into the wildcard
``*``: of several children, however many, those whose labelled rate of bad pages doesn't differ from that of all children of
the prefix (a two-sided z-test at ``Z``) are merged into the branch ``*`` as
well, and only those that differ keep a branch of their own. An only child keeps
its name. There is no limit to the depth: an address leaves the rounds where it
ends or is the only one left below its prefix, since what follows has one child
at each level.

A template is rejected if its smoothed purity, (bad + PRIOR_WEIGHT * rate) /
(labelled + PRIOR_WEIGHT) with the rate of all labelled pages, is at least
``REJECT``. Bad: quality 0 or toxic 1; a page's label is that of the document
with its id.

Defined results: null urls and urls without ``://`` have an empty host and path
and share a template; equal rows are judged alike, each by itself; without
labels nothing is rejected; labels of one id that disagree count as bad if any
is; an id that is no integer is carried as null; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, look_up, row_id

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
Z = 2.58
PRIOR_WEIGHT, REJECT = 10.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The name and the verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is the outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """A path segment with its variable parts generalised."""
    return F.when(segment.rlike(r"^[0-9]+$"), F.lit("{n}")).when(segment.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{x}")).otherwise(F.regexp_replace(segment, r"[0-9]+", "{n}"))


def _shapes(path: Column) -> Column:
    """The segments by shape."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), shape)


def _branches(children: DataFrame) -> DataFrame:
    """(host, template, segment, rows, branch, held): the branch that each child
    of a prefix goes to, and the addresses that the branch holds. ``children``:
    (host, template, segment, rows, l, b), one row each, with labelled and bad
    pages."""
    parents = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kinds"), F.sum("l").alias("all_l"), F.sum("b").alias("all_b"), F.sum("rows").alias("all_rows"))
    both = look_up(children, cut(parents), ["host", "template"], "kinds", children.count())
    rate = F.col("all_b") / F.greatest(F.col("all_l"), F.lit(1))
    spread = F.sqrt(rate * (1 - rate) / F.greatest(F.col("l"), F.lit(1)))
    differs = (F.col("l") > 0) & (F.abs(F.col("b") / F.greatest(F.col("l"), F.lit(1)) - rate) > Z * spread)
    named = both.withColumn("own", (F.col("kinds") == 1) | differs | (F.col("segment") == "*"))
    stars = named.where(~F.col("own")).groupBy("host", "template").agg(F.sum("rows").alias("merged"), F.count(F.lit(1)).alias("n"))
    own = named.where("own").select("host", "template", "segment", "rows", F.col("segment").alias("branch"), F.when(F.col("segment") == "*", F.col("all_rows")).otherwise(F.col("rows")).alias("held"))
    rest = look_up(named.where(~F.col("own")).select("host", "template", "segment", "rows"), cut(stars), ["host", "template"], "n", children.count())
    return own.unionByName(rest.select("host", "template", "segment", "rows", F.lit("*").alias("branch"), F.col("merged").alias("held")))


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, shapes, template, n, labelled, bad, purity, pages): each address
    shape of ``pages`` (page_id, host, shapes) with its number of pages and the
    template it was merged into."""
    rated = labels.groupBy(row_id("doc_id").alias("page_id")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    counted = pages.select("page_id", "host", "shapes").join(rated, "page_id", "left")
    tree = counted.groupBy("host", "shapes").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    grow = cut(tree.withColumn("template", F.array().cast("array<string>")))
    total = grow.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("rows")).first()
    rate, left = total["b"] / total["l"] if total["l"] else 0.0, total["rows"]
    columns, done, level = ["host", "shapes", "n", "labelled", "bad", "template"], [], 0
    while left:
        segment = F.get("shapes", F.lit(level))
        children = cut(grow.where(segment.isNotNull()).groupBy("host", "template", segment.alias("segment")).agg(F.count(F.lit(1)).alias("rows"), F.sum("labelled").alias("l"), F.sum("bad").alias("b")))
        named = cut(_branches(children))
        done.append(grow.where(segment.isNull()))
        level += 1
        more = look_up(grow.where(segment.isNotNull()).withColumn("segment", segment), named, ["host", "template", "segment"], "rows", left)
        more = cut(more.withColumn("template", F.concat("template", F.array("branch"))).select(*columns, "held"))
        tail = F.slice("shapes", F.lit(level + 1), F.greatest(F.size("shapes") - level, F.lit(0)))  # beyond the end it is empty
        done.append(more.where("held = 1").withColumn("template", F.concat("template", tail)).select(*columns))
        grow = more.where("held > 1").select(*columns)
        left = grow.count()
    tree = grow.select(*columns) if not done else done[0]
    for part in done[1:]:
        tree = tree.unionByName(part)
    tree = cut(tree.withColumn("template", F.concat_ws("/", "template")))
    merged = tree.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("rows"))
    merged = cut(merged.withColumn("purity", (F.col("bad") + PRIOR_WEIGHT * rate) / (F.col("labelled") + PRIOR_WEIGHT)))
    return look_up(tree.select("host", "template", "shapes", F.col("n").alias("pages")), merged, ["host", "template"], "rows", total["rows"]).drop("rows")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), a row per input row."""
    rows = pages.select(row_id(key).alias("page_id"), F.col(url).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("shapes", _shapes(F.col("path")))
    learnt = cut(templates(rows, labels).select("host", "shapes", "template", "purity", "pages"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    total = learnt.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    judged = look_up(rows, learnt, ["host", "shapes"], "pages", total)
    by_tree = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_tree).alias("verdict"), "template", "purity")
