"""Order that a replay must keep: conflict edges, levels and frontiers.

Edges come from windows over each key, never from a self-join of the log: a
write starts an epoch of its key; reads belong to the epoch before them, and
the next write waits for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrolens.lineage import cut

from .running import before


def with_epochs(accesses: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """One row per (key, gid) with reads, writes, the number of writes before it
    (epoch), the gid of the last of them (writer) and whether the access just
    before it wrote (after_write). A hot key is dealt over many tasks."""
    one = accesses.groupBy(*key, "gid").agg(F.bool_or(F.col("rw") == "R").alias("reads"), F.bool_or(F.col("rw") == "W").alias("writes"))
    wrote = F.when(F.col("writes"), F.col("gid"))
    return before(one, key, ["gid"], {"epoch": ("count", wrote), "writer": ("last", wrote), "after_write": ("last", F.col("writes"))}, parts)


def edges(accesses: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """(src, dst): transactions of which the first must precede the second;
    ``accesses``: (gid, rw, *key), equality of keys."""
    e = with_epochs(accesses, key, parts)
    after_write = e.where("writer IS NOT NULL").select(F.col("writer").alias("src"), F.col("gid").alias("dst"))
    readers = e.where("reads AND NOT writes").select(*key, "epoch", F.col("gid").alias("src"))
    writers = e.where("writes").select(*key, "epoch", F.col("gid").alias("dst"))
    before_write = readers.join(writers, [*key, "epoch"]).select("src", "dst")
    return after_write.union(before_write).distinct()


def key_levels(accesses: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """(*key, gid, level) where each transaction touches one key: all reads of an
    epoch share a level, each write has its own. No iteration is needed."""
    e = with_epochs(accesses, key, parts)
    # a level begins at a write, and at the first read after a write; not at a key's first access
    starts = F.when(F.col("after_write").isNotNull() & (F.col("writes") | F.col("after_write")), 1).otherwise(0)
    step = e.select(*key, "gid", starts.alias("starts"))
    return before(step, key, ["gid"], {"so_far": ("sum", F.col("starts"))}, parts).select(*key, "gid", (F.coalesce("so_far", F.lit(0)) + F.col("starts")).alias("level"))


def levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(gid, level): the longest chain of edges that ends at each node, frontier
    by frontier; as many rounds as the longest chain."""
    done = cut(nodes.select("gid").join(links.select(F.col("dst").alias("gid")), "gid", "left_anti").withColumn("level", F.lit(0)))
    rest = cut(nodes.select("gid").join(done, "gid", "left_anti"))
    level = 0
    while not rest.isEmpty():
        waits = links.join(rest.select(F.col("gid").alias("src")), "src", "left_semi").select(F.col("dst").alias("gid")).distinct()
        level += 1
        ready = cut(rest.join(waits, "gid", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            raise ValueError("the edges have a cycle")
        done, rest = cut(done.union(ready)), cut(rest.join(ready, "gid", "left_anti"))
    return done


def frontier(nodes: DataFrame, links: DataFrame, finished: DataFrame) -> DataFrame:
    """Nodes that may run now: not finished, with no unfinished predecessor."""
    open_ = nodes.select("gid").join(finished.select("gid"), "gid", "left_anti")
    held = links.join(open_.select(F.col("gid").alias("src")), "src", "left_semi").select(F.col("dst").alias("gid"))
    return open_.join(held, "gid", "left_anti")


def overlap_edges(items: DataFrame, bucket: float) -> DataFrame:
    """(src, dst) of accesses (gid, rw, column, lo, hi, lo_closed, hi_closed)
    with numeric ends whose intervals overlap, at least one of them writing.

    Bounded intervals are dealt to the buckets of ``bucket`` units that they
    cover and met there on equality; a pair counts in the first bucket that both
    cover, so it comes up once. Unbounded ones are few (scans) and meet all."""
    a = items.alias("a")
    bounded = items.where("lo IS NOT NULL AND hi IS NOT NULL")
    dealt = bounded.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    x, y = dealt.alias("a"), dealt.alias("b")
    clash = (F.col("a.gid") < F.col("b.gid")) & ((F.col("a.rw") == "W") | (F.col("b.rw") == "W"))
    low = F.greatest(F.col("a.lo"), F.col("b.lo"))
    over = (F.col("a.lo") < F.col("b.hi")) | ((F.col("a.lo") == F.col("b.hi")) & F.col("a.lo_closed") & F.col("b.hi_closed"))
    over = over & ((F.col("b.lo") < F.col("a.hi")) | ((F.col("b.lo") == F.col("a.hi")) & F.col("b.lo_closed") & F.col("a.hi_closed")))
    near = x.join(y, (F.col("a.column") == F.col("b.column")) & (F.col("a.bucket") == F.col("b.bucket")) & clash & over & (F.floor(low / bucket) == F.col("a.bucket")))
    wide = items.where("lo IS NULL OR hi IS NULL").alias("b")
    reach = (F.col("b.lo").isNull() | F.col("a.hi").isNull() | (F.col("b.lo") < F.col("a.hi")) | ((F.col("b.lo") == F.col("a.hi")) & F.col("b.lo_closed") & F.col("a.hi_closed"))) & (
        F.col("b.hi").isNull() | F.col("a.lo").isNull() | (F.col("a.lo") < F.col("b.hi")) | ((F.col("a.lo") == F.col("b.hi")) & F.col("a.lo_closed") & F.col("b.hi_closed"))
    )
    far = a.join(wide, (F.col("a.column") == F.col("b.column")) & (F.col("a.gid") != F.col("b.gid")) & ((F.col("a.rw") == "W") | (F.col("b.rw") == "W")) & reach)
    pairs = near.select(F.col("a.gid").alias("src"), F.col("b.gid").alias("dst")).union(far.select(F.least("a.gid", "b.gid").alias("src"), F.greatest("a.gid", "b.gid").alias("dst")))
    return pairs.distinct()


def edges_with_wildcards(accesses: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """(src, dst) as edges(), where an access whose key is null is the wildcard
    and conflicts with every access. A wildcard is a barrier: what has no
    successor since the barrier before it must precede it, and it precedes what
    has no predecessor after it, so no wildcard meets the whole log."""
    wild = F.col(key[0]).isNull()
    marked = accesses.groupBy(*key, "gid").agg(F.bool_or(F.col("rw") == "R").alias("reads"), F.bool_or(F.col("rw") == "W").alias("writes"))
    barriers = marked.where(wild).select("gid").distinct()
    both = marked.join(barriers, "gid", "left_anti").select("gid", *key, "reads", "writes").withColumn("_wall", F.lit(False))
    walls = barriers.select("gid", *[F.lit(None).cast(accesses.schema[k].dataType).alias(k) for k in key], F.lit(True).alias("reads"), F.lit(True).alias("writes"), F.lit(True).alias("_wall"))
    # one order for all: dealt by range like any hot key
    lined = both.unionByName(walls).withColumns({"_all": F.lit(0), "_wall_gid": F.when(F.col("_wall"), F.col("gid")), "_mark": F.concat_ws("|", *[F.col(k).cast("string") for k in key])})
    lined = cut(before(lined, ["_all"], ["gid", "_mark"], {"walls": ("count", F.col("_wall_gid")), "wall": ("last", F.col("_wall_gid"))}, parts))
    inner = lined.where(~F.col("_wall")).select("gid", *key, "walls", "wall", F.explode(F.array_compact(F.array(F.when(F.col("reads"), "R"), F.when(F.col("writes"), "W")))).alias("rw"))
    within = edges(inner.select("gid", "rw", *key, "walls"), [*key, "walls"], parts)
    one = inner.groupBy(*key, "walls", "wall", "gid").agg(F.bool_or(F.col("rw") == "W").alias("writes"))
    stretch = one.groupBy(*key, "walls").agg(F.min(F.when(F.col("writes"), F.col("gid"))).alias("first_write"), F.max(F.when(F.col("writes"), F.col("gid"))).alias("last_write"), F.min("gid").alias("first"), F.max("gid").alias("last"))
    ends = one.join(stretch, [*key, "walls"]).select("gid", "walls", "wall", "writes", "first_write", "last_write", "first", "last")
    tail = F.when(F.col("writes"), F.col("gid") == F.col("last")).otherwise(F.col("last_write").isNull() | (F.col("gid") > F.col("last_write")))
    head = F.when(F.col("writes"), F.col("gid") == F.col("first")).otherwise(F.col("first_write").isNull() | (F.col("gid") < F.col("first_write")))
    wall = lined.where("_wall").select("walls", F.col("gid").alias("wall_gid"))
    into = ends.where(tail).join(wall, "walls").select(F.col("gid").alias("src"), F.col("wall_gid").alias("dst"))
    out = ends.where(head & F.col("wall").isNotNull()).select(F.col("wall").alias("src"), F.col("gid").alias("dst"))
    chain = lined.where("_wall AND wall IS NOT NULL").select(F.col("wall").alias("src"), F.col("gid").alias("dst"))
    return within.union(into).union(out).union(chain).distinct()
