"""Clusters of key accesses: which transactions meet on which part of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrolens.functions.intervals import islands, islands_dealt
from retrolens.lineage import cut


def point_clusters(items: DataFrame) -> DataFrame:
    """(column, value, rw, n, first_gid, last_gid) of point accesses."""
    return items.groupBy("column", "value", "rw").agg(F.count(F.lit(1)).alias("n"), F.min("gid").alias("first_gid"), F.max("gid").alias("last_gid"))


def interval_clusters(items: DataFrame, parts: int | None = None) -> DataFrame:
    """``items`` (gid, rw, column, lo, hi, lo_closed, hi_closed) with the cluster
    they merge into by overlap. Equal intervals are found together first; the
    log itself is joined back by its interval. Keys are dealt by range over
    ``parts`` tasks (the session's shuffle partitions by default; 0: a task a key,
    where keys are known to be small)."""
    shape = ["column", "lo", "hi", "lo_closed", "hi_closed"]
    distinct = items.select(*shape).distinct()
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")) if parts is None else parts
    marked = (islands_dealt(distinct, ["column"], parts) if parts else islands(distinct, ["column"])).withColumnRenamed("island", "cluster")
    a = items.alias("a")
    b = marked.alias("b")
    on = F.lit(True)
    for c in shape:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, on).select("a.*", "b.cluster")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable over (a, b), for accesses that tie
    several keys together. Minimum labels along edges, halved by following
    labels of labels, until nothing changes."""
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = cut(both)
    label = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    mark = None
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("r"))
        label = label.join(near, "node").select("node", F.least("root", "r").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("next"))
        label = cut(label.join(jump, "root").select("node", F.col("next").alias("root")))
        now = label.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root"))).first()
        if now == mark:
            break
        mark = now
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    return label.union(loops.join(label, "node", "left_anti")).distinct()


def key_choice(items: DataFrame) -> DataFrame:
    """(column, cost): sum over transactions of the squared number of keys of the
    column that each touches; the least is the best column to cluster by."""
    per = items.groupBy("column", "gid").agg(F.countDistinct("value").alias("k"))
    return per.groupBy("column").agg(F.sum(F.col("k") * F.col("k")).cast("long").alias("cost"))


def table_classes(columns: DataFrame) -> DataFrame:
    """(table, class): mutated if written, consulted if only read."""
    t = columns.withColumn("table", F.substring_index("column", ".", 1))
    return t.groupBy("table").agg(F.when(F.bool_or(F.col("rw") == "W"), "mutated").otherwise("consulted").alias("class"))


def dependency_edges(columns: DataFrame, foreign_keys: DataFrame | None = None) -> DataFrame:
    """(from_table, to_table): a table read by a transaction that writes another,
    and child to parent of each foreign key."""
    t = columns.select("gid", "rw", F.substring_index("column", ".", 1).alias("table")).distinct()
    r = t.where("rw = 'R'").select("gid", F.col("table").alias("from_table"))
    w = t.where("rw = 'W'").select("gid", F.col("table").alias("to_table"))
    out = r.join(w, "gid").select("from_table", "to_table").where("from_table <> to_table").distinct()
    if foreign_keys is not None:
        fk = foreign_keys.select(F.substring_index("child", ".", 1).alias("from_table"), F.substring_index("parent", ".", 1).alias("to_table"))
        out = out.union(fk).distinct()
    return out


def column_set_edges(columns: DataFrame) -> DataFrame:
    """(src_set, dst_set): sets of columns that some transaction touches, where
    the one writes a column that the other touches. Sets are few: they are
    found distinct before they are compared."""
    sets = columns.groupBy("gid").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("rw") == "R", F.col("column")))), ",").alias("reads"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("rw") == "W", F.col("column")))), ",").alias("writes"),
    )
    sets = sets.select("reads", "writes").distinct()
    name = F.concat("reads", F.lit(">"), "writes")
    src = sets.select(name.alias("src_set"), F.explode(F.split("writes", ",")).alias("c")).where("c <> ''")
    dst = sets.select(name.alias("dst_set"), F.explode(F.array_union(F.split("reads", ","), F.split("writes", ","))).alias("c")).where("c <> ''")
    return src.join(dst, "c").where("src_set <> dst_set").select("src_set", "dst_set").distinct()
