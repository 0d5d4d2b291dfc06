"""Which later transactions depend on a change.

Column dependency is a fixpoint over the earliest gid at which each column is
tainted: the state is one number for each column of the schema, so a round is a
narrow pass over the log and a tiny aggregate, whatever the log's length. Row
dependency is a semi-join on key values or on islands of key intervals.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrolens.lineage import cut, scratch

from .relations import Relations


def related(a: str, b: str, relations: Relations) -> bool:
    """Whether an access of column a bears on one of b: the same column once
    foreign keys are followed, a whole row (``t.*``) against any column of its
    table, or a whole row against the key that links its table."""
    ra, rb = relations.foreign_key(a), relations.foreign_key(b)
    (ta, ca), (tb, cb) = ra.split("."), rb.split(".")
    if ta == tb and (ca == cb or "*" in (ca, cb)):
        return True
    for child, parent in relations.linked():
        tables = {child.split(".")[0], parent.split(".")[0]}
        if {ta, tb} == tables and len(tables) == 2:
            ends = {child, parent}
            if ca == cb == "*" or (ca == "*" and (b in ends or rb in ends)) or (cb == "*" and (a in ends or ra in ends)):
                return True
    return False


def related_to(columns: Iterable[str], relations: Relations) -> dict[str, list[str]]:
    """For each column, the columns it is related to. Both are of the schema's size."""
    columns = sorted(set(columns))
    return {a: [b for b in columns if related(a, b, relations)] for a in columns}


def by_transaction(columns: DataFrame) -> DataFrame:
    """(gid, rw, column) as one row per gid: all columns and those written."""
    return columns.groupBy("gid").agg(F.collect_set("column").alias("touched"), F.collect_set(F.when(F.col("rw") == "W", F.col("column"))).alias("writes"))


def earliest_taint(log: DataFrame, targets: list[int] | DataFrame, relations: Relations, row_matched: DataFrame | None = None, extra_writes: dict[str, int] | None = None) -> dict[str, int]:
    """The first gid at which each column is tainted. ``log``: by_transaction(),
    materialised, since each round reads it;
    ``row_matched``: gids that depend by rows, which taint what they write;
    ``extra_writes``: columns tainted by added transactions."""
    names = {c for r in log.select(F.explode("touched").alias("c")).distinct().collect() for c in (r.c,)} | set(extra_writes or ())
    near = related_to(names, relations)
    taint: dict[str, int] = dict(extra_writes or {})

    def lower(frame: DataFrame) -> bool:
        changed = False
        for r in frame.select(F.explode("writes").alias("c"), "gid").groupBy("c").agg(F.min("gid").alias("g")).collect():  # a row per column
            if r.g < taint.get(r.c, r.g + 1):
                taint[r.c], changed = r.g, True
        return changed

    lower(only(log, targets))
    if row_matched is not None:
        lower(log.join(row_matched.select("gid"), "gid", "left_semi"))
    rest = without(log, targets)
    while lower(rest.where(column_dependent(taint, near))):
        pass
    return taint


def column_dependent(taint: dict[str, int], near: dict[str, list[str]]) -> Column:
    """Whether a transaction touches a column that was tainted before it."""
    first = {c: min((taint[x] for x in xs if x in taint), default=None) for c, xs in near.items()}
    known = [F.lit(x) for c, g in sorted(first.items()) if g is not None for x in (c, g)]
    if not known:
        return F.lit(False)
    table = F.create_map(*known)
    return F.exists("touched", lambda c: F.coalesce(F.try_element_at(table, c) < F.col("gid"), F.lit(False)))


def row_matched(items: DataFrame, targets: list[int] | DataFrame, key: list[str]) -> DataFrame:
    """Distinct gids that touch, later, a key that a target wrote. ``items``:
    (gid, rw, *key); key columns are a column name and a value or an island."""
    hit = only(items.where("rw = 'W'"), targets).groupBy(*key).agg(F.min("gid").alias("_first"))
    return items.join(hit, key).where(F.col("gid") > F.col("_first")).select("gid").distinct()


def composite_matched(items: DataFrame, targets: list[int] | DataFrame, groups: list[tuple[int, list[str], bool]]) -> DataFrame:
    """row_matched() by key groups (id, columns, composite): in a composite group
    all columns must match one target, in another any; an access that lacks a
    column of a composite group matches any value of it. items: (gid, rw,
    column, value)."""
    out = None
    for _, columns, composite in groups:
        own = items.where(F.col("column").isin(columns))
        if composite:
            wide = own.groupBy("gid", "rw").pivot("column", columns).agg(F.first("value"))
            hit = only(wide.where("rw = 'W'"), targets).select(F.col("gid").alias("_t"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)])
            on = F.col("gid") > F.col("_t")
            for i, c in enumerate(columns):
                on = on & (F.col(f"`{c}`").isNull() | F.col(f"_{i}").isNull() | (F.col(f"`{c}`") == F.col(f"_{i}")))
            found = wide.join(hit, on).select("gid")
        else:
            found = row_matched(own, targets, ["column", "value"])
        out = found if out is None else out.union(found)
    return out.distinct()


def decide(log: DataFrame, keyed: DataFrame, matched: DataFrame, taint: dict[str, int], relations: Relations, targets: list[int] | DataFrame, strict_row_gate: bool = False) -> DataFrame:
    """(gid, column_dependent, has_key, row_match, replay, taints): the decision
    on every transaction that is no target."""
    names = {r.c for r in log.select(F.explode("touched").alias("c")).distinct().collect()} | set(taint)
    near = related_to(names, relations)
    df = without(log, targets).withColumn("column_dependent", column_dependent(taint, near))
    flag = lambda d, n: d.select("gid").distinct().withColumn(n, F.lit(True))
    df = df.join(flag(keyed, "has_key"), "gid", "left").join(flag(matched, "row_match"), "gid", "left").fillna(False, ["has_key", "row_match"])
    replay = F.when(F.col("has_key"), F.col("row_match")).otherwise(F.col("column_dependent"))
    taints = replay if strict_row_gate else replay | F.col("column_dependent")
    return df.select("gid", "column_dependent", "has_key", "row_match", replay.alias("replay"), taints.alias("taints"))


def spread_count(total: int, ratio: float, least: int = 1) -> int:
    """How many of ``total`` places a share takes, ``least`` at least; of no rows
    or for no share none."""
    ratio = min(1.0, max(0.0, ratio))
    return min(total, max(least, int(total * ratio + 0.5))) if total and ratio else 0


def spread_places(ranked: DataFrame, total: int, ratio: float, place: str = "place", least: int = 1) -> DataFrame:
    """Rows of ``ranked`` (column ``place``: 0 .. total - 1; others are left out) at
    evenly spaced places: m of them, the k-th at floor((k + 0.5) * total / m). Each
    row tells by itself, in whole numbers, whether some k has its place."""
    m = spread_count(total, ratio, least)
    if not m:
        return ranked.where("false")
    # (2 * m * place + total - 1) / (2 * total), rounded down, counts the places before a given one. A step on, it
    # grows if the remainder overflows. No quotient is taken: a decimal one is rounded at its sixth digit.
    at = F.col(place).cast("decimal(20,0)")
    rest = (at * F.lit(2 * m) + F.lit(total - 1)) % F.lit(2 * total)
    return ranked.where((at >= 0) & (at < F.lit(total)) & (rest >= F.lit(2 * (total - m))))


def only(rows: DataFrame, gids: list[int] | DataFrame) -> DataFrame:
    """Rows whose gid is one of ``gids``: those that a user named, or a table."""
    return rows.where(F.col("gid").isin(gids)) if isinstance(gids, list) else rows.join(gids.select("gid"), "gid", "left_semi")


def without(rows: DataFrame, gids: list[int] | DataFrame) -> DataFrame:
    return rows.where(~F.col("gid").isin(gids)) if isinstance(gids, list) else rows.join(gids.select("gid"), "gid", "left_anti")


def row_closure(items: DataFrame, targets: list[int] | DataFrame, key: list[str]) -> DataFrame:
    """Distinct gids that depend on the targets by rows, however many steps away:
    a transaction that touches a key after a target, or after a dependent one,
    wrote it is dependent. ``items``: (gid, rw, *key), equality of keys; rw is R,
    W, or T for a key that is tainted without being met.

    A fixpoint over the earliest gid at which each key is tainted: a round joins
    the keys that became tainted (earlier) with the log and ends with the
    transactions that are new; as many rounds as the longest chain of keys."""
    items = cut(items.select("gid", "rw", *key).distinct())
    writes, items = items.where("rw IN ('W', 'T')").select("gid", *key), items.where("rw <> 'T'")
    tainted = only(writes, targets).groupBy(*key).agg(F.min("gid").alias("since"))
    spark, place, turn = items.sparkSession, scratch(items.sparkSession), 0
    while True:
        fresh = without(items.join(tainted, key).where(F.col("gid") > F.col("since")).select("gid").distinct(), targets)
        found = spark.read.schema("gid long").parquet(f"{place}/*") if turn else None
        (fresh if found is None else fresh.join(found, "gid", "left_anti")).write.parquet(f"{place}/{turn}")
        fresh = spark.read.schema("gid long").parquet(f"{place}/{turn}")
        if fresh.isEmpty():
            return spark.read.schema("gid long").parquet(f"{place}/*")
        tainted = writes.join(fresh, "gid", "left_semi").groupBy(*key).agg(F.min("gid").alias("since"))
        turn += 1
