"""Deriving state: what tables hold after replaying a log, with or without a change.

Statements are a small program for each operation (``Step``), applied in gid
order. Where a program is of the reset-and-add kind, ``reset_sum_state`` derives
the state by aggregates alone; any other program folds each cluster's
transactions in order, clusters in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrolens.functions.scalar import linear_congruence


def kept(log: DataFrame, removed: list[int], added: DataFrame | None = None) -> DataFrame:
    """The changed history: ``log`` without the removed gids, with the added
    transactions, which run before the one whose gid they carry. Column ``sub``
    orders the two (0: added, 1: original)."""
    base = log.where(~F.col("gid").isin(removed)).withColumn("sub", F.lit(1))
    return base if added is None else base.unionByName(added.withColumn("sub", F.lit(0)))


def state_at(log: DataFrame, gid: int) -> DataFrame:
    """The history up to and including a gid."""
    return log.where(F.col("gid") <= gid)


def reset_sum_state(log: DataFrame, key: str, resets: Column, start: Column, adds: Column) -> DataFrame:
    """(key, resets_at, state): the last reset's start value plus all that was
    added after it; null without a reset. Two aggregates over the log, both with
    partial sums before the shuffle; the join is on the key, one row a side."""
    order = F.struct("gid", "sub") if "sub" in log.columns else F.struct("gid")
    last = log.where(resets).groupBy(key).agg(F.max(F.struct(order.alias("at"), start.alias("start"))).alias("_r"))
    tagged = log.select(key, order.alias("_at"), F.when(resets, F.lit(0.0)).otherwise(F.coalesce(adds, F.lit(0.0))).alias("_add"))
    after = tagged.join(last, key).where(F.col("_at") > F.col("_r.at")).groupBy(key).agg(F.sum("_add").alias("_sum"))
    keys = log.select(key).distinct()
    whole = keys.join(last, key, "left").join(after, key, "left")
    return whole.select(key, F.col("_r.at.gid").alias("resets_at"), (F.col("_r.start") + F.coalesce("_sum", F.lit(0.0))).alias("state"))


def fold_clusters(log: DataFrame, cluster: str, init: Callable[[], dict], step: Callable[[dict, Any], None], out: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Fold each cluster's transactions in gid order with a Python program.
    Clusters don't touch each other, so each is a task's own; rows stream
    through in batches, sorted, and only the state is held."""
    sort = [cluster, "gid", *(["sub"] if "sub" in log.columns else [])]
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at, rows = None, None, []
        for frame in frames:
            for r in frame.itertuples(index=False):
                if state is None or getattr(r, cluster) != at:
                    if state is not None:
                        rows += out(state)
                    state, at = init(), getattr(r, cluster)
                    state["cluster"] = at
                step(state, r)
            if len(rows) > 10_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if state is not None:
            rows += out(state)
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return log.repartition(cluster).sortWithinPartitions(*sort).mapInPandas(run, schema)


def waves(log: DataFrame, level: DataFrame) -> DataFrame:
    """``log`` with the wave in which each transaction may run."""
    return log.join(level.select("gid", "level"), "gid")


def reflect(target: DataFrame, derived: DataFrame, affected: DataFrame, key: list[str]) -> DataFrame:
    """The new snapshot: rows whose key is affected come from the derived state,
    the others stay. To be written to a new place and swapped in."""
    stay = target.join(affected.select(*key).distinct(), key, "left_anti")
    new = derived.join(affected.select(*key).distinct(), key, "left_semi")
    return stay.unionByName(new.select(*stay.columns))


def update(table: DataFrame, predicate: Column, sets: dict[str, Column]) -> DataFrame:
    """UPDATE: rows whose predicate is null stay as they are."""
    hit = F.coalesce(predicate, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in sets.items()})


def delete(table: DataFrame, predicate: Column) -> DataFrame:
    """DELETE: rows whose predicate is null stay."""
    return table.where(~F.coalesce(predicate, F.lit(False)))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """REPLACE: new rows take the place of those with their keys."""
    return table.join(rows, key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def pinned(context: DataFrame) -> Column:
    """A recorded random draw: a linear congruence from the recorded seed, so a
    replay draws what the original drew. ``context`` has rand_seed."""
    return linear_congruence(context["rand_seed"])


def replace_statements(targets: list[dict[str, Any]], groups: list[tuple[list[str], bool]], database: str, derived: str) -> list[str]:
    """SQL that carries the derived state over. ``targets``: for each target the
    range of each key column (or the wildcard); groups of key columns are OR-ed,
    the columns of a composite group AND-ed; a wildcard copies the table whole."""
    out = []
    for table in sorted({c.split(".")[0] for columns, _ in groups for c in columns}):
        parts, whole = [], False
        for columns, composite in groups:
            own = [c for c in columns if c.split(".")[0] == table]
            for target in targets:
                ranges = [(c.split(".")[1], target[c]) for c in own if c in target]
                if not ranges:
                    continue
                if all(r.wildcard for _, r in ranges) or (not composite and any(r.wildcard for _, r in ranges)):
                    whole = True
                texts = [f"({r.sql(c)})" for c, r in ranges if not r.wildcard]
                parts.append(" AND ".join(texts) if composite else " OR ".join(texts))
        if whole:
            out += [f"TRUNCATE {database}.{table}", f"REPLACE INTO {database}.{table} SELECT * FROM {derived}.{table}"]
        elif parts:
            where = " OR ".join(dict.fromkeys(p for p in parts if p))
            out += [f"DELETE FROM {database}.{table} WHERE {where}", f"REPLACE INTO {database}.{table} SELECT * FROM {derived}.{table} WHERE {where}"]
    return out
