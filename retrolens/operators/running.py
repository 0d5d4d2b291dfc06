"""Running aggregates along an order within keys, without a task for each key.

A plain window gives all rows of a key to one task. Here rows are dealt by ranges
of (key, order), so that a hot key spans many tasks: each task aggregates its own
stretch, and only what a stretch hands on to the next ones of its key is carried
over. At most two (key, task) pairs of a boundary belong to a key that spans
tasks, so the carried rows are fewer than twice the number of tasks and are
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrolens.lineage import cut

#: name -> (kind, value); kind: count (of non-null values), sum, last (non-null).
Values = dict[str, tuple[str, Column]]


def _total(kind: str, name: str, order: list[str]) -> Column:
    if kind == "count":
        return F.count(name)
    if kind == "sum":
        return F.sum(name)
    entry = F.struct(*[F.col(o) for o in order], F.col(name).alias("_v"))
    return F.max(F.when(F.col(name).isNotNull(), entry))["_v"]


def _over(kind: str, value: Column, window: object) -> Column:
    if kind == "count":
        return F.count(value).over(window)
    if kind == "sum":
        return F.sum(value).over(window)
    return F.last(value, ignorenulls=True).over(window)


def _joined(kind: str, own: Column, carried: Column) -> Column:
    if kind == "count":
        return own + F.coalesce(carried, F.lit(0))
    if kind == "sum":
        return F.when(own.isNull(), carried).otherwise(own + F.coalesce(carried, F.lit(0)))
    return F.coalesce(own, carried)


def before(rows: DataFrame, by: list[str], order: list[str], values: Values, parts: int | None = None) -> DataFrame:
    """``rows`` with each named aggregate over the rows of the same key that come
    before; null (count: 0) for the first. ``order`` must tell a key's rows apart.
    parts: tasks to deal over (the session's shuffle partitions by default; 0 for
    a plain window, where keys are known to be small)."""
    plain = {n: F.col(f"_in_{n}") for n in values}
    df = rows.withColumns({f"_in_{n}": v for n, (_, v) in values.items()})
    if parts == 0:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: _over(k, plain[n], w) for n, (k, _) in values.items()}).drop(*[f"_in_{n}" for n in values])
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "_part").agg(*[_total(k, f"_in_{n}", order).alias(f"_sum_{n}") for n, (k, _) in values.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    span = Window.partitionBy(*by)
    # a key's totals are one row for each task that it spans
    carried = totals.withColumn("_spans", F.count(F.lit(1)).over(span)).where("_spans > 1").drop("_spans")
    carry = {"count": lambda c: F.sum(c).over(earlier), "sum": lambda c: F.sum(c).over(earlier), "last": lambda c: F.last(c, ignorenulls=True).over(earlier)}
    carried = carried.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_part").alias("_to"), *[carry[k](F.col(f"_sum_{n}")).alias(f"_carry_{n}") for n, (k, _) in values.items()])
    own = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = F.col("_part") == F.col("_to")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    joined = dealt.withColumns({f"_own_{n}": _over(k, plain[n], own) for n, (k, _) in values.items()}).join(F.broadcast(carried), on, "left")
    return joined.select(*rows.columns, *[_joined(k, F.col(f"_own_{n}"), F.col(f"_carry_{n}")).alias(n) for n, (k, _) in values.items()])
