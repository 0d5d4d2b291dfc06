"""Interval algebra over one column, as values on the driver and as columns.

An interval has two ends; None is unbounded, and each end is closed or open.
A range is a union of intervals, or the wildcard, which meets everything.
Values compare within their own kind only; decimals compare as numbers.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrolens.lineage import cut


def _kind(v: Any) -> str:
    if isinstance(v, bool):
        return "bool"
    return "number" if isinstance(v, int | float | Decimal) else type(v).__name__


@dataclass(frozen=True)
class Interval:
    """lo .. hi; None is unbounded, closed says whether an end belongs to it."""

    lo: Any = None
    hi: Any = None
    lo_closed: bool = True
    hi_closed: bool = True

    def empty(self) -> bool:
        if self.lo is None or self.hi is None:
            return False
        if _kind(self.lo) != _kind(self.hi):
            return True
        return self.lo > self.hi or (self.lo == self.hi and not (self.lo_closed and self.hi_closed))

    def __and__(self, other: Interval) -> Interval:
        lo, lo_closed = self.lo, self.lo_closed
        if other.lo is not None and (lo is None or _kind(lo) == _kind(other.lo) and (other.lo, not other.lo_closed) > (lo, not lo_closed)):
            lo, lo_closed = other.lo, other.lo_closed
        hi, hi_closed = self.hi, self.hi_closed
        if other.hi is not None and (hi is None or _kind(hi) == _kind(other.hi) and (other.hi, other.hi_closed) < (hi, hi_closed)):
            hi, hi_closed = other.hi, other.hi_closed
        kinds = {_kind(x) for x in (self.lo, self.hi, other.lo, other.hi) if x is not None}
        return Interval(lo, hi, lo_closed, hi_closed) if len(kinds) < 2 else NOTHING

    def meets(self, other: Interval) -> bool:
        return not (self & other).empty()

    def touches(self, other: Interval) -> bool:
        """Whether the union is one interval."""
        if self.meets(other):
            return True
        return any(a.hi is not None and a.hi == b.lo and (a.hi_closed or b.lo_closed) for a, b in ((self, other), (other, self)))

    def hull(self, other: Interval) -> Interval:
        lo, lo_closed = (None, True) if None in (self.lo, other.lo) else min((self.lo, not self.lo_closed), (other.lo, not other.lo_closed))
        hi, hi_closed = (None, True) if None in (self.hi, other.hi) else max((self.hi, self.hi_closed), (other.hi, other.hi_closed))
        return Interval(lo, hi, lo_closed if lo is None else not lo_closed, hi_closed)


NOTHING = Interval(0, 0, False, False)


@dataclass(frozen=True)
class Range:
    """A normalised union of intervals, or the wildcard."""

    parts: tuple[Interval, ...] = ()
    wildcard: bool = False

    @staticmethod
    def of(parts: Iterable[Interval]) -> Range:
        """Overlapping and touching intervals made one, in order."""
        live = [p for p in parts if not p.empty()]
        groups: dict[str, list[Interval]] = {}
        for p in live:
            groups.setdefault(_kind(p.lo if p.lo is not None else p.hi) if (p.lo is not None or p.hi is not None) else "any", []).append(p)
        if "any" in groups:
            return Range((Interval(),))
        out: list[Interval] = []
        for _, group in sorted(groups.items()):
            group.sort(key=lambda p: (p.lo is not None, p.lo if p.lo is not None else 0, not p.lo_closed))
            for p in group:
                if out and out[-1].touches(p):
                    out[-1] = out[-1].hull(p)
                else:
                    out.append(p)
        return Range(tuple(out))

    def __or__(self, other: Range) -> Range:
        return ANY if self.wildcard or other.wildcard else Range.of(self.parts + other.parts)

    def __and__(self, other: Range) -> Range:
        if self.wildcard:
            return other
        if other.wildcard:
            return self
        return Range.of(a & b for a in self.parts for b in other.parts)

    def meets(self, other: Range) -> bool:
        if self.wildcard or other.wildcard:
            return True
        return any(a.meets(b) for a in self.parts for b in other.parts)

    def sql(self, column: str) -> str:
        """The predicate as SQL text; strings are written in hexadecimal."""
        if self.wildcard or any(p.lo is None and p.hi is None for p in self.parts):
            return "1=1"
        if len(self.parts) == 2 and self.parts[0].lo is None and self.parts[1].hi is None and self.parts[0].hi == self.parts[1].lo:
            return f"{column}!={literal(self.parts[0].hi)}"
        return " OR ".join(_part_sql(column, p) for p in self.parts) or "1=0"

    def column(self, c: Column) -> Column:
        """The predicate as a column."""
        if self.wildcard:
            return F.lit(True)
        one = lambda p: reduce(lambda a, b: a & b, [x for x in (_low(c, p), _high(c, p)) if x is not None], F.lit(True))
        return reduce(lambda a, b: a | b, map(one, self.parts), F.lit(False))


ANY = Range((), True)


def literal(v: Any) -> str:
    if isinstance(v, str | bytes):
        return f"X'{(v.encode() if isinstance(v, str) else v).hex().upper()}'"
    return str(v)


def _part_sql(column: str, p: Interval) -> str:
    if p.lo is not None and p.lo == p.hi:
        return f"{column}={literal(p.lo)}"
    ends = []
    if p.lo is not None:
        ends.append(f"{column}{'>=' if p.lo_closed else '>'}{literal(p.lo)}")
    if p.hi is not None:
        ends.append(f"{column}{'<=' if p.hi_closed else '<'}{literal(p.hi)}")
    return f"({' AND '.join(ends)})" if len(ends) > 1 else ends[0]


def _low(c: Column, p: Interval) -> Column | None:
    return None if p.lo is None else (c >= p.lo if p.lo_closed else c > p.lo)


def _high(c: Column, p: Interval) -> Column | None:
    return None if p.hi is None else (c <= p.hi if p.hi_closed else c < p.hi)


def leaf(op: str, values: list[Any]) -> Range:
    """The range of a predicate's leaf. NULL tests and patterns that don't begin
    with fixed text are the wildcard: any value may be meant."""
    op = op.upper()
    point = lambda v: Interval(v, v)
    if any(v is None for v in values) or op in ("IS NULL", "IS NOT NULL", "WILDCARD"):
        return ANY
    if op in ("=", "IN"):
        return Range.of(map(point, values))
    if op in ("!=", "<>", "NOT IN"):
        return reduce(lambda a, b: a & b, [Range((Interval(None, v, True, False), Interval(v, None, False, True))) for v in values], Range((Interval(),)))
    if op in ("<", "<="):
        return Range((Interval(None, values[0], True, op == "<="),))
    if op in (">", ">="):
        return Range((Interval(values[0], None, op == ">=", True),))
    if op == "BETWEEN":
        a, b = values
        return Range.of([Interval(min(a, b), max(a, b))])
    if op == "NOT BETWEEN":
        a, b = values
        return Range.of([Interval(None, a, True, False), Interval(b, None, False, True)])
    if op == "LIKE":
        prefix = values[0].split("%")[0].split("_")[0]
        if prefix == values[0]:
            return Range((point(prefix),))
        if not prefix:
            return ANY
        return Range((Interval(prefix, prefix[:-1] + chr(ord(prefix[-1]) + 1), True, False),))
    if op == "NOT LIKE":
        return ANY
    raise ValueError(f"no such operator: {op}")


def tree(node: tuple, column: str) -> Range:
    """The range that a predicate tree allows for a column: AND intersects, OR
    unites; other columns' leaves say nothing. A node is ("AND"|"OR", nodes) or
    (op, column, values)."""
    if node[0] in ("AND", "OR"):
        parts = [tree(x, column) for x in node[1]]
        return reduce((lambda a, b: a & b) if node[0] == "AND" else (lambda a, b: a | b), parts, ANY if node[0] == "AND" else Range())
    return leaf(node[0], list(node[2])) if node[1] == column else ANY


# ---- the same on columns lo, hi, lo_closed, hi_closed (null end: unbounded) ----


def meets(a: str, b: str) -> Column:
    """Whether the intervals of two aliases overlap; for a join's condition."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    before = lambda p, q: (p("lo") < q("hi")) | ((p("lo") == q("hi")) & p("lo_closed") & q("hi_closed"))
    either = lambda p, q: p("lo").isNull() | q("hi").isNull() | before(p, q)
    return either(x, y) & either(y, x)


def islands(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (by, lo, hi, lo_closed, hi_closed) with ``island``: intervals of
    a key that overlap or touch share one. A running maximum of the upper ends
    decides where a gap lies."""
    order = Window.partitionBy(*by).orderBy(F.col("lo").asc_nulls_first(), F.col("lo_closed").desc(), F.col("hi").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    open_end = F.max(F.when(F.col("hi").isNull(), 1).otherwise(0)).over(before) == 1
    top = F.max(F.struct("hi", F.col("hi_closed"))).over(before)
    joined = open_end | F.col("lo").isNull() | (top["hi"] > F.col("lo")) | ((top["hi"] == F.col("lo")) & (top["hi_closed"] | F.col("lo_closed")))
    marked = rows.withColumn("_new", F.when(F.row_number().over(order) == 1, 1).when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged(rows: DataFrame, by: list[str], extra: list[Column] | None = None) -> DataFrame:
    """One interval for each island of ``rows``."""
    low = F.min(F.struct(F.col("lo").isNotNull().alias("b"), F.col("lo"), (~F.col("lo_closed")).alias("o")))
    high = F.max(F.struct(F.col("hi").isNull().alias("u"), F.col("hi"), F.col("hi_closed").alias("c")))
    out = islands(rows, by).groupBy(*by, "island").agg(low.alias("_l"), high.alias("_h"), *(extra or []))
    rest = [c for c in out.columns if c not in {*by, "island", "_l", "_h"}]
    return out.select(*by, "island", F.col("_l.lo").alias("lo"), (~F.col("_l.o")).alias("lo_closed"), F.when(~F.col("_h.u"), F.col("_h.hi")).alias("hi"), F.col("_h.c").alias("hi_closed"), *rest)


def islands_dealt(rows: DataFrame, by: list[str], parts: int) -> DataFrame:
    """islands() without one task for each key: rows are dealt by range, each
    part finds its running maximum, and only each part's top end and number of
    islands are carried on to the next (``parts`` rows a key)."""
    dealt = rows.repartitionByRange(parts, *by, F.col("lo").asc_nulls_first(), F.col("lo_closed").desc(), F.col("hi").asc_nulls_last())
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()))
    top = F.max(F.struct(F.col("hi").isNull().alias("open"), F.col("hi"), F.col("hi_closed")))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = dealt.groupBy(*by, "_part").agg(top.alias("_top")).withColumn("_carry", F.max("_top").over(earlier)).drop("_top")
    order = Window.partitionBy(*by, "_part").orderBy(F.col("lo").asc_nulls_first(), F.col("lo_closed").desc(), F.col("hi").asc_nulls_last())
    own = F.max(F.struct(F.col("hi").isNull().alias("open"), F.col("hi"), F.col("hi_closed"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = dealt.join(F.broadcast(tops), [*by, "_part"]).withColumn("_before", F.greatest(own, "_carry"))
    joined = F.col("_before.open") | F.col("lo").isNull() | (F.col("_before.hi") > F.col("lo")) | ((F.col("_before.hi") == F.col("lo")) & (F.col("_before.hi_closed") | F.col("lo_closed")))
    marked = marked.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)) & F.col("_before").isNotNull(), 0).otherwise(1))
    sizes = marked.groupBy(*by, "_part").agg(F.sum("_new").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    numbered = marked.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(sizes), [*by, "_part"])
    return numbered.withColumn("island", F.col("island") + F.col("_shift")).select(*rows.columns, "island")
