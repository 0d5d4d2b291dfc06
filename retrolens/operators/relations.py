"""Relations between columns: aliases, foreign keys, key groups, names over time."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import before


def normal(name: str) -> str:
    return name.strip().strip("`").replace("`", "").lower()


class Relations:
    """Aliases and foreign keys of columns (``table.column``), as small maps on
    the driver: their size is that of the schema."""

    def __init__(self, aliases: dict[str, str] | None = None, foreign_keys: Iterable[tuple[str, str]] = ()):
        self.aliases = {normal(a): normal(b) for a, b in (aliases or {}).items()}
        self.foreign_keys = {normal(a): normal(b) for a, b in foreign_keys}

    @staticmethod
    def _follow(start: str, step: dict[str, str]) -> str:
        """The end of the chain from ``start``; empty for a cycle."""
        at, seen = normal(start), set()
        while at in step:
            if at in seen:
                return ""
            seen.add(at)
            at = step[at]
        return at

    def alias(self, column: str) -> str:
        return self._follow(column, self.aliases)

    def foreign_key(self, column: str) -> str:
        return self._follow(column, self.foreign_keys)

    def chain(self, column: str) -> str:
        """Aliases and foreign keys in turn, an alias first."""
        return self._follow(column, self.foreign_keys | self.aliases)

    def resolved(self, column: Column) -> Column:
        """chain() of a column of names; as a literal map, since schemas are small."""
        known = {c: self.chain(c) for c in {*self.aliases, *self.foreign_keys}}
        if not known:
            return F.lower(column)
        pairs = F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])
        return F.coalesce(F.try_element_at(pairs, F.lower(column)), F.lower(column))

    def linked(self) -> set[tuple[str, str]]:
        return {*self.foreign_keys.items()}


def implicit_foreign_key(column: str, tables: Iterable[str]) -> str:
    """``x_id`` of any table names ``x.id``, ``xs.id`` or ``xes.id`` if there is such a table."""
    known = {normal(t) for t in tables}
    if m := re.fullmatch(r"[^.]+\.(\w+)_id", normal(column)):
        for suffix in ("", "s", "es"):
            if m[1] + suffix in known:
                return f"{m[1]}{suffix}.id"
    return normal(column)


def key_groups(text: str) -> list[list[str]]:
    """``a.x,b.y+b.z``: commas part groups, plus signs the columns of one."""
    groups = [[normal(c) for c in g.split("+") if c.strip()] for g in text.split(",")]
    return [g for g in groups if g]


def is_composite(group: list[str]) -> bool:
    """Columns of one table must all match; columns of several tables each stand alone."""
    return len(group) > 1 and len({c.split(".")[0] for c in group}) == 1


def row_aliases(writes: DataFrame, alias: str, real: str) -> DataFrame:
    """Alias values learnt: ``writes`` (gid, column, value) of transactions that
    write both columns gives (alias_value, real_value, gid)."""
    a = writes.where(F.col("column") == alias).select("gid", F.col("value").alias("alias_value"))
    r = writes.where(F.col("column") == real).select("gid", F.col("value").alias("real_value"))
    return a.join(r, "gid").select("alias_value", "real_value", "gid")


def resolve_row_aliases(items: DataFrame, learnt: DataFrame, parts: int | None = None) -> DataFrame:
    """``items`` (gid, value) with real_value as of their gid: what the last
    transaction before, or the same, said of the alias. A union in order and a
    running last value; no item meets more than one definition."""
    kind = learnt.schema["real_value"].dataType
    said = learnt.select("gid", F.col("alias_value").alias("value"), "real_value", F.lit(0).alias("_is_item"))
    both = items.select("gid", "value", F.lit(None).cast(kind).alias("real_value"), F.lit(1).alias("_is_item")).unionByName(said)
    found = before(both, ["value"], ["gid", "_is_item"], {"known": ("last", F.col("real_value"))}, parts)
    return found.where("_is_item = 1").select("gid", "value", F.coalesce(F.col("known"), F.col("value").cast(kind)).alias("real_value"))


def coerced(value: Column) -> Column:
    """Digit strings as numbers, anything else null."""
    return value.try_cast("bigint")


def name_as_of(names: DataFrame, asked: DataFrame, parts: int | None = None) -> DataFrame:
    """``asked`` (table_id, gid) with the name valid then, from ``names``
    (table_id, valid_from, name)."""
    both = asked.select("table_id", "gid", F.lit(None).cast("string").alias("name"), F.lit(1).alias("_asks")).unionByName(names.select("table_id", F.col("valid_from").alias("gid"), "name", F.lit(0).alias("_asks")))
    found = before(both, ["table_id"], ["gid", "_asks"], {"known": ("last", F.col("name"))}, parts)
    return found.where("_asks = 1").select("table_id", "gid", F.col("known").alias("name"))
