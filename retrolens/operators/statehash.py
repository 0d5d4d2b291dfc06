"""Order-independent digests of tables, and when two timelines meet again.

A row's digest is two 60-bit numbers from its MD5; a table's digest adds them
up modulo the prime 2**61 - 1, with a minus sign for rows taken out. Addition
needs no order, so partial sums are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import before

PRIME = 2**61 - 1


def canonical(columns: list[Column]) -> Column:
    """A row as text: fields parted by a unit separator, null as a mark of its own."""
    return F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])


def row_digest(columns: list[Column], part: int = 0) -> Column:
    """60 bits of the row's MD5; part 0 or 1."""
    return F.conv(F.substring(F.md5(canonical(columns)), 1 + 15 * part, 15), 16, 10).cast("decimal(38,0)")


def table_digest(rows: DataFrame, columns: list[str], sign: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """(*by, n, digest_a, digest_b) of a table or of a log of inserts (sign 1) and
    deletes (sign -1)."""
    sign = F.lit(1) if sign is None else sign
    cols = [F.col(c) for c in columns]
    total = lambda p: F.pmod(F.sum(row_digest(cols, p) * sign), F.lit(PRIME).cast("decimal(38,0)")).cast("decimal(38,0)")
    return rows.groupBy(*(by or [])).agg(F.sum(sign).cast("long").alias("n"), total(0).alias("digest_a"), total(1).alias("digest_b"))


def timeline(log: DataFrame, columns: list[str], by: str, sign: Column, parts: int | None = None) -> DataFrame:
    """(by, gid, digest): the digest after each write to each table."""
    per = log.groupBy(by, "gid").agg(F.sum(row_digest([F.col(c) for c in columns]) * sign).alias("d"))
    prime = F.lit(PRIME).cast("decimal(38,0)")
    per = per.withColumn("d", F.pmod("d", prime).cast("decimal(38,0)"))
    so_far = before(per, [by], ["gid"], {"so_far": ("sum", F.col("d"))}, parts)
    return so_far.select(by, "gid", F.pmod(F.coalesce(F.col("so_far"), F.lit(0)) + F.col("d"), prime).cast("decimal(38,0)").alias("digest"))


def hash_jump(original: DataFrame, changed: DataFrame, by: str, first: int) -> DataFrame:
    """(gid): the first gid from ``first`` on from which the tables' digests in
    both timelines (by, gid, digest of every write since the change) are equal
    for good; no row if they never meet again."""
    both = original.select(by, "gid", F.col("digest").alias("o"), F.lit(None).cast("decimal(38,0)").alias("c")).unionByName(changed.select(by, "gid", F.lit(None).cast("decimal(38,0)").alias("o"), F.col("digest").alias("c")))
    both = both.groupBy(by, "gid").agg(F.max("o").alias("o"), F.max("c").alias("c"))
    # a table's writes are dealt over tasks; only what a stretch hands on is carried over
    both = before(both, [by], ["gid"], {"_o": ("last", F.col("o")), "_c": ("last", F.col("c"))})
    both = both.select(by, "gid", F.coalesce("o", "_o").alias("o"), F.coalesce("c", "_c").alias("c")).where(F.col("gid") >= first)
    last_apart = F.max(F.when(~F.col("o").eqNullSafe(F.col("c")), F.col("gid")))
    per_table = both.groupBy(by).agg(last_apart.alias("apart"), F.max("gid").alias("last"))
    ends = per_table.agg(F.max("apart").alias("apart"), F.bool_or(F.col("apart").eqNullSafe(F.col("last"))).alias("never"))
    # ends is a single row
    return both.join(F.broadcast(ends)).where(~F.col("never") & (F.col("apart").isNull() | (F.col("gid") > F.col("apart")))).agg(F.min("gid").alias("gid")).where("gid IS NOT NULL")


def statement_digest(sql: Column) -> Column:
    """SHA-1 of a statement in normal form: lower case, one space between words."""
    return F.sha1(F.lower(F.trim(F.regexp_replace(sql, r"\s+", " "))).cast("binary"))
