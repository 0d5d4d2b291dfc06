"""The transaction log: assembling transactions from events, writing, reading.

A transaction's gid is its dense place in commit order. Rows are written sorted
by gid, so a gid window or a single gid is answered from file statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATEMENT_CONTEXT = T.StructType(
    [
        T.StructField("last_insert_id", T.LongType()),
        T.StructField("insert_id", T.LongType()),
        T.StructField("rand_seed1", T.LongType()),
        T.StructField("rand_seed2", T.LongType()),
        T.StructField("user_vars", T.MapType(T.StringType(), T.StringType())),
    ]
)
QUERY = T.StructType(
    [
        T.StructField("q", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("database", T.StringType()),
        T.StructField("statement", T.StringType()),
        T.StructField("read_columns", T.ArrayType(T.StringType())),
        T.StructField("write_columns", T.ArrayType(T.StringType())),
        T.StructField("affected_rows", T.IntegerType()),
        T.StructField("context", STATEMENT_CONTEXT),
    ]
)
TRANSACTION = T.StructType(
    [
        T.StructField("gid", T.LongType()),
        T.StructField("xid", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("is_successful", T.BooleanType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("dependencies", T.ArrayType(T.LongType())),
        T.StructField("queries", T.ArrayType(QUERY)),
    ]
)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Dense gids in the order (group, *order) without one global sort: places
    within a group, shifted by the sizes of the groups before (a row each)."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.withColumn("_place", place).join(shift, group).withColumn("gid", (F.col("_place") + F.col("_shift")).cast("long")).drop("_place", "_shift")


def assemble(events: DataFrame) -> DataFrame:
    """Transactions of binary log events (file, pos, row, type, ...): events up
    to an XID belong together; BEGIN starts anew; those that a ROLLBACK ends are
    dropped. (file, xid, ts, n_events, ops, gid)"""
    word = F.upper(F.trim("statement"))
    is_query = F.col("type") == "QUERY"
    ends = (F.col("type") == "XID") | (is_query & word.isin("COMMIT", "ROLLBACK"))
    order = Window.partitionBy("file").orderBy("pos", "row")
    txn = F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = events.withColumn("_txn", txn)
    body = ~is_query & (F.col("type") != "XID") | is_query & ~word.isin("BEGIN", "COMMIT", "ROLLBACK")
    op = F.struct("pos", "row", F.coalesce("kind", "type").alias("op"), "table", "before", "after", "statement")
    grouped = df.groupBy("file", "_txn").agg(
        F.max("xid").alias("xid"),
        F.max(F.when(ends, F.col("ts"))).alias("ts"),
        F.bool_or(F.col("type") == "XID").alias("_done"),
        F.count(F.when(body, 1)).alias("n_events"),
        F.sort_array(F.collect_list(F.when(body, op))).alias("ops"),
    )
    return numbered(grouped.where("_done").drop("_done"), "file", ["_txn"]).drop("_txn")


def write(log: DataFrame, place: str, mode: str = "append") -> None:
    log.repartitionByRange("gid").sortWithinPartitions("gid").write.mode(mode).parquet(place)


def read(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.parquet(place)


def at(log: DataFrame, gid: int) -> DataFrame:
    return log.where(F.col("gid") == gid)


def window(log: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Transactions of a gid window, ends included."""
    if first is not None:
        log = log.where(F.col("gid") >= first)
    return log if last is None else log.where(F.col("gid") <= last)


def in_scope(log: DataFrame, database: str, first: int, last: int, skip: list[int]) -> DataFrame:
    """Transactions within a window that touch a database and aren't skipped."""
    return window(log, first, last).where(~F.col("gid").isin(skip) & F.exists("queries", lambda q: q["database"] == database))
