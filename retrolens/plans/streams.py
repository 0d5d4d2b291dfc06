"""Streaming and binary-log queries: each runs what is there and reads the result."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrolens.lineage import scratch
from retrolens.operators import statehash
from retrolens.sources import binlog, statelog
from retrolens.streaming import assemble

from .logs import SQL, log, query, table

_COLUMNS = [("id", "LONGLONG"), ("op", "VARCHAR"), ("cents", "LONGLONG")]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A file for each batch: every event is a transaction of one insert."""
    for number, batch in enumerate(batches):
        w = binlog.Writer()
        for gid, key, op, cents in zip(*(batch.column(c).to_pylist() for c in ("gid", "key", "op", "cents")), strict=True):
            w.query("shop", "BEGIN", gid).table(1, "shop", "users", _COLUMNS, gid).rows("WRITE", 1, _COLUMNS, [[key, op, cents]], gid).xid(gid, gid)
        first = batch.column("gid")[0].as_py() if batch.num_rows else number
        yield pa.RecordBatch.from_arrays([pa.array([f"log.{first:012}"]), pa.array([w.bytes()], pa.binary())], names=["path", "content"])


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).repartitionByRange(3, "gid").sortWithinPartitions("gid").mapInArrow(_encode, "path string, content binary")


@query("a1_binlog_scan", "SELECT event_id AS gid, user_id AS key, event_type AS op, CAST(round(value * 100) AS BIGINT) AS cents FROM events")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as binary logs and decoded again."""
    e = binlog.parse(_files(spark, sf_dir)).where("type = 'WRITE'")
    image = F.from_json("after", "id long, op string, cents long")
    return e.select(F.col("ts").alias("gid"), image.alias("i")).select("gid", F.col("i.id").alias("key"), "i.op", "i.cents")


@query("a2_sequential_scan", "SELECT event_id AS xid, event_id AS gid, 1::BIGINT AS n_events FROM events")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of several files in order, numbered densely."""
    return statelog.assemble(binlog.parse(_files(spark, sf_dir))).select("xid", "gid", "n_events")


@query("m1_log_tailing", "SELECT event_id, user_id, event_type FROM events")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, place = scratch(spark), scratch(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    rows.write.parquet(src)
    assemble.run_once(assemble.tail(spark, src, rows.schema), f"{place}/out", f"{place}/state")
    return spark.read.schema(rows.schema).parquet(f"{place}/out")


@query("m2_stateful_assembly", SQL["a5_transaction_assembly"])
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions assembled by a stateful operator, in two batches."""
    src, place = scratch(spark), scratch(spark)
    rows = log(spark, sf_dir).select("key", "gid", "op", (F.col("op") == "purchase").alias("is_last"))
    half = rows.agg(F.max("gid")).first()[0] // 2
    rows.where(F.col("gid") <= half).coalesce(1).write.parquet(src)
    assemble.run_once(assemble.transactions(assemble.tail(spark, src, rows.schema)), f"{place}/out", f"{place}/state")
    rows.where(F.col("gid") > half).coalesce(1).write.mode("append").parquet(src)
    assemble.run_once(assemble.transactions(assemble.tail(spark, src, rows.schema)), f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out")


@query("m3_ordered_output", "SELECT event_id, event_type FROM events")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, place = scratch(spark), scratch(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    rows.write.parquet(src)
    assemble.run_in_order(assemble.tail(spark, src, rows.schema), f"{place}/out", f"{place}/state", "event_id")
    return spark.read.parquet(f"{place}/out").select("event_id", "event_type")


@query("m6_running_hash", "SELECT event_type, count(*) AS n, CAST(CAST(sum((('0x' || substr(md5(concat_ws(chr(31), CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR))), 1, 15))::BIGINT)::DECIMAL(38, 0)) AS DECIMAL(38, 0)) AS VARCHAR) AS digest FROM events GROUP BY 1")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, state = scratch(spark), scratch(spark)
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    rows.write.parquet(src)
    stream = assemble.running_digest(assemble.tail(spark, src, rows.schema), statehash.row_digest([F.col("user_id"), F.col("event_id")]), "event_type")
    out = f"{state}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)  # complete mode: each batch holds all totals

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{state}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_type", "n", F.col("digest").cast("string").alias("digest"))


@query("m4_event_time_windows", "SELECT CAST(time_bucket(INTERVAL '6 hours', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows by event time, with a watermark, in complete mode."""
    src, state = scratch(spark), scratch(spark)
    rows = table(spark, sf_dir, "events").select("ts", "event_type")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(src)
    seen = assemble.tail(spark, src, rows.schema).withWatermark("ts", "1 hour").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = f"{state}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("start"), "event_type", "n").write.mode("overwrite").parquet(out)

    seen.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{state}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
