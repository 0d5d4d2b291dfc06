"""Structured Streaming: tailing the log, assembling transactions, running digests."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

OUT = "key long, txn long, n_events long, first_gid long, last_gid long, ops string"
STATE = "txn long, gids string, ops string"


def tail(spark: SparkSession, place: str, schema: StructType, per_trigger: int = 64) -> DataFrame:
    """New files of a folder as they appear; ``per_trigger`` holds back the rest."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(place)


def _assemble(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    txn, gids, ops = state.get if state.exists else (0, "", "")
    held_gids, held_ops = [int(x) for x in gids.split(",") if x], [x for x in ops.split(",") if x]
    out: list[tuple[Any, ...]] = []
    rows = pd.concat(list(frames)).sort_values("gid")
    for gid, op, last in zip(rows["gid"], rows["op"], rows["is_last"], strict=True):
        held_gids.append(int(gid))
        held_ops.append(op)
        if last:
            out.append((key[0], txn, len(held_gids), held_gids[0], held_gids[-1], ",".join(held_ops)))
            txn, held_gids, held_ops = txn + 1, [], []
    state.update((txn, ",".join(map(str, held_gids)), ",".join(held_ops)))
    yield pd.DataFrame(out, columns=["key", "txn", "n_events", "first_gid", "last_gid", "ops"])


def transactions(events: DataFrame) -> DataFrame:
    """(key, gid, op, is_last) as one row per finished transaction of a key; what
    isn't finished waits in the state."""
    return events.groupBy("key").applyInPandasWithState(_assemble, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, place: str, checkpoint: str) -> None:
    """Process what is there and stop; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", place).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_in_order(stream: DataFrame, place: str, checkpoint: str, order: str) -> None:
    """As run_once(), each batch sorted before it is written. A batch that is
    repeated after a failure replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").parquet(f"{place}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_digest(events: DataFrame, digest: Any, by: str) -> DataFrame:
    """The additive digest of each table as events come in."""
    return events.groupBy(by).agg(F.sum(digest).alias("digest"), F.count(F.lit(1)).alias("n"))
