"""Evenly spread targets: long logs, and queries on odd logs against their SQL."""

from collections import Counter

import duckdb
import pytest

from retrolens.operators import depend
from retrolens.plans import catalog

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.mark.parametrize("total, ratio, first", [(6_000_000, 0.1, 5_990_000), (6_000_000, 0.05, 0), (6_000_000, 0.01, 3_000_000), (40_000_000_003, 0.37, 39_999_990_000), (3_000_000_000_000, 0.9, 2_999_999_990_000)])
def test_places_of_long_logs(spark, total, ratio, first):
    m = int(total * ratio + 0.5)
    got = sorted(r.place for r in depend.spread_places(spark.range(first, first + 9000).withColumnRenamed("id", "place"), total, ratio).collect())
    k = first * m // total
    want = {(2 * i + 1) * total // (2 * m) for i in range(max(0, k - 2), min(m, k + 9002))}
    assert got == sorted(p for p in want if first <= p < first + 9000)


def test_no_places_beyond_the_rows(spark):
    assert [r.place for r in depend.spread_places(spark.range(-50, 150).withColumnRenamed("id", "place"), 100, 0.02).collect()] == [25, 75]


#: Ids of the events: few, none, with gaps and below zero, repeated, null.
LOGS = {"empty": [], "few": [0, 1, 2], "nine": range(9), "gaps": range(-40, 2000, 7), "repeated": [x // 3 for x in range(400)], "nulls": [None if x % 11 == 5 else x for x in range(300)]}


def compare(spark, tmp_path, name, ids):
    kinds = ["signup", "view", "click", "purchase", "error"]
    rows = [(g, None, i % 13 if i % 17 else None, kinds[i * 7 % 5], 1.0, None) for i, g in enumerate(ids)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(sorted(found.columns))} FROM ({catalog.SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in found.select(*sorted(found.columns)).collect()) == Counter(want)


@pytest.mark.parametrize("ids", LOGS)
def test_anti_join_of_odd_logs(spark, tmp_path, ids):
    compare(spark, tmp_path, "f6_anti_join", LOGS[ids])


@pytest.mark.parametrize("ids", LOGS)
def test_sample_of_odd_logs(spark, tmp_path, ids):
    compare(spark, tmp_path, "h4_spread_sample", LOGS[ids])


def test_sample_takes_rows_without_an_id_last(spark, tmp_path):
    compare(spark, tmp_path, "h4_spread_sample", [None] * 40 + list(range(20)))


@pytest.mark.parametrize("ids", LOGS)
def test_auto_rollback_of_odd_logs(spark, tmp_path, ids):
    compare(spark, tmp_path, "j8_auto_rollback", LOGS[ids])
