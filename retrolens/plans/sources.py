"""Queries over sources, sinks, statements and procedures, with their SQL."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrolens import engine
from retrolens.functions import intervals as iv
from retrolens.lineage import cut, scratch
from retrolens.operators import access, cluster, depend, replay
from retrolens.operators import relations as rel
from retrolens.sources import config, sql, statelog

from .logs import ACCESS_SQL, CENTS, DECIDE_SQL, RELATIONS, TARGETS, TAINT_SQL, accesses, by_gid, decision, log, query, rows, table, user_state, values_sql

#: Tanks whose level is set, raised and looked at; each event of the log is one call.
TANKS_SCRIPT = """
DELIMITER $$
CREATE PROCEDURE calibrate(IN p_tank BIGINT, IN p_level BIGINT)
BEGIN
  DELETE FROM tanks WHERE tank_id = p_tank;
  INSERT INTO tanks (tank_id, level) VALUES (p_tank, p_level);
END$$
CREATE PROCEDURE pump(IN p_tank BIGINT, IN p_flow BIGINT)
BEGIN
  DECLARE v_seen BIGINT; DECLARE v_flow BIGINT DEFAULT 0;
  IF p_flow > 0 THEN SET v_flow = p_flow; END IF;
  SELECT level INTO v_seen FROM tanks WHERE tank_id = p_tank;
  INSERT INTO flows (tank_id, level_before, flow) VALUES (p_tank, v_seen, v_flow);
  UPDATE tanks SET level = level + v_flow WHERE tank_id = p_tank;
END$$
CREATE PROCEDURE inspect(IN p_tank BIGINT)
BEGIN
  DECLARE v_seen BIGINT;
  SELECT level INTO v_seen FROM tanks WHERE tank_id = p_tank;
  INSERT INTO inspections (tank_id, level_before) VALUES (p_tank, v_seen);
END$$
DELIMITER ;
"""
TANKS = '{"stateLog": {"name": "l"}, "keyColumns": ["tanks.tank_id"], "database": {"name": "works"}}'
TANK_KEYS = [("flows.tank_id", "tanks.tank_id"), ("inspections.tank_id", "tanks.tank_id")]
ADDED = "CALL pump(7, 1234)"
SNAPSHOT_AT = 10
CALL_SQL = f"""calls AS (SELECT event_id AS gid, 1 AS sub, user_id AS key, CASE event_type WHEN 'signup' THEN 'calibrate' WHEN 'purchase' THEN 'pump' WHEN 'click' THEN 'pump' ELSE 'inspect' END AS name,
  CASE event_type WHEN 'click' THEN -1 ELSE {CENTS} END AS amount FROM events)"""
TANK_SQL = """eras AS (SELECT *, CASE WHEN name = 'inspect' OR amount < 0 THEN 0 ELSE amount END AS flow,
  count(CASE WHEN name = 'calibrate' THEN 1 END) OVER (PARTITION BY key ORDER BY gid, sub ROWS UNBOUNDED PRECEDING) AS era FROM history),
seen AS (SELECT *, CASE WHEN era > 0 THEN sum(flow) OVER (PARTITION BY key, era ORDER BY gid, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS level FROM eras),
ends AS (SELECT key, sum(flow) AS level FROM eras e WHERE era > 0 AND era = (SELECT max(era) FROM eras m WHERE m.key = e.key) GROUP BY key)
SELECT 'tanks' AS name, key, CAST(1 AS BIGINT) AS n, CAST(level AS BIGINT) AS total FROM ends
UNION ALL SELECT CASE name WHEN 'pump' THEN 'flows' ELSE 'inspections' END, key, count(*), CAST(coalesce(sum(level), 0) AS BIGINT) FROM seen WHERE name <> 'calibrate' GROUP BY 1, 2"""
AFTER_SQL = f"hit AS (SELECT key, min(gid) AS since FROM calls WHERE gid IN ({', '.join(map(str, TARGETS))}) GROUP BY key), kept AS (SELECT * FROM calls WHERE gid NOT IN ({', '.join(map(str, TARGETS))}))"


def tank_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, q, statement): the events as calls."""
    key, cents = F.col("key").cast("string"), F.col("cents").cast("string")
    call = lambda name, *args: F.concat(F.lit(f"CALL {name}("), *[x for i, a in enumerate(args) for x in ((F.lit(", "), a) if i else (a,))], F.lit(")"))
    text = F.when(F.col("op") == "signup", call("calibrate", key, cents)).when(F.col("op") == "purchase", call("pump", key, cents)).when(F.col("op") == "click", call("pump", key, F.lit("-1")))
    return log(spark, sf_dir).select("gid", F.lit(0).alias("q"), text.otherwise(call("inspect", key)).alias("statement"))


def tank_engine(spark: SparkSession) -> engine.WhatIf:
    return engine.WhatIf(spark, config.loads(TANKS, {}), TANK_KEYS, sql.procedures(TANKS_SCRIPT))


def tank_totals(state: DataFrame) -> DataFrame:
    """(name, key, n, total) of the tables' rows."""
    field = lambda name: F.get_json_object("row", f"$.{name}").cast("long")
    seen = F.coalesce(F.sum(F.coalesce(field("level"), field("level_before"))), F.lit(0)).alias("total")
    return state.groupBy("name", field("tank_id").alias("key")).agg(F.count(F.lit(1)).alias("n"), seen)


def full_state(w: engine.WhatIf, calls: DataFrame, access: DataFrame) -> DataFrame:
    return w.state(calls, cut(w.components(access))).select("name", "row")


def without_targets(spark: SparkSession, sf_dir: str) -> tuple[engine.Plan, engine.Outcome]:
    """Calls taken out of a log whose final tables are there, with a snapshot from before."""
    w, calls = tank_engine(spark), tank_calls(spark, sf_dir)
    access = cut(w.analyse(calls))
    plan = w.plan(access, TARGETS)
    final = cut(full_state(w, calls, access))
    early = F.col("gid") <= SNAPSHOT_AT
    snapshot = cut(full_state(w, calls.where(early), access.where(early)))
    return plan, w.what_if(calls, access, plan, snapshot, SNAPSHOT_AT, final)


@query("j16_procedure_replay", f"WITH {CALL_SQL}, history AS (SELECT * FROM calls), {TANK_SQL}")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's calls run again, each as a call, components in parallel."""
    w, calls = tank_engine(spark), tank_calls(spark, sf_dir)
    return tank_totals(full_state(w, calls, cut(w.analyse(calls))))


@query("j16_removed_calls", f"WITH {CALL_SQL}, {AFTER_SQL}, history AS (SELECT * FROM kept), {TANK_SQL}")
def j16r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selective replay from a snapshot: equal to a full replay without the targets."""
    return tank_totals(without_targets(spark, sf_dir)[1].state)


@query(
    "j16_replayed_calls",
    f"WITH {CALL_SQL}, {AFTER_SQL} SELECT count(CASE WHEN gid > since THEN 1 END) AS planned, count(CASE WHEN gid < since THEN 1 END) AS support, count(*) AS ran FROM kept JOIN hit USING (key) WHERE gid > {SNAPSHOT_AT}",
)
def j16n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a selective replay ran: the planned calls, and those since the
    snapshot that the first planned ones build on."""
    plan, out = without_targets(spark, sf_dir)
    planned = out.ran.join(plan.gids().withColumn("planned", F.lit(1)), "gid", "left")
    return planned.agg(F.count("planned").alias("planned"), F.count(F.when(F.col("planned").isNull(), 1)).alias("support"), F.count(F.lit(1)).alias("ran"))


@query("j16_added_call", f"WITH {CALL_SQL}, {AFTER_SQL}, history AS (SELECT * FROM kept UNION ALL SELECT 500, 0, 7, 'pump', 1234), {TANK_SQL}")
def j16c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls taken out and one added before gid 500; no snapshot."""
    w, calls = tank_engine(spark), tank_calls(spark, sf_dir)
    access = cut(w.analyse(calls))
    return tank_totals(w.what_if(calls, access, w.plan(access, TARGETS, {500: [ADDED]})).state)


@query("j10_resumed_replay", f"WITH {CALL_SQL}, history AS (SELECT * FROM calls), {TANK_SQL}")
def j10r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables stored after gid 499, and a replay of the rest of the log from them."""
    w, calls, place = tank_engine(spark), tank_calls(spark, sf_dir), scratch(spark)
    access = cut(w.analyse(calls))
    early = F.col("gid") <= 499
    full_state(w, calls.where(early), access.where(early)).write.parquet(place)
    return tank_totals(w.resume(calls, access, spark.read.schema(engine.TABLES).parquet(place), 499))


@query("j3_procedure_dependency", f"WITH {CALL_SQL}, {AFTER_SQL} SELECT gid FROM kept JOIN hit USING (key) WHERE gid > since")
def j3p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the targets, later calls for their tanks run again."""
    w = tank_engine(spark)
    return w.plan(w.analyse(tank_calls(spark, sf_dir)), TARGETS).gids()


_CALL_COLUMNS = [
    ("calibrate", "R", "tanks.tank_id"), ("calibrate", "W", "tanks.*"), ("calibrate", "W", "tanks.level"), ("calibrate", "W", "tanks.tank_id"),
    ("pump", "R", "tanks.tank_id"), ("pump", "R", "tanks.level"), ("pump", "W", "tanks.level"), ("pump", "W", "flows.*"), ("pump", "W", "flows.tank_id"), ("pump", "W", "flows.level_before"), ("pump", "W", "flows.flow"),
    ("inspect", "R", "tanks.tank_id"), ("inspect", "R", "tanks.level"), ("inspect", "W", "inspections.*"), ("inspect", "W", "inspections.tank_id"), ("inspect", "W", "inspections.level_before"),
]


@query("d11_call_accesses", f"WITH {CALL_SQL}, c(name, rw, col) AS (VALUES {', '.join(map(str, _CALL_COLUMNS))}) SELECT rw, col AS \"column\", count(*) AS n FROM calls JOIN c USING (name) GROUP BY 1, 2")
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that the log's calls read and write, by tracing each call."""
    found = tank_engine(spark).analyse(tank_calls(spark, sf_dir)).where("what = 'column'")
    return found.groupBy("rw", "column").agg(F.count(F.lit(1)).alias("n"))


@query("a10_procedure_definitions", f"WITH {CALL_SQL} SELECT name, CAST(CASE name WHEN 'inspect' THEN 1 ELSE 2 END AS BIGINT) AS params, count(*) AS calls FROM calls GROUP BY name")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions written to the shared folder, loaded from there, and the log's calls of each."""
    place = scratch(spark)
    rows(spark, [(TANKS_SCRIPT,)], "value string").coalesce(1).write.text(place)
    found: dict[str, Any] = {}
    for r in spark.read.text(place, wholetext=True).collect():
        found |= sql.procedures(r.value)
    known = rows(spark, sorted((p.name, len(p.params)) for p in found.values()), "name string, params long")
    called = tank_calls(spark, sf_dir).groupBy(F.regexp_extract("statement", r"^CALL (\w+)", 1).alias("name")).agg(F.count(F.lit(1)).alias("calls"))
    return known.join(called, "name")


# ---- statements made of the tables' rows, analysed ----


def _text(*parts: str) -> Any:
    """A statement; ``:name`` stands for a column's value."""
    return F.concat(*[F.col(p[1:]).cast("string") if p.startswith(":") else F.lit(p) for p in parts])


def _expected(source: str, found: list[tuple[str, str, str, str, str]]) -> str:
    """SQL of what an analysis gives: rows (rw, what, column, n, points), numbers in terms of the table's count n."""
    rows_ = " UNION ALL ".join(f"SELECT '{rw}' AS rw, '{what}' AS what, '{c}' AS \"column\", CAST({n} AS BIGINT) AS n, CAST({points} AS BIGINT) AS points FROM c" for rw, what, c, n, points in found)
    return f"WITH c AS (SELECT count(*) AS n, count(*) FILTER (k % 2 = 1) AS odd FROM (SELECT {source})) {rows_}"


def _analysed(spark: SparkSession, rows_: DataFrame, key: str, columns: str, statement: Any) -> DataFrame:
    w = engine.WhatIf(spark, config.loads('{"stateLog": {"name": "l"}, "keyColumns": ["' + columns + '"], "database": {"name": "d"}}', {}))
    found = w.analyse(rows_.select(F.col(key).alias("gid"), F.lit(0).alias("q"), statement.alias("statement")))
    return found.groupBy("rw", "what", "column").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("point").alias("points"))


def _columns(rw: str, *names: str) -> list[tuple[str, str, str, str, str]]:
    return [(rw, "column", c, "n", "0") for c in names]


@query("d1_select", _expected("o_orderkey AS k FROM orders", [*_columns("R", "orders.o_custkey", "orders.o_orderkey", "orders.o_orderstatus", "orders.o_totalprice"), ("R", "item", "orders.o_orderkey", "n", "n")]))
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text("SELECT o_orderstatus, o_totalprice + 1 AS more FROM orders WHERE o_orderkey = ", ":o_orderkey", " AND o_custkey > ", ":o_custkey")
    return _analysed(spark, table(spark, sf_dir, "orders"), "o_orderkey", "orders.o_orderkey", text)


@query("d2_insert", _expected("o_orderkey AS k FROM orders", [*_columns("W", "orders.*", "orders.o_custkey", "orders.o_orderkey"), ("W", "item", "orders.o_orderkey", "2 * n", "n + 1")]))
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tuples a statement, one of them with the same key in all."""
    text = _text("INSERT INTO orders (o_orderkey, o_custkey) VALUES (", ":o_orderkey", ", 1), (-1, ", ":o_custkey", ")")
    return _analysed(spark, table(spark, sf_dir, "orders"), "o_orderkey", "orders.o_orderkey", text)


@query("d3_update", _expected("o_orderkey AS k FROM orders", [*_columns("R", "orders.o_orderkey", "orders.o_totalprice"), *_columns("W", "orders.o_orderstatus", "orders.o_totalprice"), ("R", "item", "orders.o_orderkey", "n", "n"), ("W", "item", "orders.o_orderkey", "n", "n")]))
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text("UPDATE orders SET o_totalprice = o_totalprice + 2, o_orderstatus = 'X' WHERE o_orderkey = ", ":o_orderkey")
    return _analysed(spark, table(spark, sf_dir, "orders"), "o_orderkey", "orders.o_orderkey", text)


@query("c17_projection", _expected("s_suppkey AS k FROM supplier", [*_columns("R", "supplier.s_acctbal", "supplier.s_name", "supplier.s_nationkey", "supplier.s_suppkey"), ("R", "item", "supplier.s_suppkey", "n", "n")]))
def c17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a SELECT list, also within calls and arithmetic."""
    text = _text("SELECT s_acctbal * 2 AS twice, CONCAT(UPPER(s_name), s_nationkey) FROM supplier WHERE s_suppkey = ", ":s_suppkey")
    return _analysed(spark, table(spark, sf_dir, "supplier"), "s_suppkey", "supplier.s_suppkey", text)


@query("c19_column_comparison", _expected("p_partkey AS k FROM part", [*_columns("R", "part.p_partkey", "part.p_size"), *_columns("W", "part.p_name"), ("R", "item", "part.p_partkey", "n", "0"), ("W", "item", "part.p_partkey", "n", "0")]))
def c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key compared with a column is the wildcard: no point."""
    return _analysed(spark, table(spark, sf_dir, "part"), "p_partkey", "part.p_partkey", _text("UPDATE part SET p_name = '", ":p_partkey", "' WHERE p_partkey = p_size"))


@query("c7_null_tests", _expected("p_partkey AS k FROM part", [*_columns("R", "part.p_name", "part.p_partkey"), ("R", "item", "part.p_partkey", "n", "odd")]))
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null test alone is the wildcard; beside a point it adds nothing."""
    text = F.when(F.col("p_partkey") % 2 == 1, _text("SELECT p_name FROM part WHERE p_partkey IS NOT NULL AND p_partkey = ", ":p_partkey")).otherwise(F.lit("SELECT p_name FROM part WHERE p_partkey IS NULL"))
    return _analysed(spark, table(spark, sf_dir, "part"), "p_partkey", "part.p_partkey", text)


@query("a13_plan_load", f"{DECIDE_SQL} SELECT gid, 'replay' AS what FROM plan WHERE replay UNION ALL SELECT unnest([11, 500])::BIGINT, 'rollback'")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch(spark)
    decision(spark, sf_dir).where("replay").select("gid").write.parquet(f"{place}/what=replay")
    rows(spark, [(g,) for g in TARGETS], "gid long").write.parquet(f"{place}/what=rollback")
    return spark.read.parquet(place).select("gid", "what")


@query("a14_user_transaction", values_sql([("INSERT", "W", "flows.*"), ("INSERT", "W", "flows.flow"), ("INSERT", "W", "flows.tank_id"), ("UPDATE", "R", "tanks.level"), ("UPDATE", "R", "tanks.tank_id"), ("UPDATE", "W", "tanks.level")], 'kind, rw, "column"'))
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = "START TRANSACTION; UPDATE tanks SET level = level - 40 WHERE tank_id = 9; INSERT INTO flows (tank_id, flow) VALUES (9, -40); COMMIT;"
    out = [(d.kind, rw, c) for d in sql.parse_script(script) for rw, cs in (("R", access.accesses(d).reads), ("W", access.accesses(d).writes)) for c in cs]
    return rows(spark, sorted(out), "kind string, rw string, column string")


@query("a16_mocked_log", values_sql([(1, 10), (2, 20)], "gid, xid"))
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log made in memory with the full record type."""
    made = [(i, i * 10, 0, True, 0, [], [(0, "UPDATE", "shop", "u", ["t.a"], ["t.a"], 1, None)]) for i in (1, 2)]
    return spark.createDataFrame(made, statelog.TRANSACTION).select("gid", "xid")


@query("b1_log_append", "SELECT event_type AS op, count(*) AS n FROM events GROUP BY 1")
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, one log."""
    place, base = scratch(spark), log(spark, sf_dir)
    statelog.write(base.where("gid < 500"), place)
    statelog.write(base.where("gid >= 500"), place)
    return statelog.read(spark, place).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("b2_gid_index", "SELECT event_id AS gid, user_id AS key FROM events WHERE event_id IN (0, 11, 999)")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted files answer gids from their statistics."""
    place = scratch(spark)
    statelog.write(log(spark, sf_dir), place)
    return statelog.read(spark, place).where("gid IN (0, 11, 999)").select("gid", "key")


@query("b3_graph_save", f"""WITH {ACCESS_SQL} SELECT key, rw, count(*) AS n FROM acc GROUP BY ALL""")
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch(spark)
    accesses(spark, sf_dir).groupBy("key", "rw").agg(F.count(F.lit(1)).alias("n")).write.partitionBy("rw").parquet(place)
    return spark.read.parquet(place).select("key", "rw", "n")


@query("b7_manual_statements", values_sql([("DELETE FROM shop.items WHERE (id=1)",), ("REPLACE INTO shop.items SELECT * FROM tmp.items WHERE (id=1)",)], "statement"))
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be run, without running it."""
    return rows(spark, [(s,) for s in replay.replace_statements([{"items.id": iv.leaf("=", [1])}], [(["items.id"], False)], "shop", "tmp")], "statement string")


@query("c18_recursive_columns", values_sql([("t.a",), ("t.b",), ("t.k",), ("s.x",), ("s.y",), ("v.z",), ("v.w",)], '"column"'))
def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT CONCAT(a, UPPER(b)), (SELECT MAX(z) FROM v WHERE w > 1) FROM t WHERE k IN (SELECT x + 1 FROM s WHERE y = 2)"
    return rows(spark, [(c,) for c in sorted(access.accesses(sql.parse(text)).reads)], "column string")


@query("e5_row_chain", "WITH d AS (SELECT event_id AS gid, event_id % 97 AS a, user_id AS r FROM events WHERE event_type = 'signup'), i AS (SELECT event_id AS gid, event_id % 97 AS value FROM events WHERE event_type = 'click') SELECT i.gid, 'users.id' AS \"column\", coalesce(d.r, i.value) AS value FROM i ASOF LEFT JOIN d ON i.value = d.a AND i.gid >= d.gid")
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by row alias, names by foreign key."""
    base = log(spark, sf_dir)
    learnt = base.where("op = 'signup'").select((F.col("gid") % 97).alias("alias_value"), F.col("key").alias("real_value"), "gid")
    items = rel.resolve_row_aliases(base.where("op = 'click'").select("gid", (F.col("gid") % 97).alias("value")), learnt)
    return items.select("gid", RELATIONS.resolved(F.lit("stats.user_id")).alias("column"), F.col("real_value").alias("value"))


@query("e6_resolved_log", "WITH k AS (SELECT event_id AS gid, CASE WHEN event_type = 'purchase' THEN 'orders.user_id' ELSE 'stats.user_id' END AS c FROM events) SELECT 'users.id' AS \"column\", count(*) AS n FROM k")
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = log(spark, sf_dir).select(F.when(F.col("op") == "purchase", "orders.user_id").otherwise("stats.user_id").alias("column"))
    return named.select(RELATIONS.resolved(F.col("column")).alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g4_composite_merge",
    """WITH RECURSIVE e AS (SELECT l_orderkey AS g, 'p' || (l_partkey % 60) AS k FROM lineitem WHERE l_orderkey % 53 = 1 UNION SELECT l_orderkey, 's' || (l_suppkey % 30) FROM lineitem WHERE l_orderkey % 53 = 1),
r(k, m) AS (SELECT k, k FROM e UNION SELECT b.k, r.m FROM r JOIN e a ON a.k = r.k JOIN e b ON b.g = a.g WHERE r.m < b.k) SELECT k AS node, min(m) AS root FROM r GROUP BY 1""",
)
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two columns that some transaction ties together."""
    li = table(spark, sf_dir, "lineitem").where("l_orderkey % 53 = 1")
    p = F.concat(F.lit("p"), (F.col("l_partkey") % 60).cast("string"))
    s = F.concat(F.lit("s"), (F.col("l_suppkey") % 30).cast("string"))
    ties = li.select("l_orderkey", F.explode(F.array(p, s)).alias("k")).distinct()
    least = ties.groupBy("l_orderkey").agg(F.min("k").alias("a"))
    return cluster.components(ties.join(least, "l_orderkey").select("a", F.col("k").alias("b")).distinct())


@query("g4_composite_merge_all")
def g4_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g4_composite_merge over all rows and real keys; recursive SQL is too slow for it."""
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    ties = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(F.array(p, s)).alias("k")).distinct()
    least = ties.groupBy("l_orderkey").agg(F.min("k").alias("a"))
    return cluster.components(ties.join(least, "l_orderkey").select("a", F.col("k").alias("b")).distinct())


@query("g13_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("h1_window_functions", "SELECT o_custkey, o_orderkey, row_number() OVER w AS place, o_orderkey - lag(o_orderkey) OVER w AS step FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    place = F.row_number().over(w).cast("long")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", place.alias("place"), (F.col("o_orderkey") - F.lag("o_orderkey").over(w)).alias("step"))


@query("j2_taint_rounds", f"WITH RECURSIVE {TAINT_SQL} SELECT count(*) AS columns, min(g) AS first_gid, max(g) AS last_gid FROM first")
def j2r(spark: SparkSession, sf_dir: str) -> DataFrame:
    taint = depend.earliest_taint(by_gid(spark, sf_dir), TARGETS, RELATIONS)
    return rows(spark, [(len(taint), min(taint.values()), max(taint.values()))], "columns long, first_gid long, last_gid long")


@query("l6_dml_sequence", "SELECT s_suppkey, CASE WHEN s_nationkey = 2 THEN 'moved' ELSE s_name END AS s_name FROM supplier WHERE s_nationkey <> 4 UNION ALL SELECT 100000, 'new'")
def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT, UPDATE and DELETE as a chain of snapshots."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    s = s.unionByName(rows(spark, [(100000, "new", 3)], "s_suppkey long, s_name string, s_nationkey int"))
    s = replay.update(s, F.col("s_nationkey") == 2, {"s_name": F.lit("moved")})
    return replay.delete(s, F.col("s_nationkey") == 4).select("s_suppkey", "s_name")


@query("j10_replay_from", "SELECT count(*) AS n, count(state) AS known FROM (SELECT user_id, max(event_id) FILTER (event_type IN ('signup', 'error')) AS state FROM events WHERE event_id < 500 GROUP BY 1)")
def j10f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state just before the last target, from which a replay may go on."""
    return user_state(replay.state_at(log(spark, sf_dir), 499)).agg(F.count(F.lit(1)).alias("n"), F.count("state").alias("known"))
