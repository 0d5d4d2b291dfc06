"""The relational substrate: workload shapes, scalar functions, set operations
and the star-schema queries, written with the DataFrame API, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrolens.functions import scalar as fn
from retrolens.operators import access, procedures, replay
from retrolens.sources import config

from .logs import QUERIES, rows, query, table, values_sql

C = F.col


def cents(c: str) -> object:
    return F.round(F.col(c) * 100).cast("long")


# ---- K: scalar functions ----


@query("k1_arithmetic", "SELECT o_orderkey, o_custkey + 7 AS a, o_custkey * 3 - o_orderkey AS b, CAST(trunc((o_orderkey - 500) / 7) AS BIGINT) AS d, (o_orderkey - 500) % 7 AS m, -o_custkey AS neg FROM orders")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    x = C("o_orderkey") - 500
    return o.select("o_orderkey", (C("o_custkey") + 7).alias("a"), (C("o_custkey") * 3 - C("o_orderkey")).alias("b"), fn.int_div(x, F.lit(7)).alias("d"), fn.mod(x, F.lit(7)).alias("m"), (-C("o_custkey")).alias("neg"))


@query("k2_concat", "SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM customer")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", fn.concat(C("c_name"), F.lit("/"), C("c_mktsegment")).alias("label"))


@query("k3_byte_length", "SELECT p_partkey, CAST(strlen(p_name) AS BIGINT) AS n FROM part")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fn.length(C("p_name")).cast("long").alias("n"))


@query("k4_md5", "SELECT p_partkey, md5(p_name) AS digest FROM part")
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.md5("p_name").alias("digest"))


@query("k5_recorded_time", "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at FROM events")
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNIX_TIMESTAMP of the recorded time."""
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(C("ts").cast("timestamp")).alias("_us")).select("event_id", F.floor(C("_us") / 1_000_000).alias("at"))


@query("k6_coalesce_next_id", "SELECT coalesce(max(o_orderkey), 0) + 1 AS next_id FROM orders WHERE o_custkey = 7")
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_custkey = 7").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_id"))


@query("k7_bound_ids", "SELECT event_id, CAST(9000 AS BIGINT) + event_id AS insert_id FROM events WHERE event_type = 'signup'")
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAST_INSERT_ID as recorded, not as drawn."""
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select("event_id", (fn.bound(9000, "long") + C("event_id")).alias("insert_id"))


@query("k8_json", """SELECT event_id, '{"id":' || event_id || ',"op":"' || event_type || '"}' AS made, json_extract_string(props, '$.k') AS k, CAST(len(json_keys(props)) AS BIGINT) AS n FROM events""")
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fn.json_object(id=C("event_id"), op=C("event_type"))
    return table(spark, sf_dir, "events").select("event_id", made.alias("made"), fn.json_text(C("props"), "$.k").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n"))


@query("k9_floor_mod_bits", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS f, o_custkey % 16 AS m, (o_custkey | 5) AS b FROM orders")
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("f"), (C("o_custkey") % 16).alias("m"), C("o_custkey").bitwiseOR(F.lit(5)).alias("b"))


@query("k10_logged_constants", "SELECT r_regionkey, 'x = ''' || r_name || ''' AND y = ' || r_regionkey AS statement FROM region")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = F.concat(F.lit("x = NAME_CONST('v',_utf8mb4'"), C("r_name"), F.lit("' COLLATE 'utf8mb4_bin') AND y = NAME_CONST('w',"), C("r_regionkey").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "region").select("r_regionkey", fn.implicit_name(logged).alias("statement"))


@query("k11_session_variables", "SELECT count(*) AS n FROM orders WHERE o_custkey > 700")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("DECLARE OR REPLACE VARIABLE k11_limit BIGINT DEFAULT 1")
    spark.sql("SET VAR k11_limit = 7 * 100")
    low = spark.sql("SELECT k11_limit").first()[0]
    return table(spark, sf_dir, "orders").where(C("o_custkey") > low).agg(F.count(F.lit(1)).alias("n"))


@query("k12_null_safe_equal", "SELECT count(*) AS n FROM events a JOIN events b ON a.event_id + 1 = b.event_id AND nullif(a.event_type, 'error') IS NOT DISTINCT FROM nullif(b.event_type, 'error')")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("t"))
    a, b = e.select((C("event_id") + 1).alias("id"), C("t").alias("x")), e.select(C("event_id").alias("id"), "t")
    return a.join(b, "id").where(fn.null_safe_equal(C("x"), C("t"))).agg(F.count(F.lit(1)).alias("n"))


@query("k13_case_extract_ilike", "SELECT CASE WHEN p_name ILIKE '%RED%' THEN 'red' WHEN p_size > 25 THEN 'big' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1")
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(C("p_name").ilike("%RED%"), "red").when(C("p_size") > 25, "big").otherwise("other")
    return table(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


LCG = "((c_custkey * 1103515245 + 12345) % 2147483648)"


@query("k21_seeded_random", f"SELECT c_custkey, CAST(10 + {LCG} % 91 AS BIGINT) AS r, CAST((({LCG} % 256 | (1 + (({LCG} * 1103515245 + 12345) % 2147483648) % 1000)) + 42) % 1000 + 1 AS BIGINT) AS nu FROM customer")
def k21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", fn.random_number(C("c_custkey"), 10, 100).alias("r"), fn.non_uniform(C("c_custkey"), 255, 1, 1000, 42).alias("nu"))


_LIT, _VAR = (lambda v: ("lit", v)), (lambda n: ("var", n))
#: A parcel goes to a lane by its weight; what is too heavy waits.
DISPATCH = procedures.Procedure(
    "dispatch",
    [("IN", "parcel"), ("IN", "weight"), ("OUT", "lane")],
    [
        ("set", "lane", ("+", ("div", _VAR("weight"), _LIT(10)), _LIT(1))),
        ("if", [((">", _VAR("weight"), _LIT(50)), [("set", "lane", _LIT(0)), ("sql", access.Dml("INSERT", "waiting", rows=({"parcel": _VAR("parcel")},)))])], [
            ("into", access.Dml("SELECT", "lanes", select=("gate",), where=("=", "lane", [_VAR("lane")])), ["gate"]),
            ("sql", access.Dml("UPDATE", "parcels", sets={"gate": ()}, values={"gate": _VAR("gate")}, where=("=", "parcel", [_VAR("parcel")]))),
            ("sql", access.Dml("UPDATE", "lanes", sets={"held": ("held",)}, where=("=", "lane", [_VAR("lane")]))),
        ]),
    ],
)


@query("k22_procedure_run", "SELECT p_size AS weight, CAST(CASE WHEN p_size > 50 THEN 0 ELSE p_size // 10 + 1 END AS BIGINT) AS lane, CAST(CASE WHEN p_size > 50 THEN 1 ELSE 2 END AS BIGINT) AS writes, count(*) AS parcels FROM part GROUP BY ALL")
def k22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The procedure run for every part, with its size for a weight."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for parcel, weight in zip(f["p_partkey"], f["p_size"], strict=True):
                ran: list[str] = []
                lane = DISPATCH.run([int(parcel), int(weight), None], lambda dml, scope, ran=ran: ran.append(dml.kind) or [4])["lane"]
                out.append((weight, lane, sum(k != "SELECT" for k in ran)))
            yield pd.DataFrame(out, columns=["weight", "lane", "writes"])

    ran = table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(run, "weight int, lane long, writes long")
    return ran.groupBy("weight", "lane", "writes").agg(F.count(F.lit(1)).alias("parcels"))


@query("k23_procedure_trace", values_sql([("R", "lanes.gate"), ("R", "lanes.held"), ("R", "lanes.lane"), ("R", "parcels.parcel"), ("W", "lanes.held"), ("W", "parcels.gate"), ("W", "waiting.*"), ("W", "waiting.parcel")], 'rw, "column"'))
def k23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both branches, without running either."""
    a = DISPATCH.trace([1, 5, None])
    return rows(spark, sorted([("R", c) for c in a.reads] + [("W", c) for c in a.writes]), "rw string, column string")


@query("k24_call_text", values_sql([(0, "SET @out_2 = NULL"), (1, "CALL dispatch(1, 'a''b', @out_2)")], "place, statement"))
def k24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, list(enumerate(procedures.call_text(DISPATCH, [1, "a'b", None]))), "place long, statement string")


@query("k26_statement_splitter", values_sql([(0, "SELECT ';' AS a"), (1, "CREATE PROCEDURE p() BEGIN SELECT 1; SELECT 2; END"), (2, "SELECT 3")], "place, statement"))
def k26(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = "SELECT ';' AS a; -- a; comment\nDELIMITER //\nCREATE PROCEDURE p() BEGIN SELECT 1; SELECT 2; END//\nDELIMITER ;\nSELECT 3"
    return rows(spark, list(enumerate(procedures.split_statements(script))), "place long, statement string")


@query("a15_config", values_sql([("log", "shop", 3, "eqonly", "users.id")], "log, database, key_groups, comparison, login"))
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"stateLog": {"name": "log"}, "keyColumns": ["a.x+a.y", "b.z,c.w"], "database": {"name": "shop"}, "stateChange": {"columnAliases": ["users.login=users.id"]}}'
    c = config.loads(text, {})
    return rows(spark, [(c.log_name, c.database, len(c.groups()), c.comparison, c.relations().alias("users.login"))], "log string, database string, key_groups long, comparison string, login string")


# ---- K30 and on: shapes of the workloads ----


@query("k30_join_sort_limit", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_nationkey = 3 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def k30(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_nationkey = 3"), C("o_custkey") == C("c_custkey"))
    return j.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey", "c_name")


@query("k31_average_over_join", "SELECT round(avg(l_quantity), 6) AS mean FROM lineitem, orders WHERE l_orderkey = o_orderkey AND o_custkey < 100 AND l_suppkey < 50")
def k31(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").where("l_suppkey < 50").join(table(spark, sf_dir, "orders").where("o_custkey < 100"), C("l_orderkey") == C("o_orderkey"))
    return j.agg(F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("k32_filtered_average", "SELECT round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_partkey = 15")
def k32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_partkey = 15").agg(F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("k33_filter_sort", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 10 ORDER BY o_totalprice DESC")
def k33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_custkey = 10").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"))


@query("k34_composite_interval_join", "SELECT e.event_id, f.event_id AS f_id FROM events e JOIN events f ON e.user_id = f.user_id AND f.event_type = 'signup' AND e.event_type = 'view' AND f.event_id <= e.event_id AND f.event_id + 40 > e.event_id")
def k34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key equality and an interval of fixed length: the interval is dealt to
    two buckets of its length, so the join is on equality."""
    e = table(spark, sf_dir, "events")
    f = e.where("event_type = 'signup'").select(C("user_id").alias("u"), C("event_id").alias("f_id"))
    f = f.withColumn("b", F.explode(F.array(F.floor(C("f_id") / 40), F.floor(C("f_id") / 40) + 1)))
    v = e.where("event_type = 'view'").withColumn("b2", F.floor(C("event_id") / 40))
    return v.join(f, (C("user_id") == C("u")) & (C("b") == C("b2")) & (C("f_id") <= C("event_id")) & (C("f_id") + 40 > C("event_id"))).select("event_id", "f_id")


@query("k35_in_union_or", "SELECT count(*) AS n FROM orders WHERE (o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1 UNION SELECT s_suppkey FROM supplier) OR o_custkey = 700) AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'")
def k35(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").where("c_nationkey = 1").select(C("c_custkey").alias("id")).union(table(spark, sf_dir, "supplier").select("s_suppkey")).union(spark.range(700, 701).toDF("id"))
    o = table(spark, sf_dir, "orders").where("o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'")
    return o.join(ids.distinct(), C("o_custkey") == C("id"), "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("k36_scalar_minimum", "SELECT (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F') AS first, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending")
def k36(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.agg(F.min(F.when(C("o_orderstatus") == "F", C("o_orderkey"))).alias("first"), F.count(F.when(C("o_orderstatus") == "P", 1)).alias("pending"))


@query("k37_guard_and_first", "SELECT (count(*) < 1) AS missing, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS total, min(l_orderkey) AS oldest FROM lineitem WHERE l_suppkey = 7")
def k37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_suppkey = 7").agg((F.count(F.lit(1)) < 1).alias("missing"), F.coalesce(F.sum(C("l_quantity").cast("long")), F.lit(0)).alias("total"), F.min("l_orderkey").alias("oldest"))


@query("k38_nested_join", "SELECT d.n_name, count(*) AS n FROM (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) d JOIN orders ON d.c_custkey = o_custkey GROUP BY 1")
def k38(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), C("c_nationkey") == C("n_nationkey")).select("c_custkey", "n_name")
    return d.join(table(spark, sf_dir, "orders"), C("c_custkey") == C("o_custkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("k39_update_by_subquery", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)) THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def k39(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(C("o_custkey").alias("c_custkey")).distinct().withColumn("_hit", F.lit(True))
    c = table(spark, sf_dir, "customer").join(hit, "c_custkey", "left")
    return replay.update(c, C("_hit"), {"c_mktsegment": F.lit("VIP")}).select("c_custkey", "c_mktsegment")


@query("k40_branched_update", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_nationkey = 3 THEN 'home' WHEN s_acctbal > 5000 THEN 'rich' ELSE s_name END AS s_name FROM supplier")
def k40(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(C("s_acctbal") < 0, "debt").when(C("s_nationkey") == 3, "home").when(C("s_acctbal") > 5000, "rich").otherwise(C("s_name"))
    return replay.update(table(spark, sf_dir, "supplier"), F.lit(True), {"s_name": name}).select("s_suppkey", "s_name")


@query("d4_delete_keeps_null", "SELECT event_id FROM events WHERE NOT coalesce(nullif(event_type, 'error') = 'view', false)")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DELETE keeps rows whose predicate is null."""
    e = table(spark, sf_dir, "events")
    return replay.delete(e, F.nullif("event_type", F.lit("error")) == "view").select("event_id")


@query("d6_upsert", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'new' ELSE n_name END AS n_name FROM nation")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return replay.upsert(n, n.where("n_regionkey = 1").withColumn("n_name", F.lit("new")), ["n_nationkey"]).select("n_nationkey", "n_name")


# ---- L: the grammar's surface ----


@query("l1_distinct_top", "SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 5 OFFSET 2")
def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand").distinct().orderBy("p_brand").offset(2).limit(5)


@query("l2_set_operations", "SELECT 'u' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'ia', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'ea', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'e', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    a, b = c.select("c_nationkey"), s.select("s_nationkey")
    made = {"u": a.union(b).distinct(), "ia": a.intersectAll(b), "ea": a.exceptAll(b), "e": n.select("n_nationkey").subtract(s.where("s_acctbal > 9000").select("s_nationkey"))}
    out = None
    for k, d in made.items():
        one = d.agg(F.lit(k).alias("op"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("l3_with", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_nationkey, max(n) AS most FROM customer JOIN big ON c_custkey = o_custkey GROUP BY 1")
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(big, C("c_custkey") == C("o_custkey")).groupBy("c_nationkey").agg(F.max("n").alias("most"))


@query("l4_full_natural_using", "SELECT count(*) AS n, count(s_suppkey) AS s, count(c_custkey) AS c FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
def l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "customer"), (C("s_suppkey") == C("c_custkey")) & (C("s_nationkey") == C("c_nationkey")), "full")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("s_suppkey").alias("s"), F.count("c_custkey").alias("c"))


@query("l5_expressions", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS s, (o_orderpriority LIKE '1%' OR o_orderpriority NOT LIKE '%LOW') AS p, [o_custkey, o_orderkey][2] AS second FROM orders")
def l5(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(C("o_orderstatus") == "F", 1).when(C("o_orderstatus") == "O", 2).otherwise(3)
    p = C("o_orderpriority").like("1%") | ~C("o_orderpriority").like("%LOW")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), s.alias("s"), p.alias("p"), F.array("o_custkey", "o_orderkey")[1].alias("second"))


@query("l6_prepared_statement", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey < 300 AND o_orderpriority = '1-URGENT' GROUP BY 1")
def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_custkey < :k AND o_orderpriority = :p GROUP BY 1", args={"k": 300, "p": "1-URGENT"}, orders=orders)


REV = "CAST(round(sum(round(l_extendedprice * (1 - l_discount) * 100)), 0) AS BIGINT)"


def revenue() -> object:
    return F.sum(F.round(C("l_extendedprice") * (1 - C("l_discount")) * 100)).cast("long")


@query("l7_tpch01", f"SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, {REV} AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def h01(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(C("l_quantity").cast("long")).alias("sum_qty"), revenue().alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("l7_tpch03", f"SELECT l_orderkey, {REV} AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1996-03-15' AND l_shipdate > TIMESTAMP '1996-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
def h03(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderdate < TIMESTAMP '1996-03-15'").join(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), C("c_custkey") == C("o_custkey"), "left_semi")
    li = table(spark, sf_dir, "lineitem").where("l_shipdate > TIMESTAMP '1996-03-15'")
    return li.join(o, C("l_orderkey") == C("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg(revenue().alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@query("l7_tpch04", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1996-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate) GROUP BY 1")
def h04(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1996-10-01'")
    return o.join(table(spark, sf_dir, "lineitem"), (C("l_orderkey") == C("o_orderkey")) & (C("l_shipdate") < C("o_orderdate")), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("l7_tpch05", f"SELECT n_name, {REV} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def h05(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), C("n_regionkey") == C("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(n, C("s_nationkey") == C("n_nationkey"))
    o = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'").join(table(spark, sf_dir, "customer"), C("o_custkey") == C("c_custkey"))
    j = table(spark, sf_dir, "lineitem").join(o, C("l_orderkey") == C("o_orderkey")).join(s, (C("l_suppkey") == C("s_suppkey")) & (C("c_nationkey") == C("s_nationkey")))
    return j.groupBy("n_name").agg(revenue().alias("revenue"))


@query("l7_tpch06", "SELECT CAST(round(sum(round(l_extendedprice * l_discount * 100)), 0) AS BIGINT) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def h06(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
    return li.agg(F.sum(F.round(C("l_extendedprice") * C("l_discount") * 100)).cast("long").alias("revenue"))


@query("l7_tpch07", f"SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS y, {REV} AS revenue FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) GROUP BY ALL")
def h07(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = table(spark, sf_dir, "nation").where("n_name IN ('NATION_1', 'NATION_2')")
    s = table(spark, sf_dir, "supplier").join(two.select(C("n_nationkey").alias("k1"), C("n_name").alias("supp_nation")), C("s_nationkey") == C("k1"))
    c = table(spark, sf_dir, "customer").join(two.select(C("n_nationkey").alias("k2"), C("n_name").alias("cust_nation")), C("c_nationkey") == C("k2"))
    j = table(spark, sf_dir, "lineitem").join(s, C("l_suppkey") == C("s_suppkey")).join(table(spark, sf_dir, "orders").join(c, C("o_custkey") == C("c_custkey")), C("l_orderkey") == C("o_orderkey")).where("supp_nation <> cust_nation")
    return j.groupBy("supp_nation", "cust_nation", F.year("l_shipdate").cast("long").alias("y")).agg(revenue().alias("revenue"))


@query("l7_tpch08", "SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, round(sum(CASE WHEN n2.n_name = 'NATION_3' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY' GROUP BY 1")
def h08(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    home = n.join(table(spark, sf_dir, "region").where("r_name = 'AMERICA'"), C("n_regionkey") == C("r_regionkey"), "left_semi").select(C("n_nationkey").alias("hk"))
    c = table(spark, sf_dir, "customer").join(home, C("c_nationkey") == C("hk"), "left_semi")
    s = table(spark, sf_dir, "supplier").join(n, C("s_nationkey") == C("n_nationkey")).select("s_suppkey", "n_name")
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").where("p_type = 'ECONOMY'"), C("l_partkey") == C("p_partkey"), "left_semi")
    j = li.join(s, C("l_suppkey") == C("s_suppkey")).join(table(spark, sf_dir, "orders").join(c, C("o_custkey") == C("c_custkey"), "left_semi"), C("l_orderkey") == C("o_orderkey"))
    v = C("l_extendedprice") * (1 - C("l_discount"))
    return j.groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.round(F.sum(F.when(C("n_name") == "NATION_3", v).otherwise(0.0)) / F.sum(v), 6).alias("share"))


@query("l7_tpch10", f"SELECT c_custkey, c_name, n_name, {REV} AS revenue FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01' GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20")
def h10(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'")
    per = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(o, C("l_orderkey") == C("o_orderkey")).groupBy("o_custkey").agg(revenue().alias("revenue"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), C("c_nationkey") == C("n_nationkey"))
    return per.join(c, C("o_custkey") == C("c_custkey")).orderBy(F.desc("revenue"), "c_custkey").limit(20).select("c_custkey", "c_name", "n_name", "revenue")


@query("l7_tpch12", "SELECT l_returnflag, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def h12(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'")
    urgent = C("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return li.join(table(spark, sf_dir, "orders"), C("l_orderkey") == C("o_orderkey")).groupBy("l_returnflag").agg(F.count(F.when(urgent, 1)).alias("high"), F.count(F.when(~urgent, 1)).alias("low"))


@query("l7_tpch13", "SELECT k, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%LOW%' GROUP BY 1) GROUP BY 1")
def h13(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").where(~C("o_orderpriority").like("%LOW%")).groupBy("o_custkey").agg(F.count("o_orderkey").alias("k"))
    return table(spark, sf_dir, "customer").join(per, C("c_custkey") == C("o_custkey"), "left").groupBy(F.coalesce("k", F.lit(0)).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("l7_tpch14", "SELECT round(100.0 * sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1996-10-01'")
def h14(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = C("l_extendedprice") * (1 - C("l_discount"))
    j = table(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1996-10-01'").join(table(spark, sf_dir, "part"), C("l_partkey") == C("p_partkey"))
    return j.agg(F.round(100.0 * F.sum(F.when(C("p_type") == "PROMO", v).otherwise(0.0)) / F.sum(v), 6).alias("promo"))


@query("l7_tpch15", f"WITH r AS (SELECT l_suppkey, {REV} AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY 1) SELECT s_suppkey, s_name, total FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM r)")
def h15(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01'").groupBy("l_suppkey").agg(revenue().alias("total"))
    best = r.join(F.broadcast(r.agg(F.max("total").alias("most"))), C("total") == C("most"))  # one row
    return best.join(table(spark, sf_dir, "supplier"), C("l_suppkey") == C("s_suppkey")).select("s_suppkey", "s_name", "total")


@query("l7_tpch16", "SELECT p_brand, p_type, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (9, 14, 23, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL")
def h16(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (9, 14, 23, 45, 49)")
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").where("s_acctbal < 0"), C("l_suppkey") == C("s_suppkey"), "left_anti")
    return li.join(p, C("l_partkey") == C("p_partkey")).groupBy("p_brand", "p_type").agg(F.countDistinct("l_suppkey").alias("suppliers"))


@query("l7_tpch17", "SELECT CAST(round(sum(round(l_extendedprice * 100)), 0) AS BIGINT) AS total FROM lineitem l JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#2' AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)")
def h17(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").where("p_brand = 'Brand#2'"), C("l_partkey") == C("p_partkey"), "left_semi")
    low = li.withColumn("low", 0.5 * F.avg("l_quantity").over(Window.partitionBy("l_partkey"))).where("l_quantity < low")
    return low.agg(F.sum(F.round(C("l_extendedprice") * 100)).cast("long").alias("total"))


@query("l7_tpch18", "SELECT c_name, o_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 250) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY ALL")
def h18(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(C("l_quantity").cast("long")).alias("q")).where("q > 250")
    o = table(spark, sf_dir, "orders").join(big, C("o_orderkey") == C("l_orderkey"))
    return o.join(table(spark, sf_dir, "customer"), C("o_custkey") == C("c_custkey")).select("c_name", "o_orderkey", "q")


@query("l7_tpch19", f"SELECT coalesce({REV}, 0) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#2' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#17' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)")
def h19(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), C("l_partkey") == C("p_partkey"))
    one = (C("p_brand") == "Brand#2") & C("l_quantity").between(1, 11) & C("p_size").between(1, 15)
    two = (C("p_brand") == "Brand#17") & C("l_quantity").between(10, 20) & C("p_size").between(1, 30)
    return j.where(one | two).agg(F.coalesce(revenue(), F.lit(0)).alias("revenue"))


@query("l7_tpch22", "SELECT c_nationkey, count(*) AS n, CAST(sum(round(c_acctbal * 100)) AS BIGINT) AS total FROM customer WHERE c_nationkey IN (1, 3, 5, 7) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY 1")
def h22(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    mean = F.broadcast(c.where("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean")))  # one row
    rich = c.where("c_nationkey IN (1, 3, 5, 7)").join(mean, C("c_acctbal") > C("mean"))
    rich = rich.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), C("c_custkey") == C("o_custkey"), "left_anti")
    return rich.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(C("c_acctbal") * 100)).cast("long").alias("total"))


assert QUERIES


# ---- queries on parts and suppliers: what each supplier sold of each part stands in for its offer ----

PS_SQL = "ps AS (SELECT l_partkey AS pk, l_suppkey AS sk, min(CAST(floor(l_extendedprice * 100) AS BIGINT)) AS cost, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS avail FROM lineitem GROUP BY 1, 2)"


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pk, sk, cost, avail)."""
    cost = F.floor(C("l_extendedprice") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(C("l_partkey").alias("pk"), C("l_suppkey").alias("sk")).agg(F.min(cost).alias("cost"), F.sum(C("l_quantity").cast("long")).alias("avail"))


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their nation and region."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, C("s_nationkey") == C("n_nationkey"))


@query("l7_tpch02", f"WITH {PS_SQL}, o AS (SELECT * FROM ps JOIN supplier ON s_suppkey = sk JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = pk WHERE n_regionkey = 2 AND p_size < 20) SELECT s_name, n_name, pk, cost FROM o WHERE cost = (SELECT min(cost) FROM o i WHERE i.pk = o.pk)")
def h02(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir).join(sellers(spark, sf_dir).where("n_regionkey = 2"), C("sk") == C("s_suppkey"))
    o = o.join(table(spark, sf_dir, "part").where("p_size < 20").select("p_partkey"), C("pk") == C("p_partkey"))
    return o.join(o.groupBy("pk").agg(F.min("cost").alias("cost")), ["pk", "cost"]).select("s_name", "n_name", "pk", "cost")


@query("l7_tpch09", f"WITH {PS_SQL} SELECT n_name, year(o_orderdate) AS y, CAST(sum(CAST(floor(l_extendedprice * 100) AS BIGINT) - cost) AS BIGINT) AS profit FROM lineitem JOIN ps ON pk = l_partkey AND sk = l_suppkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size % 3 = 0 GROUP BY ALL")
def h09(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").where("p_size % 3 = 0").select("p_partkey"), C("l_partkey") == C("p_partkey"))
    li = li.join(offers(spark, sf_dir), (C("pk") == C("l_partkey")) & (C("sk") == C("l_suppkey"))).join(sellers(spark, sf_dir), C("l_suppkey") == C("s_suppkey"))
    li = li.join(table(spark, sf_dir, "orders"), C("l_orderkey") == C("o_orderkey"))
    return li.groupBy("n_name", F.year("o_orderdate").cast("long").alias("y")).agg(F.sum(F.floor(C("l_extendedprice") * 100).cast("long") - C("cost")).alias("profit"))


@query("l7_tpch11", f"WITH {PS_SQL}, v AS (SELECT pk, CAST(sum(cost * avail) AS BIGINT) AS worth FROM ps JOIN supplier ON s_suppkey = sk WHERE s_nationkey < 5 GROUP BY 1) SELECT pk, worth FROM v WHERE worth * 1000 > (SELECT sum(worth) FROM v)")
def h11(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = offers(spark, sf_dir).join(table(spark, sf_dir, "supplier").where("s_nationkey < 5"), C("sk") == C("s_suppkey")).groupBy("pk").agg(F.sum(C("cost") * C("avail")).alias("worth"))
    # one row
    return v.join(F.broadcast(v.agg(F.sum("worth").alias("whole")))).where(C("worth") * 1000 > C("whole")).select("pk", "worth")


@query("l7_tpch20", f"WITH {PS_SQL}, u AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS used FROM lineitem WHERE year(l_shipdate) % 2 = 0 GROUP BY ALL) SELECT s_name FROM supplier WHERE s_nationkey % 2 = 0 AND s_suppkey IN (SELECT sk FROM ps JOIN u ON l_partkey = pk AND l_suppkey = sk JOIN part ON p_partkey = pk WHERE p_size < 10 AND avail > 1.5 * used)")
def h20(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("year(l_shipdate) % 2 = 0").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("used"))
    some = offers(spark, sf_dir).join(used, (C("pk") == C("l_partkey")) & (C("sk") == C("l_suppkey"))).where(C("avail") > 1.5 * C("used"))
    some = some.join(table(spark, sf_dir, "part").where("p_size < 10"), C("pk") == C("p_partkey"), "left_semi")
    return table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").join(some, C("s_suppkey") == C("sk"), "left_semi").select("s_name")


@query("l7_tpch21", "WITH l AS (SELECT l_orderkey, l_suppkey, bool_or(l_shipdate > o_orderdate + INTERVAL 60 DAY) AS late FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL) SELECT s_name, count(*) AS waits FROM l JOIN supplier ON s_suppkey = l_suppkey WHERE late AND EXISTS (SELECT 1 FROM l o WHERE o.l_orderkey = l.l_orderkey AND o.l_suppkey <> l.l_suppkey) AND NOT EXISTS (SELECT 1 FROM l o WHERE o.l_orderkey = l.l_orderkey AND o.l_suppkey <> l.l_suppkey AND o.late) GROUP BY 1")
def h21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counts an order tell whether others took part, and whether others were late."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), C("l_orderkey") == C("o_orderkey"))
    one = li.groupBy("l_orderkey", "l_suppkey").agg(F.bool_or(C("l_shipdate") > C("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("late"))
    orders_ = one.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("sellers"), F.count(F.when(C("late"), 1)).alias("delayed"), F.min(F.when(C("late"), C("l_suppkey"))).alias("s"))
    alone = orders_.where("sellers > 1 AND delayed = 1").join(table(spark, sf_dir, "supplier"), C("s") == C("s_suppkey"))
    return alone.groupBy("s_name").agg(F.count(F.lit(1)).alias("waits"))
