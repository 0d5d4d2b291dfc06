"""The engine from SQL text to the changed state."""

import json
import random

import pytest

from retrolens import __main__ as cli
from retrolens import engine
from retrolens.operators import diff
from retrolens.plans.sources import TANKS, TANKS_SCRIPT
from retrolens.sources import config, sql



def log_of(spark, statements):
    return spark.createDataFrame([(g, 0, s) for g, s in enumerate(statements)], "gid long, q int, statement string")


def made(spark, keys, **more):
    text = json.dumps({"stateLog": {"name": "l"}, "keyColumns": keys, "database": {"name": "d"}})
    return engine.WhatIf(spark, config.loads(text, {}), **more)


def test_transitive_change(spark):
    w = made(spark, ["t.id"])
    log = log_of(spark, [
        "INSERT INTO t (id, v) VALUES (1, 10)", "INSERT INTO t (id, v) VALUES (2, 20)", "INSERT INTO t (id, v) VALUES (3, 30)",
        "UPDATE t SET v = v + 5 WHERE id = 1", "UPDATE t SET v = v * 2 WHERE id IN (1, 2)", "DELETE FROM t WHERE id = 3", "UPDATE t SET v = v - 1 WHERE id = 2",
    ])
    access = w.analyse(log)
    plan = w.plan(access, [3])
    assert sorted(r.gid for r in plan.gids().collect()) == [4, 6]
    out = w.what_if(log, access, plan)
    state, changes = out.state, out.changes
    assert sorted(json.loads(r.row)["v"] for r in state.collect()) == [20, 39]
    assert sorted((r.surplus, json.loads(r.row)["v"]) for r in changes.collect()) == [(-1, 20), (1, 30)]
    assert w.report(plan).first().asDict() == {"total": 7, "replayed": 2, "percent": 28.5714, "first_gid": 4}


def test_scans_and_additions(spark):
    w = made(spark, ["t.id"])
    log = log_of(spark, ["INSERT INTO t (id, v) VALUES (1, 1)", "INSERT INTO t (id, v) VALUES (2, 2)", "UPDATE t SET v = v * 10", "UPDATE t SET v = v + 1 WHERE id = 2"])
    access = w.analyse(log)
    assert sorted(r.gid for r in w.plan(access, [0]).gids().collect()) == [2, 3]
    plan = w.plan(access, [], {2: ["UPDATE t SET v = 7 WHERE id = 1"]})
    assert sorted(r.gid for r in plan.gids().collect()) == [2, 3]
    state = w.what_if(log, access, plan).state
    assert sorted((json.loads(r.row)["id"], json.loads(r.row)["v"]) for r in state.collect()) == [(1, 70), (2, 21)]


@pytest.mark.parametrize("seed", range(1))
def test_selective_equals_full(spark, seed):
    rng = random.Random(seed)
    made_ = []
    for _ in range(60):
        k = rng.randrange(8)
        made_.append(rng.choice([f"INSERT INTO t (id, v) VALUES ({k}, {rng.randrange(9)})", f"UPDATE t SET v = v * 2 + 1 WHERE id = {k}", f"UPDATE t SET v = v - 1 WHERE id IN ({k}, {(k + 1) % 8})" if rng.random() < 0.2 else f"DELETE FROM t WHERE id = {k} AND v > 50"]))
    w, log = made(spark, ["t.id"]), log_of(spark, made_)
    access = w.analyse(log)
    plan = w.plan(access, rng.sample(range(60), 3), {30: ["INSERT INTO t (id, v) VALUES (3, 5)"]})
    state = w.what_if(log, access, plan).state
    assert same(state, one_by_one(w, w.changed_log(log, plan)))


def one_by_one(w, log):
    """The tables after a run of the whole log in one component."""
    one = w.spark.createDataFrame([(f"t:{r.gid}", "all") for r in log.select("gid").distinct().collect()], "node string, component string")
    return w.state(log, one).select("name", "row")


def same(left, right):
    return diff.bag_diff(left, right, ["name", "row"]).count() == 0


def test_tables_without_keys(spark):
    w = made(spark, ["users.id"])
    log = log_of(spark, ["INSERT INTO audit (msg) VALUES ('a')", "UPDATE audit SET msg = 'b'", "DELETE FROM audit", "INSERT INTO users (id, n) VALUES (1, 1)", "UPDATE users SET n = 2 WHERE n = 1"])
    access = w.analyse(log)
    assert same(w.state(log, w.components(access)).select("name", "row"), one_by_one(w, log))
    plan = w.plan(access, [2])
    out = w.what_if(log, access, plan)
    assert sorted(r.row for r in out.state.where("name = 'audit'").collect()) == ['{"msg": "b"}']
    assert [(r.name, r.surplus) for r in out.changes.collect()] == [("audit", -1)]
    assert sorted(r.gid for r in w.what_if(log, access, w.plan(access, [3])).ran.collect()) == [4]


@pytest.mark.parametrize("seed", [1, 2])
def test_selective_replay_of_many_tables_equals_a_sequential_run(spark, seed):
    """Keyed, keyless and auto-numbered tables, rows that stand on two keys, calls,
    additions, a snapshot at a random gid: always the tables of a plain run."""
    rng = random.Random(100 + seed)
    statements = []
    for _ in range(70):
        k, j, v = rng.randrange(9), rng.randrange(4), rng.randrange(50)
        statements.append(rng.choice([
            f"INSERT INTO t (id, owner, v) VALUES ({k}, {j}, {v})", f"UPDATE t SET v = v + {v} WHERE id = {k}", f"UPDATE t SET v = v * 2 WHERE owner = {j}", f"DELETE FROM t WHERE id = {k} AND v > 60",
            f"INSERT INTO people (pid, n) VALUES ({j}, {v})", f"UPDATE people SET n = n - 1 WHERE pid = {j}", f"INSERT INTO audit (msg) VALUES ({v})" if seed % 2 else f"UPDATE people SET n = n + 1 WHERE pid = {j}",
            f"CALL pump({k}, {v})", f"CALL calibrate({k}, {v})", f"INSERT INTO notes (body) VALUES ({v})" if seed > 1 else f"CALL inspect({k})",
        ]))
    text = json.dumps({"stateLog": {"name": "l"}, "keyColumns": ["t.id", "people.pid", "tanks.tank_id"], "database": {"name": "d"}})
    links = [("t.owner", "people.pid"), ("flows.tank_id", "tanks.tank_id"), ("inspections.tank_id", "tanks.tank_id")]
    w = engine.WhatIf(spark, config.loads(text, {}), links, sql.procedures(TANKS_SCRIPT), {"notes": "nid"})
    log = log_of(spark, statements)
    access = w.analyse(log)
    targets = sorted(rng.sample(range(20, 70), 3))
    plan = w.plan(access, targets, {45: ["UPDATE t SET v = 1000 WHERE id = 3"]})
    wanted = one_by_one(w, w.changed_log(log, plan))
    at = rng.randrange(5, 20)
    snapshot = one_by_one(w, log.where(f"gid <= {at}"))
    final = one_by_one(w, log)
    assert same(w.what_if(log, access, plan).state, wanted)
    out = w.what_if(log, access, plan, snapshot, at, final)
    assert same(out.state, wanted)
    ran = {r.gid for r in out.ran.collect()}
    assert ran & set(targets) - {45} == set() and min(ran, default=99) > at


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text(TANKS)
    (tmp_path / "p.sql").write_text(TANKS_SCRIPT)
    (tmp_path / "add.sql").write_text("START TRANSACTION; UPDATE tanks SET level = level - 4 WHERE tank_id = 1; COMMIT;")
    calls = ["CALL calibrate(1, 40)", "CALL calibrate(2, 90)", "CALL pump(1, 6)", "CALL pump(2, 5)", "CALL inspect(1)", "CALL pump(1, 3)", "CALL pump(2, -8)"]
    log_of(spark, calls).write.parquet(str(tmp_path / "log"))
    base = ["-c", str(tmp_path / "c.json"), "--log", str(tmp_path / "log"), "--out", str(tmp_path / "out"), "--procedures", str(tmp_path / "p.sql"), "--auto", "flows=flow_id"]
    assert cli.main([*base, "make_cluster"]) == 0
    assert cli.main([*base, f"rollback=2:prepend=2,{tmp_path / 'add.sql'}"]) == 0
    assert cli.main([*base, "--limit", "5", "replay:full-replay:view:auto-rollback=0.3"]) == 0
    state = spark.read.parquet(str(tmp_path / "out/replay")).collect()
    level = {json.loads(r.row)["tank_id"]: json.loads(r.row)["level"] for r in state if r.name == "tanks"}
    assert level == {1: 39, 2: 95}
    assert same(spark.read.parquet(str(tmp_path / "out/replay")), spark.read.parquet(str(tmp_path / "out/full-replay")))
    assert cli.main([*base, "nonsense"]) == 2
    assert "CALL pump" in capsys.readouterr().out
    assert sql.is_setting("commit")
