"""The what-if engine against sequential versions of its rules."""

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from retrolens.functions import intervals as iv
from retrolens.operators import cluster, conflict, depend, diff, executor, procedures, replay, statehash
from retrolens.operators.access import Dml, accesses, union
from retrolens.operators.relations import Relations
from retrolens.sources import config


# ---- intervals ----


def test_leaf_ranges_and_texts():
    assert iv.leaf("=", [7]).sql("id") == "id=7"
    assert iv.leaf("!=", [7]).sql("id") == "id!=7"
    assert iv.leaf("BETWEEN", [9, 3]) == iv.leaf("BETWEEN", [3, 9])
    assert iv.leaf("IN", [1, 2, 1]).sql("id") == "id=1 OR id=2"
    assert iv.leaf("=", ["ab"]).sql("c") == "c=X'6162'"
    assert iv.leaf("LIKE", ["ab%"]).parts == (iv.Interval("ab", "ac", True, False),)
    assert iv.leaf("LIKE", ["%b"]).wildcard and iv.leaf("=", [None]).wildcard
    assert not iv.leaf("=", [1]).meets(iv.leaf("=", ["1"]))
    assert iv.leaf("=", [1]).meets(iv.leaf("=", [Decimal("1.0")]))
    assert iv.leaf("<", [5]) != iv.leaf("<=", [5])
    assert not iv.leaf("<", [5]).meets(iv.leaf(">=", [5])) and iv.leaf("<=", [5]).meets(iv.leaf(">=", [5]))
    assert (iv.leaf("<", [5]) | iv.leaf(">=", [5])).sql("x") == "1=1"
    assert (iv.leaf(">=", [1]) & iv.leaf("<=", [3])).sql("x") == "(x>=1 AND x<=3)"


def test_interval_algebra_on_points():
    rng = random.Random(1)

    def made():
        parts = []
        for _ in range(rng.randrange(4)):
            a, b = sorted([rng.choice([None, *range(8)]) or 0, rng.randrange(8)])
            parts.append(iv.Interval(None if rng.random() < 0.1 else a, None if rng.random() < 0.1 else b, rng.random() < 0.5, rng.random() < 0.5))
        return iv.Range.of(parts)

    def has(r, x):
        return r.wildcard or any(not (iv.Interval(x, x) & p).empty() for p in r.parts)

    points = [x / 2 for x in range(-4, 22)]
    for _ in range(400):
        a, b = made(), made()
        assert [has(a & b, x) for x in points] == [has(a, x) and has(b, x) for x in points]
        assert [has(a | b, x) for x in points] == [has(a, x) or has(b, x) for x in points]
        assert a.meets(b) == any(not (p & q).empty() for p in a.parts for q in b.parts)


@pytest.mark.parametrize("parts", [0, 3])
def test_islands_against_a_scan(spark, parts):
    rng = random.Random(2)
    rows = []
    for _ in range(150):
        a, b = sorted([rng.randrange(300), rng.randrange(300)])
        b = min(b, a + rng.randrange(5))
        closed = (True, True) if a == b else (rng.random() < 0.7, rng.random() < 0.7)
        rows.append((rng.choice("kq"), None if rng.random() < 0.01 else a, None if rng.random() < 0.01 else b, *closed))
    frame = spark.createDataFrame(rows, "column string, lo long, hi long, lo_closed boolean, hi_closed boolean").distinct()
    got = iv.islands_dealt(frame, ["column"], parts) if parts else iv.islands(frame, ["column"])
    by = {}
    for r in got.collect():
        by.setdefault((r.column, r.island), []).append(iv.Interval(r.lo, r.hi, r.lo_closed, r.hi_closed))
    for k in "kq":
        mine = [iv.Range.of(v) for (c, _), v in by.items() if c == k]
        assert all(len(r.parts) == 1 for r in mine)
        assert not any(a.parts[0].touches(b.parts[0]) for i, a in enumerate(mine) for b in mine[i + 1 :])


# ---- accesses ----


def test_statement_accesses():
    a = accesses(Dml("UPDATE", "T", sets={"a": ("b",)}, values={"id": 9}, where=("AND", [(">=", "id", [1]), ("<=", "id", [3])])), ("t.id",))
    assert a.reads == {"t.b", "t.id"} and a.writes == {"t.a"}
    assert a.write_items["t.id"].sql("id") == "(id>=1 AND id<=3) OR id=9"
    assert accesses(Dml("DELETE", "t"), ("t.id",)).write_items["t.id"].wildcard
    both = accesses(Dml("INSERT", "t", rows=({"id": 1}, {"id": 5})), ("t.id",))
    assert both.write_items["t.id"].sql("id") == "id=1 OR id=5"
    assert union([a, both]).write_items["t.id"].meets(iv.leaf("=", [5]))
    s = accesses(Dml("SELECT", "t", select=("a",), joins=("u",), on=("u.k", "t.k"), where=("IS NULL", "a", [])))
    assert s.reads == {"t.a", "u.k", "t.k"} and s.read_items["t.a"].wildcard


# ---- dependency ----


def test_relatedness():
    r = Relations({}, [("posts.author", "users.id")])
    related = lambda a, b: depend.related(a, b, r)
    assert related("posts.author", "users.id") and related("users.*", "users.name") and related("users.*", "posts.author")
    assert related("users.*", "posts.*") and not related("users.*", "posts.title") and not related("users.name", "users.id")


def scan_taint(log, targets, r, matched):
    taint = {}
    put = lambda cs, g: [taint.setdefault(c, g) for c in cs]
    for gid, touched, writes in sorted(log):
        if gid in targets:
            put(writes, gid)
        elif gid in matched or any(depend.related(c, t, r) for c in touched for t in list(taint)):
            put(writes, gid)
    return taint


@pytest.mark.parametrize("seed", range(6))
def test_taint_is_the_sequential_scan(spark, seed):
    rng = random.Random(seed)
    columns = ["a.x", "a.y", "a.*", "b.k", "b.z", "b.*", "c.q", "d.*"]
    r = Relations({}, [("b.k", "a.x"), ("c.q", "b.k")] if seed % 2 else [])
    log = []
    for gid in range(40):
        writes = rng.sample(columns, rng.randrange(3))
        log.append((gid, sorted({*rng.sample(columns, rng.randrange(3)), *writes}), writes))
    targets, matched = [rng.randrange(10), rng.randrange(40)], [g for g in range(40) if rng.random() < 0.05]
    matched = [g for g in matched if g not in targets]
    frame = spark.createDataFrame(log, "gid long, touched array<string>, writes array<string>")
    extra = spark.createDataFrame([(g,) for g in matched], "gid long")
    assert depend.earliest_taint(frame, targets, r, extra) == scan_taint(log, targets, r, matched)


def test_plan_of_three_transactions(spark):
    items = spark.createDataFrame([(1, "W", "items.id", 1), (2, "R", "items.id", 1), (3, "R", "items.id", 2)], "gid long, rw string, column string, value long")
    assert [r.gid for r in depend.row_matched(items, [1], ["column", "value"]).collect()] == [2]
    groups = [(0, ["items.id"], False)]
    assert [r.gid for r in depend.composite_matched(items, [1], groups).collect()] == [2]


def test_spread_places(spark):
    for total, ratio in [(5, 0.5), (0, 0.5), (3, 0.0), (3, 7.0), (100, 0.001), (97, 0.13), (1000, 0.333), (11, 0.99)]:
        got = sorted(r.place for r in depend.spread_places(spark.range(total).withColumnRenamed("id", "place"), total, ratio).collect())
        m = min(total, max(1, int(total * min(1.0, ratio) + 0.5))) if total and ratio else 0
        assert got == sorted({(2 * k + 1) * total // (2 * m) for k in range(m)})


# ---- conflicts ----


def plain_edges(accesses_):
    """All pairs that the next write of a key doesn't already order."""
    out, keys = set(), {}
    for g, rw, k in accesses_:
        keys.setdefault(k, {}).setdefault(g, set()).add(rw)
    for by_gid in keys.values():
        order = sorted(by_gid)
        for i, a in enumerate(order):
            for j in range(i + 1, len(order)):
                if "W" in by_gid[a] or "W" in by_gid[order[j]]:
                    if "W" in by_gid[a] or not any("W" in by_gid[x] for x in order[i + 1 : j]):
                        if not any("W" in by_gid[x] for x in order[i + 1 : j]):
                            out.add((a, order[j]))
    return out


def test_conflict_edges_and_levels(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.choice("RW"), rng.randrange(5)) for _ in range(140)]
    frame = spark.createDataFrame(rows, "gid long, rw string, key long")
    edges = {(r.src, r.dst) for r in conflict.edges(frame, ["key"]).collect()}
    assert edges == plain_edges(rows)
    level = {}
    for g in sorted({r[0] for r in rows}):
        level[g] = max((level[a] + 1 for a, b in edges if b == g), default=0)
    got = conflict.levels(frame.select("gid").distinct(), conflict.edges(frame, ["key"]))
    assert {r.gid: r.level for r in got.collect()} == level


def test_overlap_edges(spark):
    rng = random.Random(4)
    rows = []
    for g in range(80):
        a = rng.randrange(200)
        b = a + rng.randrange(30)
        closed = (True, True) if a == b else (rng.random() < 0.6, rng.random() < 0.6)
        rows.append((g, rng.choice("RW"), rng.choice("kq"), None if rng.random() < 0.05 else a, None if rng.random() < 0.05 else b, *closed))
    frame = spark.createDataFrame(rows, "gid long, rw string, column string, lo long, hi long, lo_closed boolean, hi_closed boolean")
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[2] == y[2] and "W" in (x[1], y[1]) and iv.Interval(*x[3:]).meets(iv.Interval(*y[3:]))}
    got = conflict.overlap_edges(frame, 16)
    assert Counter((r.src, r.dst) for r in got.collect()) == Counter(want)


def test_components_and_choice(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = cluster.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == root


# ---- replay ----


def step(state, r):
    if r.op == "set":
        state["v"] = r.value
    elif state.get("v") is not None:
        state["v"] = state["v"] * 2 + r.value if r.op == "double" else state["v"] - r.value


@pytest.mark.parametrize("seed", range(3))
def test_selective_replay_equals_full_replay(spark, seed):
    """Replaying only what shares a key with the targets gives, on every row,
    what replaying all but the targets gives."""
    rng = random.Random(seed)
    rows = [(g, rng.randrange(12), rng.choice(["set", "double", "take"]), rng.randrange(50)) for g in range(200)]
    log = spark.createDataFrame(rows, "gid long, key long, op string, value long")
    targets = rng.sample(range(200), 3)
    fold = lambda frame: replay.fold_clusters(frame, "key", dict, step, lambda s: [(s["cluster"], s.get("v"))], "key long, v long")
    full, original = fold(replay.kept(log, targets)), fold(log)
    touched = log.where(F.col("gid").isin(targets)).select("key").distinct()
    part = fold(replay.kept(log, targets).join(touched, "key", "left_semi"))
    selective = replay.reflect(original, part, touched, ["key"])
    assert diff.set_diff(selective, full, ["key", "v"]).count() == 0
    assert diff.bag_diff(selective, full, ["key", "v"]).count() == 0


LIT, VAR, COL = (lambda v: ("lit", v)), (lambda n: ("var", n)), (lambda n: ("col", n))
P = procedures.Procedure
TALLY = P(
    "tally",
    [("IN", "board"), ("IN", "points"), ("OUT", "entry")],
    [
        ("into", Dml("SELECT", "boards", select=("best", "rounds"), where=("=", "board", [VAR("board")])), ["best", "rounds"]),
        ("if", [((">", VAR("points"), VAR("best")), [("sql", Dml("UPDATE", "boards", sets={"best": ()}, values={"best": VAR("points")}, where=("=", "board", [VAR("board")])))])], []),
        ("sql", Dml("INSERT", "entries", rows=({"board": VAR("board"), "round": ("+", VAR("rounds"), LIT(1)), "points": VAR("points")},))),
        ("set", "entry", VAR("last_insert_id")),
        ("sql", Dml("UPDATE", "boards", sets={"rounds": ("rounds",)}, values={"rounds": ("+", COL("rounds"), LIT(1))}, where=("=", "board", [VAR("board")]))),
    ],
)
OPEN = P("open_board", [("IN", "board")], [("sql", Dml("INSERT", "boards", rows=({"board": VAR("board"), "best": LIT(0), "rounds": LIT(0)},)))])


def boards(calls):
    t = executor.replay_calls([(n, a, None) for n, a in calls], {"tally": TALLY, "open_board": OPEN}, executor.Tables({"entries": "id"}))
    return {r["board"]: (r["best"], r["rounds"]) for r in t.rows["boards"]}, [(r["id"], r["board"], r["round"]) for r in t.rows.get("entries", [])]


def test_calls_against_a_plain_run():
    rng = random.Random(21)
    calls, best, rounds, entries = [("open_board", [b]) for b in range(4)], Counter(), Counter(), []
    for _ in range(60):
        b, points = rng.randrange(4), rng.randrange(100)
        calls.append(("tally", [b, points, None]))
        best[b], rounds[b] = max(best[b], points), rounds[b] + 1
        entries.append((len(entries) + 1, b, rounds[b]))
    assert boards(calls) == ({b: (best[b], rounds[b]) for b in range(4)}, entries)


def test_calls_of_a_board_depend_on_each_other(spark):
    calls = [("open_board", [1]), ("open_board", [2]), ("tally", [1, 5, None]), ("tally", [2, 6, None]), ("tally", [1, 7, None])]
    rows = []
    for gid, (name, args) in enumerate(calls):
        a = {"tally": TALLY, "open_board": OPEN}[name].trace(args, ("boards.board",))
        rows += [(gid, rw, c, p.lo) for rw, items in (("R", a.read_items), ("W", a.write_items)) for c, r in items.items() for p in r.parts]
    items = spark.createDataFrame(rows, "gid long, rw string, column string, value long")
    assert [r.gid for r in depend.row_matched(items, [2], ["column", "value"]).collect()] == [4]


def test_replace_statements():
    groups = [(["t.a", "t.b"], True), (["u.id"], False)]
    targets = [{"t.a": iv.leaf("=", [1]), "t.b": iv.leaf("=", ["x"]), "u.id": iv.ANY}]
    made = replay.replace_statements(targets, groups, "db", "tmp")
    assert made[0] == "DELETE FROM db.t WHERE (a=1) AND (b=X'78')" and made[2:] == ["TRUNCATE db.u", "REPLACE INTO db.u SELECT * FROM tmp.u"]


# ---- digests ----


def test_digest_is_commutative_and_inverts(spark):
    rows = [(i, None if i % 3 == 0 else f"v{i}") for i in range(20)]
    frame = spark.createDataFrame(rows, "id long, v string")
    of = lambda d, s=None: tuple(statehash.table_digest(d, ["id", "v"], s).first())[1:]
    assert of(frame) == of(frame.orderBy(F.desc("id")).repartition(7))
    there = frame.withColumn("s", F.lit(1))
    back = there.unionByName(frame.where("id < 5").withColumn("s", F.lit(-1)))
    assert of(back, F.col("s")) == of(frame.where("id >= 5"))
    assert of(frame) != of(frame.withColumn("v", F.coalesce("v", F.lit(""))))


# ---- procedures, configuration ----


def test_procedure_loops_and_traces():
    p = P("p", [("INOUT", "n"), ("OUT", "s")], [("set", "s", LIT(0)), ("while", (">", VAR("n"), LIT(0)), [("set", "s", ("+", VAR("s"), VAR("n"))), ("set", "n", ("-", VAR("n"), LIT(1))), ("if", [(("=", VAR("n"), LIT(1)), [("leave",)])], [])])])
    assert p.run([4, None], lambda d, s: []) == {"n": 1, "s": 9}
    t = P("t", [("IN", "k")], [("if", [(("=", VAR("k"), LIT(1)), [("set", "x", LIT(5))])], [("set", "x", LIT(6))]), ("sql", Dml("DELETE", "a", where=("=", "id", [VAR("x")])))])
    assert t.trace([1], ("a.id",)).write_items["a.id"].wildcard
    assert procedures.value_of(("/", LIT(1), LIT(0)), {}) is None and procedures.value_of(("div", LIT(-7), LIT(2)), {}) == -3
    log = procedures.CallLog([{"call_id": i} for i in (3, 5, 3)])
    assert log.match_forward(5) == {"call_id": 5} and log.match_forward(3) == {"call_id": 3} and log.match_forward(3) is None


def test_statement_splitter():
    assert procedures.split_statements("a; -- x;\n'b;''c' ; # d\n/* ; */ e") == ["a", "'b;''c'", "e"]
    assert procedures.split_statements("DELIMITER $$\nx; y$$\nDELIMITER ;\nz;") == ["x; y", "z"]


def test_config():
    good = '{"stateLog": {"name": "l"}, "keyColumns": ["a.b"], "database": {"name": "d"}}'
    assert config.loads(good, {"DB_USER": "u"}).user == "u"
    for bad in ("", "[]", "{", good.replace('"a.b"', ""), good.replace('"name": "l"', ""), good.replace('"d"', '""')):
        assert config.loads(bad, {}) is None
    assert config.load("/no/such/file") is None


# ---- running aggregates ----


@pytest.mark.parametrize("parts", [0, 5])
def test_running_aggregates_with_a_hot_key(spark, parts):
    from retrolens.operators.running import before

    rng = random.Random(11)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([None, 1, 2, 5])) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, gid long, v long").repartition(3)
    got = before(frame, ["k"], ["gid"], {"n": ("count", F.col("v")), "s": ("sum", F.col("v")), "l": ("last", F.col("v"))}, parts).collect()
    held = {}
    want = {}
    for k, i, v in rows:
        seen = held.setdefault(k, [])
        want[i] = (len(seen), sum(seen) if seen else None, seen[-1] if seen else None)
        if v is not None:
            seen.append(v)
    assert {r.gid: (r.n, r.s, r.l) for r in got} == want


# ---- closures and wildcards ----


def test_row_closure_is_the_recursive_rule(spark):
    rng = random.Random(12)
    rows = [(g, rng.choice("RW"), rng.randrange(30)) for g in range(60) for _ in range(rng.randrange(1, 3))]
    for targets in ([3], [0, 40], [99]):
        tainted, dependent = set(), set()
        for g in range(60):
            mine = [(rw, k) for x, rw, k in rows if x == g]
            if g in targets or any(k in tainted for _, k in mine):
                if g not in targets:
                    dependent.add(g)
                tainted |= {k for rw, k in mine if rw == "W"}
        got = depend.row_closure(spark.createDataFrame(rows, "gid long, rw string, key long"), targets, ["key"])
        # a target that depends on an earlier one stays a target
        assert {r.gid for r in got.collect()} == dependent


def reachable(edges, nodes):
    out = {n: set() for n in nodes}
    for n in sorted(nodes, reverse=True):
        for a, b in edges:
            if a == n:
                out[n] |= {b} | out[b]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_wildcards_are_barriers(spark, seed):
    rng = random.Random(seed)
    rows = [(g, rng.choice("RW"), None if rng.random() < 0.12 else rng.randrange(4)) for g in range(50) for _ in range(rng.randrange(1, 3))]
    clash = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (None in (a[2], b[2]) or (a[2] == b[2] and "W" in (a[1], b[1])))}
    got = conflict.edges_with_wildcards(spark.createDataFrame(rows, "gid long, rw string, key long"), ["key"], 3)
    edges = {(r.src, r.dst) for r in got.collect()}
    nodes = {r[0] for r in rows}
    assert edges <= clash and reachable(edges, nodes) == reachable(clash, nodes)
