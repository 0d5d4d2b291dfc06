"""The engine over a log of SQL statements: analyse, plan, replay, compare.

A log is a table (gid, q, statement): statements of one transaction share a gid
and go by q; ``CALL name(literals)`` runs a known procedure. Nothing is executed
to analyse it: each statement is parsed once, in parallel, and gives column and
key accesses.

Keys in a plan are points. A statement that fixes no point of a key column (an
interval, a scan) meets every access of that column, which is sound; exact
interval matching is in ``operators.conflict`` and ``operators.cluster``. A
statement that touches a table by none of its key columns meets every access of
that table: the table as a whole (``t.*``) then counts as a key that is scanned.

A replay is selective: it starts from a stored state (a snapshot after some gid
before the change) and runs only transactions of the components that the change
touches in the log since then. Rows of other components are those of the
original final state, which a live database has anyway.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrolens.functions.intervals import Range
from retrolens.lineage import cut, scratch
from retrolens.operators import cluster, depend, diff, executor
from retrolens.operators.access import Access, accesses, union
from retrolens.operators.procedures import Procedure
from retrolens.sources import sql, statelog
from retrolens.sources.config import Config

ACCESS = "gid long, rw string, what string, column string, point string"
STATE = "component string, name string, row string"
#: (name, row): rows of tables, as JSON with sorted keys.
TABLES = "name string, row string"


@dataclass(frozen=True)
class Plan:
    """gids to replay, with the counters of a report."""

    targets: list[int] | DataFrame
    added: dict[int, list[str]]
    decision: DataFrame

    def gids(self) -> DataFrame:
        return self.decision.where("replay").select("gid")

    def save(self, place: str) -> None:
        """The plan as tables in a folder."""
        spark = self.decision.sparkSession
        self.gids().write.mode("overwrite").parquet(f"{place}/replay")
        kinds = "gid long, kind string, q int, statement string"
        gone = spark.createDataFrame([(g,) for g in self.targets], "gid long") if isinstance(self.targets, list) else self.targets
        made = spark.createDataFrame([(g, "prepend", i, s) for g, ss in self.added.items() for i, s in enumerate(ss)], kinds)
        made = made.unionByName(gone.select("gid", F.lit("rollback").alias("kind")), allowMissingColumns=True)
        made.write.mode("overwrite").parquet(f"{place}/changes")


def load_plan(spark: SparkSession, place: str) -> Plan:
    changes = spark.read.parquet(f"{place}/changes").orderBy("gid", "q").collect()  # as many as the user asked for
    added: dict[int, list[str]] = {}
    for r in changes:
        if r.kind == "prepend":
            added.setdefault(r.gid, []).append(r.statement)
    return Plan([r.gid for r in changes if r.kind == "rollback"], added, spark.read.parquet(f"{place}/replay").withColumn("replay", F.lit(True)))


def _call(text: str) -> tuple[str, list[Any]] | None:
    """Name and literal arguments of a CALL statement."""
    m = re.fullmatch(r"(?is)\s*CALL\s+([\w.`]+)\s*\((.*)\)\s*;?\s*", text)
    if not m:
        return None
    p = sql.Parser(f"SELECT {m[2]}" if m[2].strip() else "SELECT 1")
    p.expect("SELECT")
    args = []
    while m[2].strip():
        e = p.expression()
        args.append(e[1] if e[0] == "lit" else None)
        if not p.accept(","):
            break
    return m[1].replace("`", "").split(".")[-1].lower(), args


class WhatIf:
    def __init__(self, spark: SparkSession, config: Config, foreign_keys: list[tuple[str, str]] = (), procedures: dict[str, Procedure] | None = None, auto: dict[str, str] | None = None):  # type: ignore[assignment]
        self.spark, self.config = spark, config
        self.relations = config.relations(list(foreign_keys))
        self.keys = tuple(dict.fromkeys(c for g in config.groups() for c in g))
        self.wanted = {self.relations.chain(k) for k in self.keys}
        # a table without a key of its own goes by columns that refer to one
        own = {k.split(".")[0].lower() for k in self.keys}
        refer = sorted({*self.relations.aliases, *self.relations.foreign_keys})
        self.traced = (*self.keys, *(c for c in refer if self.relations.chain(c) in self.wanted and c.split(".")[0] not in own))
        self.procedures, self.auto = procedures or {}, auto or {}

    # ---- analysis ----

    def access_of(self, statement: str) -> Access:
        """What one statement, or a call, reads and writes."""
        if (call := _call(statement)) is not None:
            return self.procedures[call[0]].trace(call[1], self.traced)
        return union([accesses(sql.parse(statement)), accesses(sql.parse(statement), self.traced)])

    def _rows(self, gid: int, a: Access) -> Iterator[tuple]:
        for rw, columns in (("R", a.reads), ("W", a.writes)):
            for c in columns:
                yield gid, rw, "column", c, None
        wanted = self.wanted
        by_key = {c.split(".")[0] for items in (a.read_items, a.write_items) for c in items if self.relations.chain(c) in wanted}
        for rw, columns in (("R", a.reads), ("W", a.writes)):
            for t in {c.split(".")[0] for c in columns} - by_key:
                yield gid, rw, "item", f"{t}.*", None
        for rw, items in (("R", a.read_items), ("W", a.write_items)):
            for c, r in items.items():
                if (name := self.relations.chain(c)) in wanted:
                    for p in _points(r):
                        yield gid, rw, "item", name, p

    def analyse(self, log: DataFrame) -> DataFrame:
        """(gid, rw, what, column, point): columns accessed, and items of key
        columns; a null point is any value of the key."""
        engine = self._portable()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = [x.split()[0] for x in ACCESS.split(", ")]
            for f in frames:
                out = [row for gid, text in zip(f["gid"], f["statement"], strict=True) for row in engine._rows(int(gid), engine.access_of(text))]
                yield pd.DataFrame(out, columns=names).astype({"gid": "int64"})

        found = cut(log.select("gid", "statement").mapInPandas(run, ACCESS).distinct())
        return self._with_whole_tables(found)

    def _with_whole_tables(self, access: DataFrame) -> DataFrame:
        """Where some transaction touches a table by no key, each access of it
        meets the table as a whole."""
        whole = [r.column[:-2] for r in access.where("what = 'item' AND column LIKE '%.*'").select("column").distinct().collect()]  # tables
        table = F.substring_index("column", ".", 1)
        more = access.where(F.col("what") == "column").where(table.isin(whole)).select("gid", "rw", F.lit("item").alias("what"), F.concat(table, F.lit(".*")).alias("column"), F.lit(None).cast("string").alias("point"))
        return access.union(more).distinct() if whole else access

    def _portable(self) -> WhatIf:
        """This engine without the session, for workers."""
        out = object.__new__(WhatIf)
        out.__dict__ = {**self.__dict__, "spark": None}
        return out

    # ---- planning ----

    def plan(self, access: DataFrame, targets: list[int] | DataFrame, added: dict[int, list[str]] | None = None, strict_row_gate: bool = False) -> Plan:
        """What must run again if the targets (gids, or a table of them) are
        removed and the added statements run before the gids that they are
        given for."""
        added = added or {}
        access = cut(access)
        log = cut(depend.by_transaction(access.where("what = 'column'").select("gid", "rw", "column")))
        extra = self._extra(access, added)
        taints: dict[str, int] = {}
        for g, rw, what, c, _ in extra:
            if what == "column" and rw == "W":
                taints[c] = min(g, taints.get(c, g))
        items = access.where("what = 'item'").select("gid", "rw", "column", "point")
        # an added statement runs just before its gid: it counts as the gid before it, on a scale of halves
        halves = items.withColumn("gid", F.col("gid") * 2)
        if mine := [(g * 2 - 1, rw, c, p) for g, rw, what, c, p in extra if what == "item"]:
            halves = halves.unionByName(self.spark.createDataFrame(mine, "gid long, rw string, column string, point string"))
        seeds = self._gids(targets).select((F.col("gid") * 2).alias("gid")).union(self._gids([g * 2 - 1 for g in added]))
        matched = depend.row_closure(_pseudo_keys(halves), seeds, ["column", "point"]).where("gid % 2 = 0").select((F.col("gid") / 2).cast("long").alias("gid"))
        matched = cut(depend.without(matched, targets))
        taint = depend.earliest_taint(log, targets, self.relations, matched, {c: g - 1 for c, g in taints.items()})
        return Plan(sorted(targets) if isinstance(targets, list) else targets, added, cut(depend.decide(log, items, matched, taint, self.relations, targets, strict_row_gate)))

    def _gids(self, gids: list[int] | DataFrame) -> DataFrame:
        return self.spark.createDataFrame([(g,) for g in gids], "gid long") if isinstance(gids, list) else gids.select("gid")

    def _extra(self, access: DataFrame, added: dict[int, list[str]]) -> list[tuple]:
        """Accesses of the added statements, with the tables that go as a whole."""
        rows = [row for g, texts in added.items() for t in texts for row in self._rows(g, self.access_of(t))]
        if not rows:
            return []
        whole = {r.column for r in access.where("what = 'item' AND column LIKE '%.*'").select("column").distinct().collect()}  # tables
        more = {(g, rw, "item", f"{c.split('.')[0]}.*", None) for g, rw, what, c, _ in rows if what == "column"}
        return sorted({*rows, *(x for x in more if x[3] in whole)}, key=str)

    def auto_plan(self, access: DataFrame, ratio: float) -> Plan:
        """A plan for a share of all transactions, evenly spread; for reports."""
        gids = cut(access.select(F.col("gid").alias("event"), F.floor(F.col("gid") / 1_000_000).alias("_block")).distinct())
        ranked = statelog.numbered(gids, "_block", ["event"])  # its gid is the place
        return self.plan(access, cut(depend.spread_places(ranked, gids.count(), ratio, "gid").select(F.col("event").alias("gid"))))

    @staticmethod
    def report(plan: Plan) -> DataFrame:
        """One row: total, replayed, percent, first gid."""
        n = F.count(F.when(F.col("replay"), 1))
        total = F.count(F.lit(1)) + (len(plan.targets) if isinstance(plan.targets, list) else plan.targets.count())
        return plan.decision.agg(total.alias("total"), n.alias("replayed"), F.round(F.try_divide(100.0 * n, total), 4).alias("percent"), F.min(F.when(F.col("replay"), F.col("gid"))).alias("first_gid"))

    # ---- replay ----

    def _row_nodes(self, rows: DataFrame, scanned: list[str]) -> DataFrame:
        """``rows`` (name, row, ...) with the keys that each stands on."""
        fields = rows.select("name", F.explode(F.map_keys(F.from_json("row", "map<string,string>"))).alias("c")).distinct().collect()  # the schema
        names = {c: self.relations.chain(c) for r in fields if (c := f"{r.name}.{r.c}") in {k.lower() for k in self.traced}}
        known = F.create_map(*[F.lit(x) for c, n in sorted(names.items()) for x in (c, n)]) if names else F.create_map().cast("map<string,string>")
        entry = F.transform(F.map_entries(F.from_json("row", "map<string,string>")), lambda e: F.struct(F.try_element_at(known, F.concat("name", F.lit("."), e["key"])).alias("key"), e["value"].alias("value")))
        nodes = F.transform(F.filter(entry, lambda e: e["key"].isNotNull() & e["value"].isNotNull()), lambda e: _node(e["key"], e["value"], scanned))
        whole = F.concat("name", F.lit(".*"))
        return rows.withColumn("nodes", F.when(whole.isin(scanned), F.array_append(nodes, F.concat(F.lit("k:"), whole))).otherwise(nodes))

    @staticmethod
    def _scanned(access: DataFrame) -> list[str]:
        return [r.column for r in access.where("what = 'item' AND point IS NULL").select("column").distinct().collect()]  # key columns and tables

    def components(self, access: DataFrame, start: DataFrame | None = None) -> DataFrame:
        """(node, component) of transactions (``t:gid``) and keys (``k:...``): what
        shares no key, however indirectly, is apart and can be replayed apart. A
        key column that some statement scans ties all its transactions together,
        and a row of ``start`` (name, row) the keys that it stands on."""
        items, scanned = access.where("what = 'item'"), self._scanned(access)
        edges = items.select(F.concat(F.lit("t:"), F.col("gid").cast("string")).alias("b"), _node(F.col("column"), F.col("point"), scanned).alias("a")).distinct()
        if start is not None:
            held = self._row_nodes(start, scanned).where(F.size("nodes") > 1).select(F.get("nodes", F.lit(0)).alias("b"), F.explode("nodes").alias("a"))
            edges = edges.unionByName(held.where("a <> b").distinct())
        return cluster.components(edges.select("a", "b")).select("node", F.col("root").alias("component"))

    def state(self, log: DataFrame, parts: DataFrame, start: DataFrame | None = None) -> DataFrame:
        """(component, name, row): the tables after running the statements of
        each component in order, from the rows of ``start`` (component, name,
        row) on; rows as JSON with sorted keys. A transaction that touches no
        table runs alone."""
        engine = self._portable()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, tables = None, executor.Tables(engine.auto)

            def rows() -> pd.DataFrame:
                out = [(at, t, json.dumps(r, sort_keys=True, default=str)) for t, rs in tables.rows.items() for r in rs]
                return pd.DataFrame(out, columns=["component", "name", "row"])

            for f in frames:
                for r in f.itertuples(index=False):
                    if r.component != at:
                        if at is not None:
                            yield rows()
                        at, tables = r.component, executor.Tables(engine.auto)
                    if pd.notna(r.row):
                        tables.load(r.name, json.loads(r.row))
                        continue
                    if pd.notna(r.insert_id):
                        for t in engine.auto:
                            tables.next_id[t] = int(r.insert_id) - 1
                    if (call := _call(r.statement)) is not None:
                        engine.procedures[call[0]].run(call[1], tables.execute)
                    else:
                        tables.execute(sql.parse(r.statement), {})
            if at is not None:
                yield rows()

        if "sub" not in log.columns:
            log = log.withColumn("sub", F.lit(1))
        if "insert_id" not in log.columns:
            log = log.withColumn("insert_id", F.lit(None).cast("long"))
        of = parts.where("node LIKE 't:%'").select(F.substring("node", 3, 20).cast("long").alias("gid"), "component")
        dealt = log.join(of, "gid", "left").withColumn("component", F.coalesce("component", F.concat(F.lit("t:"), F.col("gid").cast("string"))))
        dealt = dealt.select("component", "gid", "sub", "q", "statement", F.col("insert_id").cast("long").alias("insert_id"))
        none = self.spark.createDataFrame([], STATE) if start is None else start.select("component", "name", "row")
        dealt = dealt.unionByName(none, allowMissingColumns=True).repartition("component").sortWithinPartitions("component", "gid", "sub", "q", "row")  # rows of the start have no gid and come first
        return dealt.select("component", "statement", "insert_id", "name", "row").mapInPandas(run, STATE)

    def changed_log(self, log: DataFrame, plan: Plan) -> DataFrame:
        """The log as the change would have it."""
        base = depend.without(log, plan.targets).withColumn("sub", F.lit(1))
        made = [(g, i, s, 0) for g, texts in plan.added.items() for i, s in enumerate(texts)]
        return base.unionByName(self.spark.createDataFrame(made, "gid long, q int, statement string, sub int"), allowMissingColumns=True) if made else base

    def placed(self, tables: DataFrame, parts: DataFrame, scanned: list[str]) -> DataFrame:
        """``tables`` (name, row) with the component of each row; null where the
        log since the snapshot meets none of its keys."""
        numbered = cut(self._row_nodes(tables, scanned).withColumn("_row", F.monotonically_increasing_id()))
        keys = numbered.select("_row", F.explode("nodes").alias("node")).join(parts, "node").groupBy("_row").agg(F.min("component").alias("component"))
        return numbered.join(keys, "_row", "left").select("component", "name", "row")

    def _begin(self, access: DataFrame, snapshot: DataFrame | None) -> tuple[list[str], DataFrame, DataFrame]:
        """Keys that go as a whole, components, and the snapshot's rows with theirs."""
        scanned = self._scanned(access)
        if snapshot is None:
            return scanned, cut(self.components(access)), self.spark.createDataFrame([], STATE)
        start = snapshot.select("name", "row")
        parts = cut(self.components(access, start))
        return scanned, parts, self.placed(start, parts, scanned)

    def _run(self, log: DataFrame, parts: DataFrame, begun: DataFrame) -> DataFrame:
        # a row that no key ties to the log stays as it is
        lone = begun.where("component IS NULL").select("name", "row")
        return self.state(log, parts, begun.where("component IS NOT NULL")).select("name", "row").unionByName(lone)

    def resume(self, log: DataFrame, access: DataFrame, snapshot: DataFrame, at: int) -> DataFrame:
        """(name, row): the tables after the log, from those after gid ``at``."""
        log, access = log.where(F.col("gid") > at), access.where(F.col("gid") > at)
        _, parts, begun = self._begin(access, snapshot)
        return self._run(log, parts, begun)

    def what_if(self, log: DataFrame, access: DataFrame, plan: Plan, snapshot: DataFrame | None = None, at: int = -1, final: DataFrame | None = None) -> Outcome:
        """The tables after the change. ``snapshot`` (name, row): the tables after
        gid ``at``, before the change; empty ones if it is missing. ``final``: the
        tables after the whole log; derived by a run of the log since then if it is
        missing. Only components that the change touches run again."""
        log, access = log.where(F.col("gid") > at), access.where(F.col("gid") > at)
        extra = self._extra(access, plan.added)
        if extra:
            access = self._with_whole_tables(access.unionByName(self.spark.createDataFrame(extra, ACCESS)))
        access = cut(access)
        scanned, parts, begun = self._begin(access, snapshot)
        if final is None:
            final = cut(self._run(log, parts, begun))
        changed = self._gids(plan.targets).union(self._gids(list(plan.added)))
        touched = cut(parts.join(changed.select(F.concat(F.lit("t:"), F.col("gid").cast("string")).alias("node")), "node", "left_semi").select("component").distinct())
        writes = access.where("rw = 'W'").select("gid").distinct()
        own = parts.where("node LIKE 't:%'").join(touched, "component", "left_semi").select(F.substring("node", 3, 20).cast("long").alias("gid")).join(writes, "gid", "left_semi")
        again = cut(self.changed_log(log, plan).join(own, "gid", "left_semi"))
        new = cut(self.state(again, parts, begun.join(touched, "component", "left_semi")).select("name", "row"))
        stay = self.placed(final, parts, scanned).join(touched, "component", "left_anti").select("name", "row")
        derived = stay.unionByName(new)
        return Outcome(derived, diff.bag_diff(final.select("name", "row"), derived, ["name", "row"]), again.select("gid").distinct())


@dataclass(frozen=True)
class Outcome:
    """state: (name, row) after the change; changes: rows that only the original
    (left) or only the changed state (right) holds; ran: gids that were run."""

    state: DataFrame
    changes: DataFrame
    ran: DataFrame


def _node(column: Any, point: Any, scanned: list[str]) -> Any:
    name = F.concat(F.lit("k:"), column)
    return F.when(column.isin(scanned) | point.isNull(), name).otherwise(F.concat(name, F.lit("="), point))


def _points(r: Range) -> list[str | None]:
    """The values of a range of points, as text; a null for any other range."""
    if r.wildcard or any(p.lo is None or p.lo != p.hi for p in r.parts):
        return [None]
    return [str(p.lo) for p in r.parts]


def _pseudo_keys(items: DataFrame) -> DataFrame:
    """Items with scans as keys of their own: what a scan reads, any write of the
    column taints; what a scan writes, any access of the column meets."""
    scan = F.col("point").isNull()
    one = lambda rw, name: F.struct(F.lit(rw).alias("rw"), F.lit(name).alias("point"))
    own = F.struct(F.col("rw"), F.concat(F.lit("="), F.col("point")).alias("point"))
    made = F.array(
        F.when(~scan, own),
        one("R", "any write of a scan"),
        F.when(scan, one("R", "any write")),
        F.when(F.col("rw") == "W", one("T", "any write")),
        F.when(scan & (F.col("rw") == "W"), one("T", "any write of a scan")),
    )
    return items.select("gid", "column", F.explode(F.array_compact(made)).alias("k")).select("gid", "k.rw", "column", "k.point").distinct()
