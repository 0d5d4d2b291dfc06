"""Command line: python -m retrolens -c CONFIG --log LOG [--out OUT] ACTIONS

ACTIONS, parted by colons: make_cluster, rollback=GID[,GID...],
prepend=GID,FILE.sql, auto-rollback=RATIO, replay, full-replay, view. LOG is a
table (gid, q, statement); OUT is where plans and states go. A change of a
transaction is its rollback and a prepend at its gid.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from retrolens import engine
from retrolens.shipping import ship
from retrolens.sources import config, sql
from retrolens.sources.statelog import window


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="retrolens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-c", "--config", required=True)
    p.add_argument("--log", required=True)
    p.add_argument("--out", default="")
    p.add_argument("--procedures", default="", help="a script with CREATE PROCEDURE statements")
    p.add_argument("--foreign-key", action="append", default=[], metavar="CHILD.COL=PARENT.COL")
    p.add_argument("--auto", action="append", default=[], metavar="TABLE=COLUMN", help="auto-increment keys")
    p.add_argument("--snapshot", default="", metavar="GID,FOLDER", help="tables (name, row) after a gid before the change")
    p.add_argument("--final", default="", metavar="FOLDER", help="tables (name, row) after the whole log")
    p.add_argument("-s", "--start", type=int)
    p.add_argument("-e", "--end", type=int)
    p.add_argument("--limit", type=int, default=0, help="rows that view and replay print at most; all if 0")
    p.add_argument("--dry-run", action="store_true", help="plan only, write nothing")
    p.add_argument("actions")
    a = p.parse_args(args)
    held = config.load(a.config)
    show = lambda df: df.show(a.limit or 2**31 - 1, truncate=False)
    if held is None:
        print(f"{a.config} is no usable configuration", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("retrolens").getOrCreate()
    ship(spark)
    pair = lambda text: tuple(text.split("=", 1))
    procs = sql.procedures(Path(a.procedures).read_text()) if a.procedures else {}
    w = engine.WhatIf(spark, held, [pair(x) for x in a.foreign_key], procs, dict(map(pair, a.auto)))
    log = window(spark.read.parquet(a.log), a.start, a.end)
    access = spark.read.parquet(f"{a.out}/access") if a.out and (("make_cluster" not in a.actions) and _there(spark, f"{a.out}/access")) else w.analyse(log)
    at, _, held_at = a.snapshot.partition(",")
    snapshot = (spark.read.parquet(held_at) if held_at else None, int(at or -1), spark.read.parquet(a.final) if a.final else None)
    targets: list[int] = []
    added: dict[int, list[str]] = {}
    plan = None
    for action in a.actions.split(":"):
        name, _, value = action.partition("=")
        if name == "view":
            show(log.orderBy("gid", "q").select("gid", "q", "statement"))
        elif name == "make_cluster":
            if a.out and not a.dry_run:
                access.write.mode("overwrite").parquet(f"{a.out}/access")
                access = spark.read.parquet(f"{a.out}/access")
        elif name == "rollback":
            targets += [int(x) for x in value.split(",")]
        elif name == "prepend":
            gid, _, file = value.partition(",")
            sql.parse_script(Path(file).read_text())
            added.setdefault(int(gid), []).extend(s for s in sql.split_statements(Path(file).read_text()) if not sql.is_setting(s))
        elif name == "auto-rollback":
            w.report(w.auto_plan(access, float(value))).show()
        elif name not in ("replay", "full-replay"):
            print(f"no such action: {name}", file=sys.stderr)
            return 2
    if targets or added:
        plan = w.plan(access, targets, added)
        w.report(plan).show()
        if a.out and not a.dry_run:
            plan.save(f"{a.out}/plan")
    for action in ("replay", "full-replay"):
        if action in a.actions.split(":"):
            plan = plan or engine.load_plan(spark, f"{a.out}/plan")
            if action == "replay":
                out = w.what_if(log, access, plan, *snapshot)
                state = out.state
                show(out.changes)
            else:
                state = w.state(w.changed_log(log, plan), w.components(access)).select("name", "row")
            if a.out and not a.dry_run:
                state.write.mode("overwrite").parquet(f"{a.out}/{action}")
    return 0


def _there(spark: SparkSession, place: str) -> bool:
    try:
        spark.read.parquet(place)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


if __name__ == "__main__":
    sys.exit(main())
