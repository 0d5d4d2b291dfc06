"""Statements on small tables in memory: what a replay task runs for a cluster.

A cluster's rows fit a task (clusters don't share rows); the log itself streams
through. Tables are lists of rows; a table may have an auto-increment key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from .access import Dml
from .procedures import Procedure, value_of


class Tables:
    def __init__(self, auto: dict[str, str] | None = None):
        self.auto = auto or {}
        self.rows: dict[str, list[dict[str, Any]]] = {}
        self.next_id: dict[str, int] = {}
        self.last_insert_id: int | None = None

    def load(self, table: str, row: dict[str, Any]) -> None:
        """A row that the table holds already."""
        self.rows.setdefault(table.lower(), []).append(row)
        if (key := self.auto.get(table.lower())) and row.get(key) is not None:
            self.next_id[table] = max(self.next_id.get(table, 0), int(row[key]))

    def _test(self, node: tuple | None, row: dict[str, Any], scope: dict[str, Any]) -> bool | None:
        """Three-valued: None if a null decides."""
        if node is None:
            return True
        if node[0] in ("AND", "OR"):
            got = [self._test(x, row, scope) for x in node[1]]
            end = node[0] == "OR"
            return end if end in got else None if None in got else not end
        op, column, values = node[0].upper(), node[1].split(".")[-1].lower(), [value_of(v, scope) if isinstance(v, tuple) else v for v in node[2]]
        v = row.get(column)
        if op in ("IS NULL", "IS NOT NULL"):
            return (v is None) == (op == "IS NULL")
        if v is None or any(x is None for x in values):
            return None
        return {
            "=": lambda: v == values[0], "!=": lambda: v != values[0], "<": lambda: v < values[0], "<=": lambda: v <= values[0], ">": lambda: v > values[0], ">=": lambda: v >= values[0],
            "IN": lambda: v in values, "NOT IN": lambda: v not in values, "BETWEEN": lambda: values[0] <= v <= values[1],
        }[op]()

    def execute(self, dml: Dml, scope: dict[str, Any]) -> list[Any]:
        """Run a statement; a SELECT gives its first row."""
        rows = self.rows.setdefault(dml.table.lower(), [])
        on = lambda row: self._test(dml.where, row, scope) is True
        seen = lambda row: scope | {f"col:{c}": v for c, v in row.items()}
        worth = lambda v, row: value_of(v, seen(row)) if isinstance(v, tuple) else v
        if dml.kind == "SELECT":
            for row in rows:
                if on(row):
                    return [row.get(c.split(".")[-1].lower()) for c in dml.select]
            return []
        if dml.kind in ("INSERT", "REPLACE"):
            for values in dml.rows or (dml.values,):
                row = {c.split(".")[-1].lower(): worth(v, {}) for c, v in values.items()}
                if (key := self.auto.get(dml.table.lower())) and row.get(key) is None:
                    row[key] = self.last_insert_id = self.next_id.get(dml.table, 0) + 1
                    self.next_id[dml.table] = row[key]
                    scope["last_insert_id"] = row[key]
                rows.append(row)
        elif dml.kind == "UPDATE":
            for row in rows:
                if on(row):
                    row.update({c.split(".")[-1].lower(): worth(v, row) for c, v in dml.values.items()})
        elif dml.kind == "DELETE":
            self.rows[dml.table.lower()] = [row for row in rows if not on(row)]
        else:
            raise ValueError(f"no such statement: {dml.kind}")
        return []


def replay_calls(calls: Iterable[tuple[str, list[Any], dict[str, Any] | None]], procedures: dict[str, Procedure], tables: Tables) -> Tables:
    """Run calls (name, arguments, recorded context) in order. A recorded insert
    id is used again, so keys stay those of the original run."""
    for name, args, context in calls:
        if context and context.get("insert_id") is not None:
            for table in tables.auto:
                tables.next_id[table] = context["insert_id"] - 1
        procedures[name].run(args, tables.execute)
    return tables


def call_matcher(procedures: dict[str, Procedure], keys: tuple[str, ...]) -> Callable[[str, list[Any]], Any]:
    """Accesses of a call, from the procedure's trace."""
    return lambda name, args: procedures[name].trace(args, keys)
