"""Row-based binary logs (version 4): events from bytes, and bytes from events.

``events`` parses one file; ``read`` does so for every file of a folder through
Spark's binary file source. Integers are little-endian; a row event's columns
are typed by the table map before it. The writer makes files for tests and for
export; it covers what it is given types for.
"""

from __future__ import annotations

import datetime as dt
import json
import struct
import zlib
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"\xfebin"
#: Event and column type codes of the format.
EVENT = {"QUERY": 2, "ROTATE": 4, "INTVAR": 5, "RAND": 13, "USER_VAR": 14, "FORMAT": 15, "XID": 16, "TABLE_MAP": 19, "WRITE_V1": 23, "UPDATE_V1": 24, "DELETE_V1": 25, "ROWS_QUERY": 29, "WRITE": 30, "UPDATE": 31, "DELETE": 32, "PARTIAL_UPDATE": 39}
TYPE = {"TINY": 1, "SHORT": 2, "LONG": 3, "FLOAT": 4, "DOUBLE": 5, "NULL": 6, "TIMESTAMP": 7, "LONGLONG": 8, "INT24": 9, "DATE": 10, "TIME": 11, "DATETIME": 12, "YEAR": 13, "VARCHAR": 15, "BIT": 16, "TIMESTAMP2": 17, "DATETIME2": 18, "TIME2": 19, "JSON": 245, "NEWDECIMAL": 246, "ENUM": 247, "SET": 248, "BLOB": 252, "VAR_STRING": 253, "STRING": 254, "GEOMETRY": 255}
_EVENT_NAME = {v: k for k, v in EVENT.items()}
_DIGIT_BYTES = (0, 1, 1, 2, 2, 3, 3, 4, 4, 4)
_INTS = {1: 1, 2: 2, 3: 4, 8: 8, 9: 3}


class Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("an event ends before its data")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, n: int, order: str = "little") -> int:
        return int.from_bytes(self.take(n), order)

    def packed(self) -> int:
        first = self.uint(1)
        return first if first < 251 else self.uint({252: 2, 253: 3, 254: 8}[first])

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[i // 8] >> (i % 8) & 1) for i in range(n)]


def decimal(raw: bytes, precision: int, scale: int) -> Decimal:
    """A packed decimal: groups of nine digits, big-endian, the first bit turned."""
    negative = not raw[0] & 0x80
    data = bytes([raw[0] ^ 0x80, *raw[1:]])
    if negative:
        data = bytes(x ^ 0xFF for x in data)
    whole, digits, at = precision - scale, "", 0
    for n in ([whole % 9] if whole % 9 else []) + [9] * (whole // 9):
        digits += str(int.from_bytes(data[at : at + _DIGIT_BYTES[n]], "big")).zfill(n)
        at += _DIGIT_BYTES[n]
    digits = (digits or "0") + "."
    for n in [9] * (scale // 9) + ([scale % 9] if scale % 9 else []):
        digits += str(int.from_bytes(data[at : at + _DIGIT_BYTES[n]], "big")).zfill(n)
        at += _DIGIT_BYTES[n]
    return Decimal(("-" if negative else "") + digits.rstrip("."))


def decimal_size(precision: int, scale: int) -> int:
    whole = precision - scale
    return whole // 9 * 4 + _DIGIT_BYTES[whole % 9] + scale // 9 * 4 + _DIGIT_BYTES[scale % 9]


def _fraction(c: Cursor, fsp: int) -> int:
    n = (fsp + 1) // 2
    return c.uint(n, "big") * 10 ** (6 - 2 * n) if n else 0


def _value(c: Cursor, kind: int, meta: int, signed: bool = True) -> Any:
    if kind in _INTS:
        return int.from_bytes(c.take(_INTS[kind]), "little", signed=signed)
    if kind == TYPE["FLOAT"]:
        return struct.unpack("<f", c.take(4))[0]
    if kind == TYPE["DOUBLE"]:
        return struct.unpack("<d", c.take(8))[0]
    if kind == TYPE["YEAR"]:
        y = c.uint(1)
        return 1900 + y if y else 0
    if kind == TYPE["NEWDECIMAL"]:
        return decimal(c.take(decimal_size(meta >> 8, meta & 255)), meta >> 8, meta & 255)
    if kind in (TYPE["VARCHAR"], TYPE["VAR_STRING"]):
        return c.take(c.uint(1 if meta < 256 else 2)).decode("utf-8", "replace")
    if kind == TYPE["STRING"]:
        real, size = meta >> 8, meta & 255
        if real in (TYPE["ENUM"], TYPE["SET"]):
            return c.uint(size)
        if real & 0x30 != 0x30:
            size |= ((real & 0x30) ^ 0x30) << 4
        return c.take(c.uint(1 if size < 256 else 2)).decode("utf-8", "replace")
    if kind in (TYPE["ENUM"], TYPE["SET"]):
        return c.uint(meta & 255)
    if kind in (TYPE["BLOB"], TYPE["JSON"], TYPE["GEOMETRY"]):
        return c.take(c.uint(meta)).decode("utf-8", "replace")
    if kind == TYPE["BIT"]:
        return c.uint(((meta >> 8) * 8 + (meta & 255) + 7) // 8, "big")
    if kind == TYPE["DATE"]:
        d = c.uint(3)
        return f"{d >> 9:04}-{d >> 5 & 15:02}-{d & 31:02}"
    if kind == TYPE["TIMESTAMP"]:
        return str(dt.datetime.fromtimestamp(c.uint(4), dt.UTC).replace(tzinfo=None))
    if kind == TYPE["TIMESTAMP2"]:
        seconds = c.uint(4, "big")
        return str(dt.datetime.fromtimestamp(seconds, dt.UTC).replace(tzinfo=None, microsecond=_fraction(c, meta)))
    if kind == TYPE["DATETIME2"]:
        p = c.uint(5, "big") - (1 << 39)
        us, ym = _fraction(c, meta), p >> 22
        return str(dt.datetime(ym // 13, ym % 13, p >> 17 & 31, p >> 12 & 31, p >> 6 & 63, p & 63, us))
    if kind == TYPE["DATETIME"]:
        n = c.uint(8)
        d, t = divmod(n, 1_000_000)
        return f"{d // 10000:04}-{d // 100 % 100:02}-{d % 100:02} {t // 10000:02}:{t // 100 % 100:02}:{t % 100:02}"
    if kind == TYPE["TIME"]:
        t = int.from_bytes(c.take(3), "little", signed=True)
        return f"{'-' if t < 0 else ''}{abs(t) // 10000:02}:{abs(t) // 100 % 100:02}:{abs(t) % 100:02}"
    if kind == TYPE["TIME2"]:
        extra = (meta + 1) // 2
        p = c.uint(3 + extra, "big") - (1 << (23 + 8 * extra))
        sign, p = ("-" if p < 0 else ""), abs(p)
        us, h = (p & ((1 << 8 * extra) - 1)) * 10 ** (6 - 2 * extra) if extra else 0, p >> 8 * extra
        return f"{sign}{h >> 12 & 1023:02}:{h >> 6 & 63:02}:{h & 63:02}" + (f".{us:06}" if extra else "")
    raise ValueError(f"column type {kind} is not supported")


def _meta(c: Cursor, kind: int) -> int:
    if kind in (TYPE["VARCHAR"], TYPE["BIT"]):
        return c.uint(2)
    if kind in (TYPE["NEWDECIMAL"], TYPE["STRING"], TYPE["VAR_STRING"], TYPE["ENUM"], TYPE["SET"]):
        return c.uint(2, "big")
    if kind in (TYPE["FLOAT"], TYPE["DOUBLE"], TYPE["BLOB"], TYPE["JSON"], TYPE["GEOMETRY"], TYPE["TIMESTAMP2"], TYPE["DATETIME2"], TYPE["TIME2"]):
        return c.uint(1)
    return 0


def _table_map(c: Cursor) -> tuple[int, dict[str, Any]]:
    table_id = c.uint(6)
    c.take(2)
    database = c.take(c.uint(1)).decode()
    c.take(1)
    table = c.take(c.uint(1)).decode()
    c.take(1)
    kinds = list(c.take(c.packed()))
    m = Cursor(c.take(c.packed()))
    meta = [_meta(m, k) for k in kinds]
    c.bits(len(kinds))
    names: list[str] = []
    unsigned: list[bool] = [False] * len(kinds)
    while c.at < len(c.data):  # optional metadata: signs and column names
        field, size = c.uint(1), c.packed()
        part = Cursor(c.take(size))
        if field == 1:
            numeric = [i for i, k in enumerate(kinds) if k in (1, 2, 3, 8, 9, 4, 5, 246, 13)]
            raw = part.data
            for j, i in enumerate(numeric):
                unsigned[i] = bool(raw[j // 8] >> (7 - j % 8) & 1)
        elif field == 4:
            while part.at < len(part.data):
                names.append(part.take(part.packed()).decode())
    return table_id, {"database": database, "table": table, "kinds": kinds, "meta": meta, "names": names or [f"c{i}" for i in range(len(kinds))], "unsigned": unsigned}


def _image(c: Cursor, t: dict[str, Any], present: list[bool]) -> dict[str, Any]:
    used = [i for i, p in enumerate(present) if p]
    nulls = c.bits(len(used))
    return {t["names"][i]: None if null else _value(c, t["kinds"][i], t["meta"][i], not t["unsigned"][i]) for i, null in zip(used, nulls, strict=True)}


def _rows(c: Cursor, code: int, tables: dict[int, dict[str, Any]]) -> Iterator[dict[str, Any]]:
    table_id = c.uint(6)
    c.take(2)
    if code >= EVENT["WRITE"]:
        c.take(c.uint(2) - 2)
    t, n = tables.get(table_id), c.packed()
    kind = "INSERT" if code in (23, 30) else "UPDATE" if code in (24, 31) else "DELETE"
    before = c.bits(n)
    after = c.bits(n) if kind == "UPDATE" else before
    if t is None or n != len(t["kinds"]):
        return  # rows of an unknown table, or of another number of columns, say nothing
    while c.at < len(c.data):
        first = _image(c, t, before)
        second = _image(c, t, after) if kind == "UPDATE" else None
        yield {"database": t["database"], "table": t["table"], "kind": kind, "before": first if kind != "INSERT" else None, "after": second if kind == "UPDATE" else first if kind == "INSERT" else None}


def events(data: bytes) -> Iterator[dict[str, Any]]:
    """Events of one file in order: position, type, timestamp and what the type holds."""
    if data[:4] != MAGIC:
        raise ValueError("this is no binary log")
    at, tables, checksum = 4, {}, 0
    while at + 19 <= len(data):
        stamp, code, server, size, _, flags = struct.unpack_from("<IBIIIH", data, at)
        if size < 19 or at + size > len(data):
            break  # the file is still being written
        c = Cursor(data[at + 19 : at + size - checksum])
        base = {"pos": at, "next_pos": at + size, "type": _EVENT_NAME.get(code, str(code)), "ts": stamp}
        at += size
        if code == EVENT["FORMAT"]:
            body = c.data
            checksum = 4 if len(body) > 5 and body[-5] == 1 else 0
        elif code == EVENT["TABLE_MAP"]:
            try:
                table_id, t = _table_map(c)
            except (KeyError, ValueError):
                continue
            tables[table_id] = t
        elif code in (23, 24, 25, 30, 31, 32):
            for i, row in enumerate(_rows(c, code, tables)):
                yield base | row | {"row": i}
        elif code == EVENT["QUERY"]:
            c.take(8)
            name, _, extra = c.uint(1), c.uint(2), c.uint(2)
            c.take(extra)
            database = c.take(name).decode()
            c.take(1)
            yield base | {"database": database, "statement": c.take(len(c.data) - c.at).decode("utf-8", "replace")}
        elif code == EVENT["ROWS_QUERY"]:
            c.take(1)
            yield base | {"statement": c.take(len(c.data) - c.at).decode("utf-8", "replace")}
        elif code == EVENT["XID"]:
            yield base | {"xid": c.uint(8)}
        elif code == EVENT["INTVAR"]:
            yield base | {"variable": {1: "LAST_INSERT_ID", 2: "INSERT_ID"}.get(c.uint(1), "?"), "value": str(c.uint(8))}
        elif code == EVENT["RAND"]:
            yield base | {"variable": "RAND_SEED", "value": f"{c.uint(8)},{c.uint(8)}"}
        elif code == EVENT["USER_VAR"]:
            name = c.take(c.uint(4)).decode()
            if c.uint(1):
                yield base | {"variable": f"@{name}", "value": None}
                continue
            kind, _, n = c.uint(1), c.uint(4), c.uint(4)
            raw = c.take(n)
            value = {0: lambda: raw.decode("utf-8", "replace"), 1: lambda: repr(struct.unpack("<d", raw)[0]), 2: lambda: str(int.from_bytes(raw, "little", signed=True)), 4: lambda: str(decimal(raw[2:], raw[0], raw[1]))}[kind]()
            yield base | {"variable": f"@{name}", "value": value}


SCHEMA = "file string, pos long, row int, type string, ts long, database string, table string, kind string, statement string, xid long, variable string, value string, before string, after string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split()[0] for x in SCHEMA.split(",")]
    text = lambda image: None if image is None else json.dumps(image, default=str, ensure_ascii=False)
    kinds = {"pos": pa.int64(), "row": pa.int32(), "ts": pa.int64(), "xid": pa.int64()}
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows: list[dict[str, Any]] = []
            for e in events(content.as_py()):
                rows.append(e | {"file": path.as_py(), "before": text(e.get("before")), "after": text(e.get("after"))})
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


def parse(files: DataFrame) -> DataFrame:
    """``files`` (path, content) as one row per event, row images as JSON."""
    return files.select("path", "content").mapInArrow(_parse, SCHEMA)


def read(spark: SparkSession, place: str) -> DataFrame:
    return parse(spark.read.format("binaryFile").load(place))


# ---- writing ----


def _packed(n: int) -> bytes:
    return bytes([n]) if n < 251 else b"\xfc" + struct.pack("<H", n) if n < 1 << 16 else b"\xfd" + n.to_bytes(3, "little")


class Writer:
    """Collects events of one file, each with a checksum."""

    def __init__(self, server: int = 1):
        self.server, self.out = server, bytearray(MAGIC)
        self.add("FORMAT", struct.pack("<H50sIB", 4, b"8.0", 0, 19) + bytes(39) + b"\x01")

    def add(self, kind: str, body: bytes, ts: int = 0) -> Writer:
        size = 19 + len(body) + 4
        event = struct.pack("<IBIIIH", ts, EVENT[kind], self.server, size, len(self.out) + size, 0) + body
        self.out += event + struct.pack("<I", zlib.crc32(event))
        return self

    def query(self, database: str, sql: str, ts: int = 0) -> Writer:
        return self.add("QUERY", struct.pack("<IIBHH", 1, 0, len(database), 0, 0) + database.encode() + b"\0" + sql.encode(), ts)

    def xid(self, xid: int, ts: int = 0) -> Writer:
        return self.add("XID", struct.pack("<Q", xid), ts)

    def table(self, table_id: int, database: str, name: str, columns: list[tuple[str, str]], ts: int = 0) -> Writer:
        """columns: (name, LONG | LONGLONG | DOUBLE | VARCHAR | BLOB)."""
        meta = b"".join({"VARCHAR": struct.pack("<H", 1024), "DOUBLE": b"\x08", "FLOAT": b"\x04", "BLOB": b"\x04"}.get(k, b"") for _, k in columns)
        names = b"".join(_packed(len(n.encode())) + n.encode() for n, _ in columns)
        body = table_id.to_bytes(6, "little") + b"\x01\x00" + bytes([len(database)]) + database.encode() + b"\0" + bytes([len(name)]) + name.encode() + b"\0"
        body += _packed(len(columns)) + bytes(TYPE[k] for _, k in columns) + _packed(len(meta)) + meta + b"\xff" * ((len(columns) + 7) // 8) + b"\x04" + _packed(len(names)) + names
        return self.add("TABLE_MAP", body, ts)

    def rows(self, kind: str, table_id: int, columns: list[tuple[str, str]], images: list[list[Any]], ts: int = 0) -> Writer:
        """kind: WRITE, UPDATE (before and after images in turn) or DELETE."""
        n = len(columns)
        body = table_id.to_bytes(6, "little") + b"\x01\x00" + struct.pack("<H", 2) + _packed(n) + b"\xff" * ((n + 7) // 8) * (2 if kind == "UPDATE" else 1)
        for image in images:
            nulls = bytearray((n + 7) // 8)
            data = b""
            for i, ((_, k), v) in enumerate(zip(columns, image, strict=True)):
                if v is None:
                    nulls[i // 8] |= 1 << i % 8
                elif k in ("VARCHAR", "BLOB"):
                    raw = v.encode()
                    data += struct.pack("<H" if k == "VARCHAR" else "<I", len(raw)) + raw
                else:
                    data += struct.pack({"LONG": "<i", "LONGLONG": "<q", "DOUBLE": "<d", "FLOAT": "<f"}[k], v)
            body += bytes(nulls) + data
        return self.add(kind, body, ts)

    def bytes(self) -> bytes:
        return bytes(self.out)
