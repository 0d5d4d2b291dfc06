"""Binary logs: what is written is read, and packed values decode."""

import struct
from decimal import Decimal

import pytest

from retrolens.sources import binlog

COLUMNS = [("id", "LONG"), ("big", "LONGLONG"), ("x", "DOUBLE"), ("name", "VARCHAR"), ("note", "BLOB")]


def test_round_trip_of_rows():
    w = binlog.Writer().query("shop", "BEGIN", 5).table(7, "shop", "t", COLUMNS, 5)
    w.rows("WRITE", 7, COLUMNS, [[1, 2**40, 1.5, "é", None], [-2, -1, None, "", "long " * 100]], 5)
    w.rows("UPDATE", 7, COLUMNS, [[1, 0, 0.0, "a", "b"], [1, 1, 1.0, "c", "d"]], 6).rows("DELETE", 7, COLUMNS, [[1, 1, 1.0, "c", None]], 6).rows("WRITE", 9, COLUMNS, [[1, 1, 1.0, "", ""]], 6).xid(33, 6)
    got = list(binlog.events(w.bytes()))
    assert [e["type"] for e in got] == ["QUERY", "WRITE", "WRITE", "UPDATE", "DELETE", "XID"]  # rows of an unknown table are skipped
    assert got[1]["after"] == {"id": 1, "big": 2**40, "x": 1.5, "name": "é", "note": None} and got[2]["after"]["id"] == -2
    assert got[3]["before"]["name"] == "a" and got[3]["after"]["note"] == "d" and got[4]["before"]["note"] is None
    assert got[0]["statement"] == "BEGIN" and got[5]["xid"] == 33
    assert len(list(binlog.events(w.bytes()[:-5]))) == 5  # a file that is still being written
    with pytest.raises(ValueError):
        list(binlog.events(b"nonsense"))


def test_packed_values():
    dec = lambda text, p, s: binlog.decimal(bytes.fromhex(text), p, s)
    assert dec("810DFB38D204D2", 14, 4) == Decimal("1234567890.1234")
    assert dec("7EF204C72DFB2D", 14, 4) == Decimal("-1234567890.1234")
    value = lambda kind, raw, meta=0: binlog._value(binlog.Cursor(raw), binlog.TYPE[kind], meta)
    assert value("INT24", b"\xff\xff\xff") == -1 and value("YEAR", b"\x7c") == 2024
    assert value("DATE", (2024 << 9 | 2 << 5 | 29).to_bytes(3, "little")) == "2024-02-29"
    packed = ((2024 * 13 + 3) << 22 | 5 << 17 | 6 << 12 | 7 << 6 | 8) + (1 << 39)
    assert value("DATETIME2", packed.to_bytes(5, "big") + (1234).to_bytes(2, "big"), 4) == "2024-03-05 06:07:08.123400"
    assert value("TIMESTAMP2", struct.pack(">I", 86400), 0) == "1970-01-02 00:00:00"
    assert value("TIME2", ((1 << 23) + (12 << 12 | 34 << 6 | 56)).to_bytes(3, "big"), 0) == "12:34:56"
    assert value("STRING", b"\x02ab", 0xFE << 8 | 40) == "ab" and value("STRING", b"\x03", 0xF7 << 8 | 1) == 3
    assert value("BIT", b"\x05", 0 << 8 | 3) == 5
