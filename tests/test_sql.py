"""The SQL front end: what statements read and write, and procedures that run."""

import pytest

from retrolens.operators import executor
from retrolens.operators.access import accesses
from retrolens.sources import sql

CASES = [
    ("SELECT a, b FROM t WHERE id = 1", {"t.a", "t.b", "t.id"}, set()),
    ("SELECT u.name, COUNT(DISTINCT p.id) AS n FROM users u LEFT JOIN posts p ON p.author = u.id WHERE u.age BETWEEN 3 AND 9 GROUP BY u.name HAVING MAX(p.score) > 2 ORDER BY u.rank LIMIT 3", {"users.name", "posts.id", "posts.author", "users.id", "users.age", "posts.score", "users.rank"}, set()),
    ("SELECT * FROM t WHERE x IN (SELECT y FROM s WHERE z = 2)", {"t.*", "t.x", "s.y", "s.z"}, set()),
    ("SELECT d.q FROM (SELECT q FROM s) d WHERE EXISTS (SELECT 1 FROM v WHERE v.k = 3)", {"s.q", "v.k"}, set()),
    ("INSERT INTO t (id, a) VALUES (1, 'x'), (2, CONCAT('y', ?))", set(), {"t.*", "t.id", "t.a"}),
    ("INSERT INTO t (id) SELECT k FROM s", {"s.k"}, {"t.*", "t.id"}),
    ("UPDATE t SET a = a + 1, b = 'z' WHERE id = 3 AND c IS NULL", {"t.a", "t.id", "t.c"}, {"t.a", "t.b"}),
    ("UPDATE db.t AS x SET x.a = 2 WHERE x.id NOT IN (1, 2)", {"t.id"}, {"t.a"}),
    ("DELETE FROM t WHERE id < 5 OR name LIKE 'ab%'", {"t.id", "t.name"}, {"t.*"}),
    ("REPLACE INTO t (id) VALUES (9)", set(), {"t.*", "t.id"}),
    ("TRUNCATE TABLE t", set(), {"t.*"}),
    ("SELECT a FROM t UNION ALL SELECT b FROM s", {"t.a", "s.b"}, set()),
]


@pytest.mark.parametrize("text,reads,writes", CASES)
def test_read_and_write_sets(text, reads, writes):
    a = accesses(sql.parse(text))
    assert (set(a.reads), set(a.writes)) == (reads, writes)


def test_items():
    item = lambda text, c="t.id": accesses(sql.parse(text), (c,)).read_items[c]
    assert item("SELECT a FROM t WHERE id >= 1 AND id <= 3").sql("id") == "(id>=1 AND id<=3)"
    assert item("SELECT a FROM t WHERE 5 > id").sql("id") == "id<5"
    assert item("SELECT a FROM t WHERE id = _utf8mb4'a''b' COLLATE utf8mb4_bin").sql("id") == "id=X'612762'"
    assert item("SELECT a FROM t WHERE id = NAME_CONST('v', 7)").sql("id") == "id=7"
    assert item("SELECT a FROM t WHERE (id = 1 OR id = -2) AND b = 3").sql("id") == "id=-2 OR id=1"
    for wild in ("a = 1", "id = b", "NOT id = 3", "ABS(id) = 3", "id IS NULL", "id IN (SELECT k FROM s)", "id = 3 OR b = 2", "id = NULL"):
        assert item(f"SELECT a FROM t WHERE {wild}").wildcard, wild
    assert accesses(sql.parse("UPDATE t SET a = 1 WHERE id = 4"), ("t.id",)).write_items["t.id"].sql("id") == "id=4"


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT a FROM", "UPDATE t SET", "FROM t", "SELECT a FROM t WHERE", "DELETE t WHERE x = 1", "SELECT a FROM t) x", "CREATE TABLE t (a INT)"])
def test_refused(text):
    with pytest.raises(sql.SyntaxFault):
        sql.parse(text)


SCRIPT = """
DELIMITER $$
CREATE DEFINER=`a`@`b` PROCEDURE pay(IN p_id INT, INOUT p_left DECIMAL(10, 2), OUT p_n BIGINT UNSIGNED)
BEGIN
  DECLARE v_price INT DEFAULT 0; -- the price
  SET p_n = 0;
  SELECT price INTO v_price FROM items WHERE id = p_id;
  again: WHILE p_left >= v_price AND v_price > 0 DO
    SET p_left = p_left - v_price, p_n = p_n + 1;
    IF p_n > 5 THEN LEAVE again; END IF;
  END WHILE again;
  IF p_n = 0 THEN
    DELETE FROM items WHERE id = p_id;
  ELSEIF p_n > 2 THEN
    UPDATE items SET stock = stock - p_n WHERE id = p_id;
  ELSE
    INSERT INTO notes (item, n) VALUES (p_id, p_n * 10);
  END IF;
END$$
DELIMITER ;
"""


def test_procedures_run_and_are_traced(tmp_path):
    pay = sql.procedures(SCRIPT)["pay"]
    assert pay.params == [("IN", "p_id"), ("INOUT", "p_left"), ("OUT", "p_n")]
    t = executor.Tables()
    t.rows["items"] = [{"id": 1, "price": 4, "stock": 9}, {"id": 2, "price": 50, "stock": 9}, {"id": 3, "price": 6, "stock": 1}]
    assert pay.run([1, 14, None], t.execute) == {"p_left": 2, "p_n": 3}
    assert pay.run([2, 14, None], t.execute) == {"p_left": 14, "p_n": 0}
    assert pay.run([3, 14, None], t.execute) == {"p_left": 2, "p_n": 2}
    assert t.rows["items"] == [{"id": 1, "price": 4, "stock": 6}, {"id": 3, "price": 6, "stock": 1}] and t.rows["notes"] == [{"item": 3, "n": 20}]
    a = pay.trace([7, 1, None], ("items.id",))
    assert a.writes == {"items.*", "items.stock", "notes.*", "notes.item", "notes.n"} and a.write_items["items.id"].sql("id") == "id=7"
    (tmp_path / "pay.sql").write_text(SCRIPT)
    assert sql.load_procedure(str(tmp_path), "pay").name == "pay" and sql.load_procedure(str(tmp_path), "none") is None


def test_user_transaction():
    made = sql.parse_script("SET autocommit = 0; START TRANSACTION; UPDATE t SET a = 1 WHERE id = 2; DELETE FROM s; COMMIT")
    assert [d.kind for d in made] == ["UPDATE", "DELETE"]
    with pytest.raises(sql.SyntaxFault):
        sql.parse_script("DROP TABLE t")
    for cut in range(len(SCRIPT)):  # no text makes the parser run on
        try:
            sql.procedures(SCRIPT[:cut])
        except sql.SyntaxFault:
            pass
    assert sql.normal_form("SELECT  `A` FROM t\nWHERE x='1' AND y = 2") == "select a from t where x = ? and y = ?"
