"""Column options, references, triggers and stored programs, all through SQL text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.plans.engine import Engine, Unsupported
from quillon.plans.procedures import ParseError, Signal, parse
from quillon.sources.store import Conflict, VersionedTable


@pytest.fixture()
def db(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_column_options(db):
    db.execute("CREATE TABLE t (id INT AUTO_INCREMENT PRIMARY KEY, name VARCHAR(9) NOT NULL DEFAULT 'x, y', n INT DEFAULT 7, mail TEXT UNIQUE)")
    db.execute("INSERT INTO t (mail) VALUES ('a'), ('b')")
    db.execute("INSERT INTO t (id, name, mail) VALUES (10, 'ten', 'c')")
    db.execute("INSERT INTO t (mail) VALUES ('d')")
    assert rows(db.execute("SELECT id, name, n FROM t")) == [(1, "x, y", 7), (10, "ten", 7), (11, "x, y", 7), (2, "x, y", 7)]
    for bad in ("INSERT INTO t (name, mail) VALUES (NULL, 'e')", "INSERT INTO t (mail) VALUES ('a')", "UPDATE t SET name = NULL WHERE id = 1", "UPDATE t SET mail = 'a'", "INSERT INTO t (id, mail) VALUES (10, 'z')"):
        with pytest.raises(Conflict):
            db.execute(bad)
    again = Engine(db.spark, db.root)
    text = again.execute("SHOW CREATE TABLE t").first()["definition"]
    assert "AUTO_INCREMENT" in text and "DEFAULT 'x, y'" in text and "UNIQUE KEY (`mail`)" in text
    db.execute("DROP TABLE t")
    db.execute(text)
    assert db.tables["t"].unique == [["mail"]]


def test_indexes(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, a INT, b INT)")
    db.execute("INSERT INTO t VALUES (1, 1, 1), (2, 1, 2)")
    with pytest.raises(Conflict):
        db.execute("CREATE UNIQUE INDEX u ON t (a)")
    db.execute("CREATE UNIQUE INDEX u ON t (b)")
    db.execute("CREATE INDEX i ON t (a, b)")
    with pytest.raises(Conflict):
        db.execute("INSERT INTO t VALUES (3, 3, 2)")
    shown = [("PRIMARY", 1, "id", 0), ("i", 1, "a", 1), ("i", 2, "b", 1), ("u", 1, "b", 0)]
    assert rows(db.execute("SHOW INDEX FROM t").select("index_name", "seq_in_index", "column_name", "non_unique")) == shown
    assert rows(db.execute("SELECT index_name FROM information_schema.statistics WHERE table_name = 't' AND seq_in_index = 2")) == [("i",)]
    db.execute("DROP INDEX u ON t")
    db.execute("INSERT INTO t VALUES (3, 3, 2)")
    with pytest.raises(Unsupported):
        db.execute("DROP INDEX u ON t")


def test_references(db):
    db.execute("CREATE TABLE a (id INT PRIMARY KEY, n INT)")
    db.execute("CREATE TABLE b (id INT PRIMARY KEY, a INT REFERENCES a (id) ON DELETE CASCADE ON UPDATE CASCADE)")
    db.execute("CREATE TABLE c (id INT PRIMARY KEY, b INT, CONSTRAINT f FOREIGN KEY (b) REFERENCES b (id) ON DELETE SET NULL)")
    db.execute("CREATE TABLE d (id INT PRIMARY KEY, a INT, FOREIGN KEY (a) REFERENCES a(id))")
    db.execute("INSERT INTO a VALUES (1, 0), (2, 0), (3, 0)")
    db.execute("INSERT INTO b VALUES (10, 1), (20, 2), (30, NULL)")
    db.execute("INSERT INTO c VALUES (100, 10), (200, 20)")
    db.execute("INSERT INTO d VALUES (7, 3)")
    for bad in ("INSERT INTO b VALUES (40, 9)", "UPDATE b SET a = 9 WHERE id = 10", "DELETE FROM a", "UPDATE a SET id = 33 WHERE id = 3"):
        with pytest.raises(Conflict):
            db.execute(bad)
    assert db.execute("SELECT * FROM b").count() == 3  # a refusal further on has changed nothing
    db.execute("UPDATE a SET id = 22 WHERE id = 2")
    assert rows(db.execute("SELECT a FROM b WHERE id = 20")) == [(22,)]
    db.execute("DELETE FROM a WHERE id = 1")
    assert rows(db.execute("SELECT id FROM b")) == [(20,), (30,)] and rows(db.execute("SELECT * FROM c")) == [(100, None), (200, 20)]


def test_triggers(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, n INT)")
    db.execute("CREATE TABLE log (k TEXT, was INT, now INT, PRIMARY KEY (k))")
    db.execute("CREATE TRIGGER up BEFORE INSERT ON t FOR EACH ROW BEGIN SET NEW.name = UPPER(NEW.name); IF NEW.n < 0 THEN SET NEW.n = 0; END IF; END")
    db.execute("CREATE TRIGGER mark BEFORE INSERT ON t FOR EACH ROW PRECEDES up SET NEW.name = CONCAT(NEW.name, '!')")
    db.execute("CREATE TRIGGER cap BEFORE UPDATE ON t FOR EACH ROW BEGIN IF NEW.n > 100 THEN SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'too much'; END IF; SET NEW.name = 'TRIG'; END")
    db.execute("CREATE TRIGGER note AFTER UPDATE ON t FOR EACH ROW INSERT INTO log VALUES (CONCAT(NEW.name, NEW.id), OLD.n, NEW.n)")
    db.execute("CREATE TRIGGER bye AFTER DELETE ON t FOR EACH ROW INSERT INTO log (k, was) VALUES (CONCAT('gone', OLD.id), OLD.n)")
    db.execute("INSERT INTO t VALUES (1, 'a', -5), (2, 'b', 5)")
    assert rows(db.execute("SELECT * FROM t")) == [(1, "A!", 0), (2, "B!", 5)]
    db.execute("UPDATE t SET n = n + 1, name = 'own' WHERE id = 2")
    assert rows(db.execute("SELECT * FROM t WHERE id = 2")) == [(2, "TRIG", 6)]
    with pytest.raises(Signal, match="too much"):
        db.execute("UPDATE t SET n = 500")
    db.execute("DELETE FROM t WHERE id = 2")
    assert rows(db.execute("SELECT * FROM log")) == [("TRIG2", 5, 6), ("gone2", 6, 0)]
    assert [r["name"] for r in Engine(db.spark, db.root).execute("SHOW TRIGGERS").collect()] == ["bye", "cap", "mark", "note", "up"]
    db.execute("DROP TRIGGER cap")
    db.execute("UPDATE t SET n = 500")


def test_procedures(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, n INT)")
    db.execute("INSERT INTO t VALUES (1, 10), (2, 20), (3, 30)")
    db.execute("""CREATE PROCEDURE total(IN least INT, OUT s INT, INOUT calls INT)
    BEGIN
      DECLARE done, one INT DEFAULT 0;
      DECLARE c CURSOR FOR SELECT n FROM t WHERE n >= least ORDER BY id;
      DECLARE CONTINUE HANDLER FOR NOT FOUND SET done = 1;
      SET s = 0;
      OPEN c;
      more: LOOP
        FETCH c INTO one;
        IF done = 1 THEN LEAVE more; END IF;
        SET s = s + one;
      END LOOP more;
      CLOSE c;
      SET calls = calls + 1;
    END""")
    db.execute("SET @calls = 4")
    db.execute("CALL total(15, @s, @calls)")
    assert (db.variables["s"], db.variables["calls"]) == (50, 5)
    db.execute("CREATE PROCEDURE outer_one() BEGIN DECLARE x INT; DECLARE k INT DEFAULT 0; CALL total(25, x, k); UPDATE t SET n = x WHERE id = 1; SELECT n FROM t WHERE id = 1; END")
    again = Engine(db.spark, db.root)  # procedures stay
    assert rows(again.execute("CALL outer_one()")) == [(30,)]
    db.execute("CREATE PROCEDURE deep(IN n INT) BEGIN CALL deep(n + 1); END")
    with pytest.raises(Signal, match="deeper"):
        db.execute("CALL deep(0)")
    db.execute("DROP PROCEDURE deep")
    with pytest.raises(Unsupported):
        db.execute("CALL deep(0)")


def run(db, body, **values):
    db.variables.update(values)
    db.execute(f"CREATE OR REPLACE PROCEDURE p() {body}")
    db.execute("CALL p()")
    return {k: db.variables[k] for k in values}


def test_control_flow(db):
    body = """BEGIN
      DECLARE i INT DEFAULT 0;
      WHILE i < 10 DO
        SET i = i + 1;
        IF i % 2 = 0 THEN SET @even = @even + 1; ELSEIF i = 9 THEN SET @nine = 1; ELSE SET @odd = @odd + 1; END IF;
      END WHILE;
      REPEAT SET i = i - 3; UNTIL i < 0 END REPEAT;
      SET @i = i;
      a: FOR k IN 1..4 LOOP
        b: FOR j IN REVERSE 1..3 LOOP
          IF j = 2 THEN ITERATE a; END IF;
          SET @sum = @sum + k * j;
        END LOOP b;
      END LOOP a;
      CASE @sum WHEN 30 THEN SET @case = 'thirty'; ELSE SET @case = CASE WHEN TRUE THEN 'other; END' END; END CASE;
      BEGIN DECLARE i INT DEFAULT 99; SET i = i + 1; END;
      SET @after = i;
    END"""
    assert run(db, body, even=0, odd=0, nine=0, i=0, sum=0, case="", after=0) == {"even": 5, "odd": 4, "nine": 1, "i": -2, "sum": 30, "case": "thirty", "after": -2}


def test_handlers_and_conditions(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY)")
    db.execute("INSERT INTO t VALUES (1)")
    body = """BEGIN
      DECLARE dup CONDITION FOR SQLSTATE '23000';
      DECLARE CONTINUE HANDLER FOR dup SET @dup = @dup + 1;
      INSERT INTO t VALUES (1);
      INSERT INTO t VALUES (1);
      SET @through = 1;
      BEGIN
        DECLARE EXIT HANDLER FOR SQLSTATE '45000' BEGIN GET DIAGNOSTICS CONDITION 1 @state = RETURNED_SQLSTATE, @text = MESSAGE_TEXT; END;
        SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'mine';
        SET @through = 2;
      END;
      BEGIN
        DECLARE EXIT HANDLER FOR SQLEXCEPTION SET @last = 1;
        BEGIN
          DECLARE EXIT HANDLER FOR SQLSTATE '45001' RESIGNAL;
          SIGNAL SQLSTATE '45001';
        END;
      END;
    END"""
    assert run(db, body, dup=0, through=0, state="", text="", last=0) == {"dup": 2, "through": 1, "state": "45000", "text": "mine", "last": 1}
    with pytest.raises(Signal):
        run(db, "BEGIN SIGNAL SQLSTATE '45002'; END")
    with pytest.raises(Signal, match="no data"):
        run(db, "BEGIN DECLARE x INT; SELECT id INTO x FROM t WHERE id = 77; END")


def test_bodies_that_end_early():
    for text in ("BEGIN SET a = 1;", "BEGIN IF x THEN END;", "BEGIN END END", "BEGIN LOOP SET a = 1; END;"):
        with pytest.raises(ParseError):
            parse(text)


def test_renamed_tables(db):
    db.execute("CREATE TABLE a (id INT PRIMARY KEY)")
    db.execute("CREATE TABLE b (id INT PRIMARY KEY, a INT REFERENCES a (id))")
    db.execute("CREATE TRIGGER odd BEFORE INSERT ON a FOR EACH ROW SET NEW.id = NEW.id * 2 + 1")
    db.execute("ALTER TABLE a RENAME TO c")
    again = Engine(db.spark, db.root)
    again.execute("INSERT INTO c VALUES (3)")
    again.execute("INSERT INTO b VALUES (1, 7)")
    with pytest.raises(Conflict):
        again.execute("INSERT INTO b VALUES (2, 3)")
    with pytest.raises(Conflict):
        again.execute("ALTER TABLE c RENAME TO b")


def test_words_within_quotes(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY)")
    db.execute("INSERT INTO t VALUES (1), (2)")
    assert db.execute("SELECT 'x LIMIT 0 VERSION() information_schema.tables' AS v").first()["v"] == "x LIMIT 0 VERSION() information_schema.tables"
    assert db.execute("SELECT id FROM t ORDER BY id FOR UPDATE").count() == 2
    assert db.execute("SELECT VERSION() AS v").first()["v"].startswith("quillon")


def test_recursive_terms(db):
    good = "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT MAX(n) AS n FROM r"
    assert db.execute(good).first()["n"] == 5
    for bad in ("SELECT a.n + 1 FROM r a JOIN r b ON a.n = b.n", "SELECT n + 1 FROM (SELECT 1 AS n) x WHERE n IN (SELECT n FROM r)", "SELECT 2"):
        with pytest.raises(Unsupported):
            db.execute(f"WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL {bad}) SELECT n FROM r")


def test_shows_and_databases(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, a DATE)")
    db.execute("CREATE VIEW v AS SELECT id FROM t")
    db.execute("CREATE DATABASE IF NOT EXISTS other_one")
    assert "other_one" in [r[0] for r in db.execute("SHOW DATABASES").collect()]
    db.execute("USE other_one")
    assert db.database == "other_one"
    db.execute("DROP DATABASE other_one")
    with pytest.raises(Unsupported):
        db.execute("USE other_one")
    assert rows(db.execute("SHOW STATS")) == [("t", 1, 2, 0)]
    assert rows(db.execute("SHOW COLUMNS FROM t")) == [("a", "date"), ("id", "bigint")]
    assert rows(db.execute("SELECT table_name FROM information_schema.views")) == [("v",)]
    assert "default" in [r[0] for r in db.execute("SELECT schema_name FROM information_schema.schemata").collect()]


def test_refused_drop_keeps_the_view(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY)")
    db.execute("CREATE MATERIALIZED VIEW m AS SELECT id FROM t")
    db.execute("CREATE MATERIALIZED VIEW n AS SELECT id FROM m")
    with pytest.raises(ValueError, match="depends"):
        db.execute("DROP MATERIALIZED VIEW m")
    assert set(db.matviews) == {"m", "n"}
    db.execute("DROP MATERIALIZED VIEW n")
    db.execute("DROP MATERIALIZED VIEW m")
    db.execute("DROP MATERIALIZED VIEW IF EXISTS m")


# --- the store --------------------------------------------------------------------------


def test_a_failing_statement_leaves_nothing(spark, tmp_path):
    t = VersionedTable.create(spark.createDataFrame([(1, 2)], "id long, n long"), f"{tmp_path}/t", ["id"])
    with pytest.raises(Exception, match="stop"):
        t.update(F.col("id") > 0, {"n": F.expr("CAST(raise_error('stop') AS BIGINT)")})
    assert t.version() == 1 and rows(t.read()) == [(1, 2)] and t.changes().count() == 1


def test_two_writers(spark, tmp_path):
    t = VersionedTable.create(spark.createDataFrame([(1, 0)], "id long, n long"), f"{tmp_path}/t", ["id"])
    other = VersionedTable(spark, t.path)
    frame = spark.createDataFrame([(2, 0)], "id long, n long")
    t.insert(frame)
    with pytest.raises(Conflict, match="another"):  # it began from version 1
        other._commit(1, spark.createDataFrame([(3, 0)], "id long, n long"), None)
    assert rows(t.read()) == rows(other.read()) == [(1, 0), (2, 0)] and t.changes().count() == 2


def test_layers(spark, tmp_path):
    t = VersionedTable.create(spark.range(50).selectExpr("id", "id % 5 AS n"), f"{tmp_path}/t", ["id"])
    want = {i: i % 5 for i in range(50)}
    for k in range(12):  # beyond the layers after which one is written
        t.update(F.expr(f"id % 12 = {k}"), {"n": F.expr("n + 10")})
        want |= {i: want[i] + 10 for i in want if i % 12 == k}
    assert dict(rows(t.read())) == want and dict(rows(t.read(1))) == {i: i % 5 for i in range(50)}
    t.vacuum(2)
    assert dict(rows(t.read())) == want and t.changes().count() == 100 and len(t.versions()) == 2


def test_null_keys_and_renamed_keys(spark, tmp_path):
    t = VersionedTable.create(spark.createDataFrame([(1, "a")], "id long, x string"), f"{tmp_path}/t", ["id"])
    with pytest.raises(Conflict, match="null"):
        t.insert(spark.createDataFrame([(None, "b")], "id long, x string"))
    t.alter(lambda df: df.withColumnRenamed("id", "number"), {"id": "number"})
    t.insert(spark.createDataFrame([(2, "b")], "number long, x string"))
    assert t.key == ["number"] and rows(t.read()) == [(1, "a"), (2, "b")]
    assert [tuple(r) for r in t.changes().filter("lsn > 1").select("lsn", "op", "number").orderBy("lsn").collect()] == [(2, "PUT", 1), (3, "PUT", 2)]


def test_a_restore_reaches_the_feed(spark, tmp_path):
    t = VersionedTable.create(spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"), f"{tmp_path}/t", ["id"])
    t.backup(f"{tmp_path}/b")
    t.delete(F.col("id") == 1)
    t.insert(spark.createDataFrame([(3, "c")], "id long, x string"))
    t.restore(f"{tmp_path}/b")
    assert rows(t.read()) == [(1, "a"), (2, "b")]
    assert rows(t.changes().filter("lsn = 4").select("op", "id")) == [("DELETE", 3), ("PUT", 1)]
