from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillon.plans.engine import Engine, Unsupported, split_top
from quillon.sources.store import Conflict


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.execute("CREATE TABLE users (id INT PRIMARY KEY, name TEXT, age INT)")
    e.execute("INSERT INTO users VALUES (1, 'alice', 30), (2, 'bob', 25), (3, 'carol', 35)")
    return e


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_insert_select_update_delete(engine):
    engine.execute("INSERT INTO users (id, name) VALUES (4, 'dan')")
    assert rows(engine.execute("SELECT id, age FROM users WHERE id >= 3")) == [(3, 35), (4, 0)]
    engine.execute("UPDATE users SET age = age + 1, name = CONCAT(name, age) WHERE id = 3")
    assert rows(engine.execute("SELECT name, age FROM users WHERE id = 3")) == [("carol36", 36)]
    engine.execute("DELETE FROM users WHERE age IN (SELECT MAX(age) FROM users)")
    assert engine.execute("SELECT id FROM users").count() == 3
    with pytest.raises(Conflict):
        engine.execute("INSERT INTO users VALUES (1, 'again', 1)")


def test_upsert_and_replace(engine):
    engine.execute("INSERT INTO users VALUES (2, 'bobby', 26), (9, 'new', 1) ON DUPLICATE KEY UPDATE age = VALUES(age) + 100")
    assert rows(engine.execute("SELECT id, name, age FROM users WHERE id IN (2, 9)")) == [(2, "bob", 126), (9, "new", 1)]
    engine.execute("REPLACE INTO users VALUES (2, 'r', 1)")
    assert rows(engine.execute("SELECT name FROM users WHERE id = 2")) == [("r",)]


def test_variables_and_prepared_statements(engine):
    engine.execute("SET @limit = 26")
    assert rows(engine.execute("SELECT name FROM users WHERE age > @limit AND name <> '@limit'")) == [("alice",), ("carol",)]
    engine.execute("PREPARE p FROM 'SELECT name FROM users WHERE age = ? OR name = ?'")
    engine.execute("SET @name = 'bob'")
    engine.execute("SET @age = 35")
    assert rows(engine.execute("EXECUTE p USING @age, @name")) == [("bob",), ("carol",)]
    with pytest.raises(Unsupported):
        engine.execute("SELECT @unset")
    assert engine.execute("SELECT id FROM users ORDER BY id LIMIT 0").count() == 3


def test_views_and_materialised_views(engine):
    engine.execute("CREATE VIEW old AS SELECT id, name FROM users WHERE age > 28")
    assert engine.execute("SELECT * FROM old").count() == 2
    engine.execute("CREATE MATERIALIZED VIEW m AS SELECT id, name FROM users WHERE age > 28")
    engine.execute("UPDATE users SET name = 'z' WHERE id = 1")
    assert rows(engine.execute("SELECT name FROM m WHERE id = 1")) == [("alice",)]
    engine.execute("REFRESH MATERIALIZED VIEW m")
    assert rows(engine.execute("SELECT name FROM m WHERE id = 1")) == [("z",)]
    assert engine.matviews["m"].refresh() == "skipped"


def test_changes_through_views(engine):
    engine.execute("CREATE VIEW old AS SELECT id, name, age FROM users WHERE age > 28 WITH CHECK OPTION")
    engine.execute("UPDATE old SET name = 'o' WHERE id > 1")
    assert rows(engine.execute("SELECT id FROM users WHERE name = 'o'")) == [(3,)]
    engine.execute("INSERT INTO old VALUES (7, 'g', 99)")
    with pytest.raises(Exception, match="outside"):
        engine.execute("INSERT INTO old VALUES (8, 'h', 1)")
    with pytest.raises(Conflict):
        engine.execute("UPDATE old SET age = 2")
    engine.execute("DELETE FROM old")
    assert rows(engine.execute("SELECT id FROM users")) == [(2,)]


def test_alter_and_catalogue(engine):
    engine.execute("ALTER TABLE users ADD COLUMN city TEXT")
    engine.execute("ALTER TABLE users RENAME COLUMN name TO title")
    engine.execute("ALTER TABLE users MODIFY COLUMN age TEXT")
    engine.execute("ALTER TABLE users DROP COLUMN city")
    assert rows(engine.execute("SELECT column_name, data_type FROM information_schema.columns")) == [("age", "string"), ("id", "bigint"), ("title", "string")]
    assert rows(engine.execute("SHOW TABLES")) == [("users",)]
    assert engine.execute("EXPLAIN SELECT * FROM users").count() > 1


def test_files_and_backups(engine, tmp_path):
    engine.execute(f"EXPORT TABLE users TO '{tmp_path}/csv' FORMAT CSV")
    engine.execute(f"BACKUP TABLE users TO '{tmp_path}/b'")
    engine.execute("DELETE FROM users WHERE id < 3")
    engine.execute(f"IMPORT INTO users FROM '{tmp_path}/csv'")
    assert engine.execute("SELECT id FROM users").count() == 3
    engine.execute("DELETE FROM users")
    engine.execute(f"RESTORE TABLE users FROM '{tmp_path}/b'")
    assert engine.execute("SELECT id FROM users").count() == 3
    assert Engine(engine.spark, engine.root).execute("SELECT id FROM users").count() == 3


def test_procedures_and_triggers(engine):
    engine.procedure("older", lambda e, years: e.execute(f"UPDATE users SET age = age + {years}") or 7)
    engine.execute("SET @out = 5")
    engine.execute("CALL older(@out)")
    assert engine.variables["out"] == 7 and rows(engine.execute("SELECT MIN(age) FROM users")) == [(30,)]
    seen = []
    engine.trigger("BEFORE", "INSERT", "users", lambda r: r.withColumn("name", F.upper("name")))
    engine.trigger("AFTER", "INSERT", "users", lambda r: seen.extend(x["name"] for x in r.collect()))
    engine.execute("INSERT INTO users VALUES (8, 'eve', 1)")
    assert seen == ["EVE"]


def test_json_functions(engine):
    got = engine.execute("""SELECT JSON_EXTRACT('{"b":[1,2.50],"a":"x"}', '$.b[1]') AS a, JSON_EXTRACT('{"a":"x"}', '$.a') AS b, JSON_UNQUOTE('"x"') AS c, JSON_VALID('{') AS d, JSON_TYPE('[1]') AS e, JSON_LENGTH('[1,2]') AS f, JSON_SET('{"z":1,"a":2}', '$.z', 'y') AS g""").first()
    assert tuple(got) == ("2.50", '"x"', "x", 0, "ARRAY", 2, '{"z": "y", "a": 2}')


def test_rejected_mixes(engine):
    for text in (
        "SELECT SUM(age) AS s, ROW_NUMBER() OVER (ORDER BY id) AS n FROM users",
        "SELECT name FROM users GROUP BY name HAVING ROW_NUMBER() OVER (ORDER BY name) > 1",
        "SELECT SUM(age) OVER (ORDER BY id, age RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM users",
    ):
        with pytest.raises(AnalysisException):
            engine.execute(text).collect()


def test_values_of_other_types(engine):
    engine.execute("INSERT INTO users VALUES ('7', 8, '9')")
    assert rows(engine.execute("SELECT * FROM users WHERE id = 7")) == [(7, "8", 9)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        engine.execute("INSERT INTO users VALUES (8, 'x', 'nine')")
    assert engine.execute("SELECT * FROM users").count() == 4


def test_batches_and_cache(engine):
    found = engine.batch(["SELECT COUNT(*) AS n FROM users", "SELECT MAX(age) AS n FROM users"])
    assert [r[0]["n"] for r in found] == [3, 35]
    with pytest.raises(Unsupported):
        engine.batch(["DELETE FROM users"])
    engine.execute("SET query_cache = on")
    first = engine.execute("SELECT  id FROM users")
    assert engine.execute("SELECT id   FROM users") is first and first.count() == 3
    engine.execute("DELETE FROM users WHERE id = 1")
    assert engine.execute("SELECT id FROM users").count() == 2


def test_rejects(engine):
    for text in ("CREATE TABLE t (a DOUBLE)", "GRANT ALL", "CALL nothing()", "UPDATE missing SET a = 1", "SHOW NONSENSE"):
        with pytest.raises(Unsupported):
            engine.execute(text)
    assert split_top("a, f(b, c), 'd,e'") == ["a", "f(b, c)", "'d,e'"]
