"""Statements as text."""

import pytest

from lakespark import errors


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def sql(catalog):
    catalog.sql("CREATE TABLE users (id INT NOT NULL, name VARCHAR(20), age INTEGER) /* keyed */ TBLPROPERTIES ('index.name.type'='bloom_filter');")
    catalog.sql("INSERT INTO users VALUES (1,'Alice',25),(2,'Bob',30),(3,'Charlie',35),(4,'David',28),(5,'Eve',22)")
    return catalog.sql


def test_create_and_keys(catalog, sql):
    s = catalog.table("users").schema
    assert s.primary_key == ("id",) and [f.type for f in s.fields] == ["int", "string", "int"] and s.options == {"index.name.type": "bloom_filter"}
    sql("CREATE TABLE users (other INT)")  # is there already
    assert catalog.table("users").schema.names == ["id", "name", "age"]
    sql("create table if not exists p (a int not null, b string not null, c float, d bool, e text, dt string) partitioned by (dt) tblproperties ('primary-key'='a')")
    s = catalog.table("p").schema
    assert (s.primary_key, s.partition_keys, s["c"].type, s["e"].type) == (("a",), ("dt",), "double", "string")
    assert rows(sql("DESCRIBE p"))[0] == ("a", "int", False, True, False) and rows(sql("SHOW TABLES")) == [("p",), ("users",)]
    sql("DROP TABLE p")
    sql("DROP TABLE IF EXISTS p")
    with pytest.raises(errors.TableMissing):
        sql("DROP TABLE p")


def test_select(sql):
    assert rows(sql("SELECT id FROM users WHERE age > 25")) == [(2,), (3,), (4,)]
    assert rows(sql("SELECT name, id + 1 AS n FROM default.users u WHERE id > 1 AND id < 3 -- one")) == [("Bob", 3)]
    assert rows(sql("SELECT count(*) FROM users WHERE NOT (age <= 30 OR name LIKE 'C%')")) == [(0,)]
    assert rows(sql("SELECT users.name FROM users JOIN users b ON users.id = b.id + 4")) == [("Eve",)]
    assert rows(sql("SELECT 'from users' AS t, max(age) FROM users WHERE id IN (SELECT id FROM users WHERE age < 30)")) == [("from users", 28)]
    assert rows(sql("WITH users AS (SELECT 7 AS id) SELECT * FROM users")) == [(7,)]
    assert rows(sql("SELECT * FROM (VALUES (1), (2)) v(x) ORDER BY x")) == [(1,), (2,)]
    with pytest.raises(Exception):
        sql("SELECT none FROM users")
    with pytest.raises(Exception):
        sql("SELEC 1")


def test_insert_update_delete(sql):
    sql("INSERT INTO users (id, name) VALUES (5, 'Eve1'), (6, NULL)")
    assert rows(sql("SELECT * FROM users WHERE id >= 5")) == [(5, "Eve1", None), (6, None, None)]
    sql("INSERT INTO users SELECT id + 10, name, age FROM users WHERE id <= 2")
    assert rows(sql("SELECT id FROM users WHERE id > 10")) == [(11,), (12,)]
    sql("UPDATE users SET age = age * 2, name = 'x;--y' WHERE id = 1")
    assert rows(sql("SELECT * FROM users WHERE id = 1")) == [(1, "x;--y", 50)]
    sql("DELETE FROM users WHERE age > 29")
    assert rows(sql("SELECT id FROM users")) == [(11,), (4,), (5,), (6,)]  # null is not above
    sql("INSERT OVERWRITE users VALUES (9, 'nine', -9)")
    assert rows(sql("SELECT * FROM users")) == [(9, "nine", -9)]
    sql("DELETE FROM users")
    assert rows(sql("SELECT * FROM users")) == []
    with pytest.raises(errors.SchemaError):
        sql("INSERT INTO users (id, nothing) VALUES (1, 2)")


def test_time_travel_and_procedures(catalog, sql):
    sql("INSERT INTO users VALUES (9, 'nine', 9)")
    assert rows(sql("SELECT count(*) FROM users VERSION AS OF 1")) == [(5,)]
    assert rows(sql("SELECT u.id FROM users VERSION AS OF 2 AS u WHERE u.id = 9")) == [(9,)]
    sql("CALL sys.create_branch('default.users', 'b1')")
    sql("INSERT INTO `users$branch_b1` VALUES (10, 'ten', 10)")
    assert rows(sql("SELECT count(*) FROM users")) == [(6,)] and rows(sql("SELECT count(*) FROM `users$branch_b1`")) == [(7,)]
    assert rows(sql("CALL sys.list_branches('users')")) == [("b1",)]
    assert rows(sql("SELECT snapshot_id FROM `users$snapshots`")) == [(1,), (2,)]
    sql("CALL sys.compact('users')")
    sql("CALL sys.rollback('users', '1')")
    assert rows(sql("SELECT count(*) FROM users")) == [(5,)]
    sql("CALL sys.drop_branch('users', 'b1')")
    with pytest.raises(errors.Unsupported):
        sql("CALL sys.nothing('users')")


def test_alter(catalog, sql):
    sql("ALTER TABLE users ADD COLUMNS (email STRING, score INT AFTER id)")
    sql("ALTER TABLE users RENAME COLUMN name TO title")
    sql("ALTER TABLE users DROP COLUMN age")
    sql("ALTER TABLE users ALTER COLUMN score TYPE BIGINT")
    assert rows(sql("SELECT * FROM users WHERE id = 1")) == [(1, None, "Alice", None)]
    sql("ALTER TABLE users SET TBLPROPERTIES ('a'='b')")
    assert catalog.table("users").schema.options["a"] == "b"
    sql("ALTER TABLE users RENAME TO people")
    assert rows(sql("SELECT count(*) FROM people")) == [(5,)]


def test_databases(catalog, sql):
    sql("CREATE DATABASE IF NOT EXISTS shop")
    sql("USE shop")
    sql("CREATE TABLE sales (id BIGINT, amount DOUBLE, region STRING) PARTITIONED BY (region)")
    sql("INSERT INTO shop.sales VALUES (1, 1200.0, 'North'), (2, 75, 'South'), (3, 325, 'North')")
    assert rows(sql("SELECT region, sum(amount) FROM sales GROUP BY region")) == [("North", 1525.0), ("South", 75.0)]
    assert rows(sql("SELECT u.name FROM default.users u JOIN shop.sales s ON u.id = s.id")) == [("Alice",), ("Bob",), ("Charlie",)]
    sql("ALTER TABLE sales DROP PARTITION (region='North')")
    assert rows(sql("SHOW PARTITIONS sales"))[0][0] == "South"
    with pytest.raises(errors.DatabaseNotEmpty):
        sql("DROP DATABASE shop")
    sql("DROP DATABASE shop CASCADE")
    assert rows(sql("SHOW DATABASES")) == [("default",)]


def test_merge(catalog, sql):
    sql("CREATE TABLE news (id INT NOT NULL, name STRING, age INT)")
    sql("INSERT INTO news VALUES (1, 'A', 1), (2, 'gone', 2), (8, 'new', 8), (9, 'skipped', 9)")
    sql("MERGE INTO users USING news AS n ON users.id = n.id WHEN MATCHED AND n.name = 'gone' THEN DELETE WHEN MATCHED THEN UPDATE SET name = concat(users.name, n.name) WHEN NOT MATCHED AND n.id < 9 THEN INSERT *")
    assert rows(sql("SELECT * FROM users")) == [(1, "AliceA", 25), (3, "Charlie", 35), (4, "David", 28), (5, "Eve", 22), (8, "new", 8)]
    sql("MERGE INTO users u USING (SELECT id, name, 0 AS age FROM news WHERE id <> 2) s ON u.id = s.id WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT (id, name) VALUES (s.id, upper(s.name))")
    assert rows(sql("SELECT * FROM users WHERE id IN (1, 8, 9)")) == [(1, "A", 0), (8, "new", 0), (9, "SKIPPED", None)]
    with pytest.raises(errors.SchemaError):
        sql("MERGE INTO users u USING (SELECT 1 AS id UNION ALL SELECT 1) s ON u.id = s.id WHEN MATCHED THEN DELETE")
    sql("MERGE INTO users u USING (SELECT 1 AS id UNION ALL SELECT 1) s ON u.id = s.id WHEN MATCHED AND u.name = 'none' THEN DELETE")
    assert rows(sql("SELECT count(*), count(DISTINCT id) FROM users")) == [(6, 6)]
