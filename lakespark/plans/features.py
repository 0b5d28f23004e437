"""More queries over tables: SQL text, what host SQL adds, maintenance, metadata, streams of changes, and defined failures."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, load_catalog
from ..errors import BranchExists, CommitConflict, DatabaseExists, LakeError, SchemaError, SnapshotMissing, TableExists, TableMissing, Unsupported
from ..functions.values import bucket
from ..operators import predicate as P
from ..operators.background import Compactor
from ..operators.transaction import Isolation, Session
from ..streaming.source import register_source
from ..streaming.tables import sink
from ..table import Table
from .queries import _NATIONS, _catalog, _customers, _dated, _folder, _lines, _nations, _orders, _source, _streamed, _table, _thirds, query

# SQL text whose filters choose files


def _line_catalog(spark: SparkSession, sf_dir: str, **options: str) -> Catalog:
    return _lines(spark, sf_dir, **options).catalog


@query("select * from lineitem where l_shipdate < timestamp '1996-01-01' and l_quantity > 10")
def sql_minmax_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_catalog(spark, sf_dir, **{"index.l_shipdate.type": "min_max"}).sql("SELECT * FROM lines WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 10")


@query("select l_orderkey, l_partkey from lineitem where l_partkey = 55")
def sql_bloom_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_catalog(spark, sf_dir, **{"file.index.l_partkey.bloom-filter": "true"}).sql("SELECT l_orderkey, l_partkey FROM lines WHERE l_partkey = 55")


@query("select event_id, strftime(ts, '%H') as hour from events where strftime(ts, '%H') = '07'")
def sql_part_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).catalog.sql("SELECT event_id, hour FROM dated WHERE hour = '07'")


@query("select * from lineitem where l_returnflag in ('A', 'N') and (l_linestatus = 'O' or l_quantity < 5)")
def sql_bitmap_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _line_catalog(spark, sf_dir, **{"index.l_returnflag.type": "bitmap", "index.l_linestatus.type": "bitmap"})
    return c.sql("SELECT * FROM lines WHERE l_returnflag IN ('A', 'N') AND (l_linestatus = 'O' OR l_quantity < 5)")


@query("select c_custkey, c_acctbal from customer where c_acctbal > c_nationkey * 300 and c_custkey <> c_nationkey")
def sql_column_against_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).catalog.sql("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > c_nationkey * 300 AND c_custkey <> c_nationkey")


@query("select event_id, strftime(ts, '%H') as hour from events where strftime(ts, '%H') <> '07'")
def sql_delete_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _dated(spark, sf_dir).catalog
    c.sql("DELETE FROM dated WHERE hour = '07'")
    return c.sql("SELECT event_id, hour FROM dated")


@query(f"select * from {_NATIONS} where region not in (select r_regionkey from region where r_name like 'A%')")
def sql_delete_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    rows = _source(spark, sf_dir, "region")
    c.create_table("regions", rows.schema).write(rows)
    c.sql("DELETE FROM nations WHERE region IN (SELECT r_regionkey FROM regions WHERE r_name LIKE 'A%')")
    return c.sql("SELECT * FROM nations")


@query(f"select k, case when k < 5 then 'new' when k = 7 then null else name end as name, region from {_NATIONS} where k not in (8, 9) union all select 300, 'added', 3")
def sql_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    c.sql(
        """MERGE INTO nations n USING (SELECT k, CASE WHEN k < 5 THEN 'new' WHEN k IN (8, 9) THEN 'gone' END AS name FROM nations WHERE k < 10 AND k NOT IN (5, 6)
        UNION ALL SELECT 300, 'added') AS s ON n.k = s.k
        WHEN MATCHED AND s.name = 'gone' THEN DELETE WHEN MATCHED THEN UPDATE SET name = s.name WHEN NOT MATCHED THEN INSERT (k, name, region) VALUES (s.k, s.name, 3)"""
    )
    return c.sql("SELECT * FROM nations")


@query(f"select k, case when k >= 10 then 'old' else name end as name, region from {_NATIONS} where k < 20")
def sql_merge_not_matched_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    c.sql("MERGE INTO nations n USING (SELECT * FROM nations WHERE k < 10) AS s ON n.k = s.k WHEN NOT MATCHED BY SOURCE AND n.k >= 20 THEN DELETE WHEN NOT MATCHED BY SOURCE THEN UPDATE SET name = 'old'")
    return c.sql("SELECT * FROM nations")


@query("select o_orderkey, case when o_orderkey in (64, 65) then -1.0 else o_totalprice end as o_totalprice from orders")
def merge_small_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    t.merge(t.read(predicate=P.is_in("o_orderkey", [64, 65])).withColumn("o_totalprice", F.lit(-1.0)), ["o_orderkey"], insert=False)
    return t.read(["o_orderkey", "o_totalprice"])


@query("select l_orderkey, l_linenumber, case when l_orderkey = 7 then 0.0 else l_quantity end as l_quantity from lineitem")
def merge_append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _lines(spark, sf_dir)
    t.merge(spark.createDataFrame([(7, 0.0)], "l_orderkey long, l_quantity double"), ["l_orderkey"], insert=False)
    return t.read(["l_orderkey", "l_linenumber", "l_quantity"])


# statements


@query("select 'nations' as name")
def sql_drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    c.sql("CREATE TABLE gone (a INT)")
    c.sql("DROP TABLE gone")
    c.sql("DROP TABLE IF EXISTS gone")
    return c.sql("SHOW TABLES")


@query("select 'default' as name union all select 'other'")
def sql_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    for text in ("CREATE DATABASE other", "CREATE DATABASE IF NOT EXISTS other", "CREATE DATABASE third", "DROP DATABASE third"):
        c.sql(text)
    return c.sql("SHOW DATABASES")


@query("select * from (values ('k', 'int', false, true), ('name', 'string', true, false), ('region', 'int', true, false)) as t(name, type, nullable, primary_key)")
def sql_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).sql("DESCRIBE nations").select("name", "type", "nullable", "primary_key")


@query(f"select k, name as title, region::bigint as region, case when k = 500 then 'x' end as note from (select * from {_NATIONS} union all select 500, 'late', 1)")
def sql_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    for text in ("ADD COLUMN note STRING", "RENAME COLUMN name TO title", "ALTER COLUMN region TYPE BIGINT", "ADD COLUMN spare INT", "DROP COLUMN spare"):
        c.sql(f"ALTER TABLE nations {text}")
    c.sql("INSERT INTO nations (k, title, region, note) VALUES (500, 'late', 1, 'x')")
    return c.sql("SELECT * FROM nations")


@query(f"select name from {_NATIONS} where k = 3")
def sql_comments_and_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).sql("/* all of */ select name -- the name; not the key\n  FROM nations\nwhere K = 3 ;\n  ")


@query(f"select * from {_NATIONS} where k < 3 and false union all select 1, 'a; --b', null")
def sql_truncate_and_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    c.sql("TRUNCATE TABLE nations")
    c.sql("INSERT INTO nations VALUES (1, 'a; --b', NULL);")
    return c.sql("SELECT * FROM nations")


@query(f"select * from {_NATIONS} where region = 1")
def sql_insert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    c.sql("INSERT OVERWRITE nations SELECT * FROM nations WHERE region = 1")
    return c.sql("SELECT * FROM nations")


@query(f"select * from {_NATIONS}")
def sql_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    c.sql("CALL sys.create_tag('default.nations', 'first')")
    c.sql("INSERT INTO nations VALUES (1, 'changed', 0)")
    c.sql("CALL sys.compact('default.nations')")
    c.sql("CALL sys.rollback('default.nations', 1)")
    c.sql("CALL sys.expire_snapshots('default.nations', 2)")
    return c.sql("SELECT * FROM nations")


@query(f"select upper(substr(name, 1, 3)) as head, coalesce(region, -1) + 1 as next, length(name)::int as size from {_NATIONS} where name is not null")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).sql("SELECT upper(substr(name, 1, 3)) AS head, coalesce(region, -1) + 1 AS next, char_length(name) AS size FROM nations WHERE name IS NOT NULL")


@query(f"select k, (k * k + 1)::bigint as square from {_NATIONS}")
def sql_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def square(x):
        return x.astype("int64") ** 2

    square.__annotations__ = {"x": pd.Series, "return": pd.Series}
    spark.udf.register("square_of", F.pandas_udf(square, "long"))
    return _nations(spark, sf_dir).sql("SELECT k, square_of(k) + 1 AS square FROM nations")


# joins, sets, windows and orders


def _both(spark: SparkSession, sf_dir: str) -> Catalog:
    c = _nations(spark, sf_dir)
    rows = _source(spark, sf_dir, "customer")
    c.create_table("customers", rows.schema, ["c_custkey"]).write(rows)
    return c


for _name, _sql in (
    ("sql_left_join", "select n.k, count(c.c_custkey) as customers from {n} n left join {c} c on n.k = c.c_nationkey and c.c_acctbal > 9000 group by n.k"),
    ("sql_full_join", "select n.k, c.c_custkey from (select * from {n} where k < 12) n full outer join (select * from {c} where c_nationkey > 8) c on n.k = c.c_nationkey"),
    ("sql_semi_anti_join", "select k from {n} n where exists (select 1 from {c} c where c.c_nationkey = n.k and c.c_acctbal > 9500) and not exists (select 1 from {c} c where c.c_nationkey = n.k and c.c_acctbal < -900)"),
    ("sql_range_join", "select a.c_custkey, count(*) as n from {c} a join {n} b on a.c_acctbal between b.k * 100 and b.k * 200 group by a.c_custkey"),
    ("sql_lookup_join", "select c.c_name, n.name from {c} c join {n} n on n.k = c.c_nationkey where c.c_custkey in (3, 5, 8)"),
    ("sql_rollup", "select region, k, count(*) as n from {n} group by rollup (region, k)"),
    ("sql_cube", "select c_mktsegment, c_nationkey, count(*) as n from {c} where c_nationkey < 4 group by cube (c_mktsegment, c_nationkey)"),
    ("sql_window", "select c_custkey, cast(rank() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as int) as place, count(*) over (partition by c_mktsegment) as peers from {c}"),
    ("sql_union", "select k from {n} where region = 1 union select c_nationkey from {c} where c_acctbal > 9900"),
    ("sql_union_all", "select k from {n} where region = 1 union all select k from {n} where k < 3"),
    ("sql_intersect", "select k from {n} intersect select c_nationkey from {c} where c_acctbal > 9000"),
    ("sql_except", "select k from {n} except select c_nationkey from {c} where c_acctbal > 9000"),
    ("sql_order_by_key", "select k, name from {n} order by k limit 7"),
    ("sql_offset", "select c_custkey from {c} order by c_acctbal desc, c_custkey limit 5 offset 10"),
    ("sql_having", "select region, max(name) as last from {n} group by region having count(*) > 4"),
    ("sql_distinct", "select distinct c_mktsegment, c_nationkey from {c}"),
    ("sql_scalar_subquery", "select k, (select max(c_acctbal) from {c}) as most from {n} where region = (select min(region) from {n})"),
):
    def _run(spark: SparkSession, sf_dir: str, text=_sql) -> DataFrame:
        return _both(spark, sf_dir).sql(text.format(n="nations", c="customers"))

    _run.__name__ = _name
    query(_sql.format(n=_NATIONS, c="customer"))(_run)


# files, maintenance, metadata


@query("select (count(*) + 999) // 1000 as files, least(count(*), 1000) as most from orders")
def rolling_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, _source(spark, sf_dir, "orders").coalesce(1), "orders", options={"target-file-rows": "1000"})
    return t.files().agg(F.count("*").alias("files"), F.max("rows").alias("most"))


@query("select count(*) as rows, 3::bigint as commits, min(o_orderkey)::varchar as least, max(o_orderkey)::varchar as most from orders")
def files_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _orders(spark, sf_dir).catalog
    return c.sql("SELECT sum(rows) AS rows, count(DISTINCT sequence) AS commits, cast(min(cast(least['o_orderkey'] AS long)) AS string) AS least, cast(max(cast(most['o_orderkey'] AS long)) AS string) AS most FROM `orders$files`")


@query("select * from (values (0, 'k', 'int', true), (0, 'name', 'string', false), (0, 'region', 'int', false), (1, 'k', 'int', true), (1, 'name', 'string', false), (1, 'region', 'int', false), (1, 'note', 'string', false)) as t(schema_id, name, type, primary_key)")
def schemas_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    c.sql("ALTER TABLE nations ADD COLUMN note STRING")
    return c.sql("SELECT schema_id, name, type, primary_key FROM `nations$schemas`")


@query("select sum(o_totalprice)::decimal(18, 2) as total, count(*) as n from orders")
def row_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, n = 0, 0
    for r in _orders(spark, sf_dir).rows(columns=["o_totalprice"]):
        total, n = total + round(r.o_totalprice * 100), n + 1
    return spark.createDataFrame([(total, n)], "cents long, n long").select((F.col("cents") / 100).cast("decimal(18,2)").alias("total"), "n")


@query("select ('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 8 as bucket, count(*) as n from orders group by 1")
def bucket_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the bucket that their file's folder tells."""
    t = _orders(spark, sf_dir, options={"bucket": "8"})
    told = spark.createDataFrame([(f.path, f.bucket, f.rows) for f in t.plan()], "path string, bucket long, rows long")
    return told.groupBy("bucket").agg(F.sum("rows").alias("n"))


@query("select * from orders where o_orderkey = 77")
def bucket_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, options={"bucket": "8"}).get(77)


@query("select o_orderkey, o_totalprice from orders")
def compact_in_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    with Compactor() as c:
        c.submit(t, full=True)
        c.wait()
    return t.read(["o_orderkey", "o_totalprice"])


@query("select * from orders where o_orderkey % 3 = 0")
def tag_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    t.create_tag("first", 1)
    return t.read(snapshot=t.tags()["first"])


@query("select count(*) as n, 2 as removed from orders")
def orphans_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    t.store.write(f"{t.root}/_staging/broken/part-0", "x")
    t.store.write(f"{t.root}/data/lost.parquet", "x")
    gone = t.remove_orphans()
    return t.read().agg(F.count("*").alias("n")).withColumn("removed", F.lit(len(gone)))


@query("select * from region")
def duplicate_commit_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "region")
    t = _catalog(spark).create_table("region", rows.schema)
    for _ in range(3):
        t.write(rows, user="job", identifier=7)
    return t.read()


@query("select * from region")
def catalog_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, _source(spark, sf_dir, "region"), "region", ["r_regionkey"], commits=_thirds("r_regionkey"))
    return load_catalog(spark, t.catalog.warehouse, "filesystem").sql("SELECT * FROM default.region")


@query("select 'least' as what, min(o_orderkey)::varchar as value from orders union all select 'rows', count(*)::varchar from orders")
def analyze_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    t = _orders(spark, sf_dir)
    t.analyze()
    told = json.loads(t.log.latest().properties["statistics"])["o_orderkey"]
    return spark.createDataFrame([("least", told["least"]), ("rows", str(told["rows"]))], "what string, value string")


@query("select 1704067200000::bigint as watermark, count(*) as n from region")
def watermark_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "region")
    t = _catalog(spark).create_table("region", rows.schema)
    sink(t, "q", watermark=lambda _: 1704067200000)(rows, 0)
    return t.snapshots().join(t.read().agg(F.count("*").alias("n"))).select("watermark", "n")


# branches, transactions, failures


@query("select 'kept' as branch")
def branch_drop_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    for b in ("kept", "gone"):
        c.sql(f"CALL sys.create_branch('default.nations', '{b}')")
    c.sql("CALL sys.drop_branch('default.nations', 'gone')")
    return c.sql("CALL sys.list_branches('default.nations')")


@query("select * from orders where o_orderkey % 3 <= 1")
def transaction_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A serializable transaction that read before others wrote must not commit; one that reads what is committed sees it."""
    rows = _source(spark, sf_dir, "orders")
    t = _table(spark, rows.where("o_orderkey % 3 = 0"), "orders", ["o_orderkey"])
    with Session(Isolation.SERIALIZABLE) as one, Session(Isolation.READ_COMMITTED) as two:
        a, b = one.begin(t), two.begin(t)
        a.read().count()
        t.write(rows.where("o_orderkey % 3 = 1"))
        a.write(rows.where("o_orderkey % 3 = 2"))
        seen = b.read()
        try:
            a.commit()
        except CommitConflict:
            return seen
    raise AssertionError("the transaction was committed")


def _kind(run) -> str:
    try:
        run()
    except Exception as e:
        return type(e).__name__
    return "none"


@query("select 'OVERWRITE' as kind, 'Unsupported' as error, count(*) as n from orders where o_orderkey % 3 = 0")
def rollback_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollback is an overwrite: rows between snapshots can't be told across it."""
    t = _orders(spark, sf_dir)
    made = t.rollback(1)
    return t.read().agg(F.lit(made.kind).alias("kind"), F.lit(_kind(lambda: t.read_incremental(0, made.id))).alias("error"), F.count("*").alias("n"))


@query(
    """select * from (values ('table exists', 'TableExists'), ('no table', 'TableMissing'), ('database exists', 'DatabaseExists'), ('no snapshot', 'SnapshotMissing'), ('branch exists', 'BranchExists'),
    ('unknown field', 'SchemaError'), ('deletions without a key', 'Unsupported'), ('lost files', 'CommitConflict')) as t("case", error)"""
)
def defined_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    t: Table = c.table("nations")
    c.create_branch("nations", "dev")
    bag = c.create_table("bag", "a int")
    bag.write(spark.range(3).selectExpr("cast(id as int) a"))
    files = bag.plan()
    bag.delete()
    cases = (
        ("table exists", TableExists, lambda: c.create_table("nations", "a int")), ("no table", TableMissing, lambda: c.table("none")), ("database exists", DatabaseExists, lambda: c.create_database("default")),
        ("no snapshot", SnapshotMissing, lambda: t.read(snapshot=99)), ("branch exists", BranchExists, lambda: c.create_branch("nations", "dev")), ("unknown field", SchemaError, lambda: t.read(["nothing"])),
        ("deletions without a key", Unsupported, lambda: bag.write(spark.range(1).selectExpr("cast(id as int) a", "'D' as _op"))), ("lost files", CommitConflict, lambda: bag.log.commit([], files, "OVERWRITE")),
    )
    assert all(issubclass(kind, LakeError) for _, kind, _ in cases)
    return spark.createDataFrame([(name, _kind(run)) for name, _, run in cases], "case string, error string")


# streams


@query("select r_regionkey, r_name, 'I' as _op from region union all select r_regionkey, r_name, 'D' from region where r_regionkey < 2")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "region").select("r_regionkey", "r_name")
    t = _table(spark, rows, "region", ["r_regionkey"])
    t.write(rows.where("r_regionkey < 2").withColumn("_op", F.lit("D")))
    register_source(spark)
    copy = _catalog(spark).create_table("copy", "r_regionkey int, r_name string, op string")
    changes = spark.readStream.format("lake").option("path", t.root).option("changes", "true").load().withColumnRenamed("_op", "op")
    _streamed(changes, sink(copy, "copy"), _folder(spark))
    return copy.read().withColumnRenamed("op", "_op")


@query("select r_regionkey, r_name from region")
def stream_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "region").select("r_regionkey", "r_name")
    t = _table(spark, rows, "region", options={"file.format": "orc"}, commits=_thirds("r_regionkey"))
    register_source(spark)
    copy = _catalog(spark).create_table("copy", t.schema.struct)
    _streamed(spark.readStream.format("lake").option("path", t.root).load(), sink(copy, "copy"), _folder(spark))
    return copy.read()


@query("select event_type, time_bucket(interval 1 day, ts) as day, count(*) as n from events group by all")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts, kept up to date by micro-batches that update a primary-key table."""
    rows = _source(spark, sf_dir, "events")
    t = _catalog(spark).create_table("daily", "event_type string, day timestamp_ntz, n long", ["event_type", "day"])
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    daily = stream.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count("*").alias("n"))
    daily = daily.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n")
    q = daily.writeStream.outputMode("update").foreachBatch(sink(t, "daily")).option("checkpointLocation", f"{_folder(spark)}/daily").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.read()


@query("select o_orderkey, o_custkey from orders where o_orderkey between 100 and 200")
def spark_read_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a catalog, by Spark's reader; the filter chooses files."""
    t = _table(spark, _source(spark, sf_dir, "orders"), "orders", options={"cluster-by": "o_orderkey"}, commits=_thirds("o_orderkey"))
    register_source(spark)
    return spark.read.format("lake").option("path", t.root).load().where("o_orderkey >= 100 and o_orderkey <= 200").select("o_orderkey", "o_custkey")


@query("select * from orders where o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1998-02-01'")
def orc_table_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, _source(spark, sf_dir, "orders"), "orders", options={"file.format": "orc", "cluster-by": "o_orderdate"})
    return t.read(predicate=P.ge("o_orderdate", datetime.datetime(1998, 1, 1)) & P.lt("o_orderdate", datetime.datetime(1998, 2, 1)))


@query("select ('0x' || substr(md5(o_custkey::varchar || chr(1) || o_orderstatus), 1, 8))::bigint % 5 as bucket, count(*) as n from orders group by 1")
def bucket_of_two_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "orders")
    return rows.groupBy(bucket(["o_custkey", "o_orderstatus"], 5).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
