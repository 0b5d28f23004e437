"""Queries over tables that are made of the driver's files, with the same in SQL.

Each makes a table in a new warehouse, in commits that a predicate deals out, and reads it by the feature that
it stands for.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.statistics import column_statistics
from ..functions.values import bucket, partition_value, with_time_partitions
from ..operators import predicate as P
from ..operators.predicate import PartitionPredicate as PP
from ..operators.transaction import TransactionManager
from ..sources.exchange import export_files, import_files
from ..streaming.source import register_source
from ..streaming.tables import follow, sink
from ..table import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared}/lake-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="lake-")


def _catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, _folder(spark))


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _table(spark: SparkSession, rows: DataFrame, name: str, key=(), parted=(), options=None, commits: tuple[str, ...] = ("true",), sequence: str | None = None) -> Table:
    """A table of rows, in a commit for each condition."""
    t = _catalog(spark).create_table(name, rows.schema, key, parted, options)
    for c in commits:
        t.write(rows.where(c), sequence=sequence)
    return t


def _thirds(column: str) -> tuple[str, ...]:
    return tuple(f"{column} % 3 = {k}" for k in range(3))


def _events(spark: SparkSession, sf_dir: str, **options) -> Table:
    return _table(spark, _source(spark, sf_dir, "events"), "events", ["user_id"], commits=_thirds("event_id"), sequence="event_id", **options)


_LATEST = "select {columns} from (select *, row_number() over (partition by user_id order by event_id % 3 desc, event_id desc) as place from events) where place = 1"
_EVENT = "event_id, ts, user_id, event_type, value, props"


def latest_orders_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _source(spark, sf_dir, "orders")
    t = _table(spark, orders, "orders", ["o_custkey"], commits=_thirds("o_orderkey"), sequence="o_orderkey")
    both = t.read().join(_source(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    """select c_mktsegment, count(*) as customers, round(sum(o_totalprice), 2) as total
    from (select *, row_number() over (partition by o_custkey order by o_orderkey % 3 desc, o_orderkey desc) as place from orders) join customer on o_custkey = c_custkey
    where place = 1 group by c_mktsegment"""
)
def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_orders_by_segment(spark, sf_dir)


@query(_LATEST.format(columns=_EVENT))
def pk_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).read()


@query(f"select {_EVENT} from (select *, row_number() over (partition by user_id order by event_id desc) as place from events) where place = 1")
def pk_batch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, _source(spark, sf_dir, "events"), "events", ["user_id"], sequence="event_id").read()


@query("select * from lineitem")
def append_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, _source(spark, sf_dir, "lineitem"), "lineitem", commits=_thirds("l_orderkey")).read()


@query(_LATEST.format(columns=_EVENT) + " and event_type = 'error'")
def pk_filter_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).read(predicate=P.eq("event_type", "error"))


def _orders(spark: SparkSession, sf_dir: str, **options) -> Table:
    return _table(spark, _source(spark, sf_dir, "orders"), "orders", ["o_orderkey"], commits=_thirds("o_orderkey"), sequence="o_orderkey", **options)


@query("select * from orders where o_orderkey = 77")
def pk_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).get(77)


@query("select * from orders where o_orderkey between 100 and 300")
def pk_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).read_key_range([100], [300])


@query("select l_orderkey, l_linenumber, min(l_quantity) as q from lineitem where (l_orderkey > 10 or l_orderkey = 10 and l_linenumber >= 3) and (l_orderkey < 20 or l_orderkey = 20 and l_linenumber <= 2) group by all")
def pk_composite_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    return _table(spark, rows, "lines", ["l_orderkey", "l_linenumber"]).read_key_range([10, 3], [20, 2])


_GRADED = "(select d.doc_id, lang, source, quality from documents d left join labels l on d.doc_id = l.doc_id)"


def _graded(spark: SparkSession, sf_dir: str) -> Table:
    rows = _source(spark, sf_dir, "documents").join(_source(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "source", "quality")
    return _table(spark, rows, "graded", options={"file.index.all": "min-max"}, commits=("doc_id % 2 = 0", "doc_id % 2 = 1"))


for _name, _make, _sql in (
    ("pred_eq", lambda: P.eq("quality", 1), "coalesce(quality = 1, false)"),
    ("pred_ne_null", lambda: P.ne("quality", 1), "coalesce(quality <> 1, true)"),
    ("pred_gt", lambda: P.gt("quality", 0), "coalesce(quality > 0, false)"),
    ("pred_ge", lambda: P.ge("doc_id", 50), "doc_id >= 50"),
    ("pred_lt", lambda: P.lt("doc_id", 50), "doc_id < 50"),
    ("pred_le", lambda: P.le("quality", 0), "coalesce(quality <= 0, false)"),
    ("pred_null_literal", lambda: P.ne("quality", None) & P.lt("doc_id", 20), "doc_id < 20"),
    ("pred_and_or", lambda: (P.eq("lang", "en") & P.ne("quality", 0)) | P.eq("source", "src3"), "(lang = 'en' and coalesce(quality <> 0, true)) or source = 'src3'"),
    ("pred_not", lambda: ~(P.eq("lang", "en") | P.gt("quality", 0)), "not (lang = 'en' or coalesce(quality > 0, false))"),
    ("pred_in_with_null", lambda: P.is_in("quality", [0, None]), "coalesce(quality in (0), false) or quality is null"),
    ("pred_is_null", lambda: P.is_null("quality"), "quality is null"),
):
    def _run(spark: SparkSession, sf_dir: str, make=_make) -> DataFrame:
        return _graded(spark, sf_dir).read(predicate=make())

    QUERIES[_name] = _run
    ORACLE_SQL[_name] = f"select * from {_GRADED} where {_sql}"


@query("select c_mktsegment, c_custkey, c_mktsegment as segment from customer")
def projection_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, _source(spark, sf_dir, "customer"), "customer", ["c_custkey"])
    return t.read(["c_mktsegment", "c_custkey", "c_mktsegment"]).toDF("c_mktsegment", "c_custkey", "segment")


def _nations(spark: SparkSession, sf_dir: str) -> Catalog:
    c = _catalog(spark)
    c.sql("CREATE TABLE nations (k INT NOT NULL, name VARCHAR(25), region INTEGER) -- keyed by k")
    c.table("nations").write(_source(spark, sf_dir, "nation").toDF("k", "name", "region"))
    return c


_NATIONS = "(select n_nationkey as k, n_name as name, n_regionkey as region from nation)"


@query(f"select name, k + 1 as next from {_NATIONS} where region > 1 and not (k = 7)")
def sql_select_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).sql("SELECT n.name, n.k + 1 AS next FROM default.nations n WHERE n.region > 1 AND NOT (n.k = 7)")


@query(f"select * from {_NATIONS} where k <> 3 union all select 3, 'three', null union all select 100, null, 4")
def sql_insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    c.sql("INSERT INTO nations (k, name) VALUES (3, 'zero'), (3, 'three')")
    c.sql("INSERT INTO nations (region, k) VALUES (4, 100)")
    return c.sql("SELECT * FROM nations")


@query(f"select * from {_NATIONS} where not (region = 2 and k > 8)")
def sql_delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    c.sql("DELETE FROM nations WHERE region = 2 AND k > 8")
    return c.sql("SELECT * FROM nations")


@query(f"select * from {_NATIONS} where false")
def sql_delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    c.sql("DELETE FROM nations")
    return c.sql("SELECT * FROM nations")


@query(f"select k, case when k < 5 then upper(name) || '!' else name end as name, region from {_NATIONS}")
def sql_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _nations(spark, sf_dir)
    c.sql("UPDATE nations SET name = concat(upper(name), '!') WHERE k < 5")
    return c.sql("SELECT * FROM nations")


@query(f"with big as (select region, count(*) as n from {_NATIONS} group by region) select a.name, b.n from {_NATIONS} a join big b on a.region = b.region where a.k in (select max(k) from {_NATIONS})")
def sql_join_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "WITH big AS (SELECT region, count(*) AS n FROM nations GROUP BY region) SELECT nations.name, b.n FROM nations JOIN big b ON nations.region = b.region WHERE nations.k IN (SELECT max(k) FROM default.nations)"
    return _nations(spark, sf_dir).sql(text)


@query("select * from orders where o_orderkey % 3 <= 0")
def time_travel_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).read(snapshot=1)


@query("select * from orders where o_orderkey % 3 <= 1")
def time_travel_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    return t.catalog.sql("SELECT * FROM orders VERSION AS OF 2")


@query("select * from orders where o_orderkey % 3 in (1, 2)")
def incremental_1_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).read_incremental(1, 3)


def _dated(spark: SparkSession, sf_dir: str) -> Table:
    rows = with_time_partitions(_source(spark, sf_dir, "events"), "ts", "dt", "hour")
    return _table(spark, rows, "dated", parted=["dt", "hour"])


_DATED = "(select *, strftime(ts, '%Y-%m-%d') as dt, strftime(ts, '%H') as hour from events)"
for _name, _make, _sql in (
    ("part_equal", lambda: PP.equal("hour", "07"), "hour = '07'"),
    ("part_in", lambda: PP.is_in("hour", ["01", "23"]), "hour in ('01', '23')"),
    ("part_range", lambda: PP.greater("hour", "05") & PP.at_most("hour", "08"), "hour > '05' and hour <= '08'"),
    ("part_between", lambda: PP.between("hour", "10", "12"), "hour between '10' and '12'"),
    ("part_prefix", lambda: PP.prefix("hour", "1"), "hour like '1%'"),
    ("part_not", lambda: ~PP.equal("hour", "07"), "hour <> '07'"),
    ("part_and_or", lambda: (PP.less("hour", "03") | PP.at_least("hour", "22")) & PP.always(True), "hour < '03' or hour >= '22'"),
):
    def _run(spark: SparkSession, sf_dir: str, make=_make) -> DataFrame:
        return _dated(spark, sf_dir).read(partition=make())

    QUERIES[_name] = _run
    ORACLE_SQL[_name] = f"select * from {_DATED} where {_sql}"


@query("select event_id, strftime(ts, '%Y-%m-%d') as date, strftime(ts, '%H') as hour, coalesce(event_type, 'null') as kind from events")
def dynamic_partition_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "events").select("event_id", F.col("ts").alias("date"), F.col("ts").alias("hour"), F.col("event_type").alias("kind"))
    return rows.select("event_id", *[partition_value(rows, c).alias(c) for c in ("date", "hour", "kind")])


@query(f"select distinct dt, hour from {_DATED} where dt >= '2024'")
def list_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).partitions(PP.at_least("dt", "2024")).select("dt", "hour")


@query(f"select dt, hour, count(*) as rows from {_DATED} group by dt, hour")
def partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).partitions().select("dt", "hour", "rows")


@query(f"select * from {_DATED} where hour <> '07'")
def drop_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _dated(spark, sf_dir)
    t.drop_partition({"hour": "07"})
    return t.read()


@query(f"select * from {_DATED} where hour <> '07' or dt < '2024'")
def delete_partition_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _dated(spark, sf_dir)
    t.delete(P.eq("hour", "07") & P.ge("dt", "2024"))
    return t.read()


@query(f"select * from {_DATED} where hour <> '07' union all select * from {_DATED} where hour = '07' and value > 50")
def overwrite_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _dated(spark, sf_dir)
    t.overwrite(t.read(predicate=P.gt("value", 50.0)), partition={"hour": "07"})
    return t.read()


def _lines(spark: SparkSession, sf_dir: str, **options: str) -> Table:
    return _table(spark, _source(spark, sf_dir, "lineitem"), "lines", options={"cluster-by": "l_shipdate", **options})


@query("select * from lineitem where l_shipdate < timestamp '1996-01-01' and l_quantity > 10")
def minmax_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    t = _lines(spark, sf_dir, **{"index.l_shipdate.type": "min_max"})
    return t.read(predicate=P.lt("l_shipdate", datetime.datetime(1996, 1, 1)) & P.gt("l_quantity", 10.0))


@query("select * from lineitem where l_partkey = 55")
def bloom_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, **{"file.index.l_partkey.bloom-filter": "true"}).read(predicate=P.eq("l_partkey", 55))


@query("select * from lineitem where l_returnflag = 'R' and l_linestatus <> 'O'")
def bitmap_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _lines(spark, sf_dir, **{"index.l_returnflag.type": "bitmap", "index.l_linestatus.type": "bitmap"})
    return t.read(predicate=P.eq("l_returnflag", "R") & P.ne("l_linestatus", "O"))


@query(
    """select 'o_orderkey' as "column", min(o_orderkey)::varchar as least, max(o_orderkey)::varchar as most, count(*) - count(o_orderkey) as nulls, count(distinct o_orderkey) as "distinct", count(*) as rows from orders
    union all select 'o_orderstatus', min(o_orderstatus), max(o_orderstatus), count(*) - count(o_orderstatus), count(distinct o_orderstatus), count(*) from orders
    union all select 'o_orderpriority', min(o_orderpriority), max(o_orderpriority), count(*) - count(o_orderpriority), count(distinct o_orderpriority), count(*) from orders"""
)
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_statistics(_orders(spark, sf_dir).read(["o_orderkey", "o_orderstatus", "o_orderpriority"]), exact=True)


@query(_LATEST.format(columns=_EVENT))
def compact_preserves(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _events(spark, sf_dir)
    t.compact(full=True)
    return t.read()


@query("select * from orders where o_orderstatus = 'F'")
def overwrite_replaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    t.overwrite(t.read(predicate=P.eq("o_orderstatus", "F")))
    return t.read()


@query("select * from region")
def many_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "region").coalesce(1)
    return _table(spark, rows, "region", ["r_regionkey"], commits=tuple(f"r_regionkey = {k % 5} or {k} = 0" for k in range(35))).read()


def _customers(spark: SparkSession, sf_dir: str) -> Table:
    return _table(spark, _source(spark, sf_dir, "customer"), "customer", ["c_custkey"])


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, null::varchar as c_note from customer")
def schema_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _customers(spark, sf_dir)
    t.add_column("c_note", "STRING")
    return t.read()


@query("select c_custkey, c_name, c_nationkey, c_mktsegment from customer")
def schema_drop_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _customers(spark, sf_dir)
    t.drop_column("c_acctbal")
    return t.read()


@query("select c_custkey, c_name as title, c_nationkey, c_acctbal, c_mktsegment from customer where c_name > 'Customer#000000050'")
def schema_rename_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _customers(spark, sf_dir)
    t.rename_column("c_name", "title")
    return t.read(predicate=P.gt("title", "Customer#000000050"))


@query("select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer")
def schema_widen_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _customers(spark, sf_dir)
    t.widen_column("c_nationkey", "BIGINT")
    return t.read()


def _branched(spark: SparkSession, sf_dir: str) -> Catalog:
    c = _nations(spark, sf_dir)
    c.sql("CALL sys.create_branch('default.nations', 'dev')")
    c.sql("INSERT INTO `nations$branch_dev` VALUES (200, 'dev', 1), (0, 'changed', 0)")
    return c


@query(f"select * from {_NATIONS}")
def branch_isolation_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _branched(spark, sf_dir).sql("SELECT * FROM nations")


@query(f"select * from {_NATIONS} where k <> 0 union all select 200, 'dev', 1 union all select 0, 'changed', 0")
def branch_isolation_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _branched(spark, sf_dir).sql("SELECT * FROM `nations$branch_dev`")


@query(f"select * from {_NATIONS} where k <> 0 union all select 200, 'dev', 1 union all select 0, 'changed', 0")
def branch_fast_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _branched(spark, sf_dir)
    c.fast_forward("nations", "dev")
    return c.read("nations")


@query("select 1::bigint as snapshot_id, 'APPEND' as kind, count(*) filter (o_orderkey % 3 = 0) as delta_rows, count(*) filter (o_orderkey % 3 = 0) as total_rows from orders union all select 2, 'APPEND', count(*) filter (o_orderkey % 3 = 1), count(*) filter (o_orderkey % 3 <= 1) from orders union all select 3, 'APPEND', count(*) filter (o_orderkey % 3 = 2), count(*) from orders")
def snapshot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).snapshots().select("snapshot_id", "kind", "delta_rows", "total_rows")


@query("select count(*) as n from orders")
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, _source(spark, sf_dir, "orders"), "orders", commits=_thirds("o_orderkey"))
    return spark.createDataFrame([(t.count(),)], "n long")


@query(_LATEST.format(columns=_EVENT) + " and event_type <> 'error'")
def upsert_with_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "events")
    t = _catalog(spark).create_table("events", rows.schema, ["user_id"])
    for c in _thirds("event_id"):
        t.write(rows.where(c).withColumn("_op", F.when(F.col("event_type") == "error", "D").otherwise("U")), sequence="event_id")
    return t.read()


@query("select o_orderkey, o_custkey, case when o_orderkey % 10 = 0 then 'M' else o_orderstatus end as o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 10 <> 1")
def merge_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "orders")
    t = _table(spark, rows.where("o_orderkey % 4 <> 0"), "orders", ["o_orderkey"])
    source = rows.where("o_orderkey % 10 in (0, 1) or o_orderkey % 4 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "M").otherwise(F.col("o_orderstatus")))
    t.merge(source, ["o_orderkey"])
    t.delete("o_orderkey % 10 = 1")
    return t.read()


@query("select c_name, count(*) as orders, round(sum(o_totalprice), 2) as total from customer join orders on c_custkey = o_custkey group by c_name")
def join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _customers(spark, sf_dir).read().join(_orders(spark, sf_dir).read(), F.col("c_custkey") == F.col("o_custkey"))
    return both.groupBy("c_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select o_orderpriority, round(avg(o_totalprice), 4) as mean from orders group by o_orderpriority")
def group_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).read().groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(f"select dt, count(distinct user_id) as users, count(*) as n from {_DATED} group by dt")
def count_distinct_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).read().groupBy("dt").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def order_desc_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).read(["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("select (('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 8)::int as bucket, count(*) as n from orders group by 1")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).read().groupBy(bucket(["o_orderkey"], 8).alias("bucket")).agg(F.count("*").alias("n"))


@query("select * from orders")
def incremental_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = _orders(spark, sf_dir), _catalog(spark)
    copy = c.create_table("copy", t.schema.struct, ["o_orderkey"])
    follow(t, lambda rows, n: copy.write(rows, user="follow", identifier=n))
    return copy.read()


def _streamed(reader: DataFrame, put, folder: str) -> None:
    q = reader.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    q.awaitTermination()


@query("select r_regionkey, r_name from region")
def stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, _source(spark, sf_dir, "region"), "region", commits=_thirds("r_regionkey"))
    register_source(spark)
    copy = _catalog(spark).create_table("copy", t.schema.struct)
    _streamed(spark.readStream.format("lake").option("path", t.root).load(), sink(copy, "copy"), _folder(spark))
    return copy.read()


@query(f"select {_EVENT} from (select *, row_number() over (partition by user_id order by event_id desc) as place from events) where place = 1")
def stream_sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "events")
    t = _catalog(spark).create_table("events", rows.schema, ["user_id"])
    _streamed(spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*"), sink(t, "events", sequence="event_id"), _folder(spark))
    return t.read()


@query("select * from orders where o_orderkey % 3 <= 1")
def transaction_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "orders")
    t = _table(spark, rows.where("o_orderkey % 3 = 0"), "orders", ["o_orderkey"])
    m = TransactionManager(t)
    one, two = m.begin(), m.begin()
    one.write(rows.where("o_orderkey % 3 = 1"))
    two.write(rows.where("o_orderkey % 3 = 2"))
    one.commit()
    two.abort()
    return t.read()


@query("select * from orders where o_orderkey % 3 = 0")
def rollback_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    t.rollback(1)
    return t.read()


@query("select * from customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, folder = _customers(spark, sf_dir), _folder(spark)
    export_files(t, f"{folder}/csv", "csv")
    copy = _catalog(spark).create_table("copy", t.schema.struct, ["c_custkey"])
    import_files(copy, f"{folder}/csv", "csv")
    return copy.read()


@query("select * from orders where o_totalprice > 1000")
def expire_keeps_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    t.delete(P.le("o_totalprice", 1000.0))
    t.compact(full=True)
    t.expire(keep=1)
    return t.read()


from . import features  # noqa: E402, F401  (registers its queries)
