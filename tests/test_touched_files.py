"""How many files queries read and changes rewrite; and what logs and streams tell."""

import threading

import pytest
from lakespark.errors import CommitConflict, LakeError, Unsupported
from lakespark.functions.values import bucket, bucket_of
from lakespark.metadata.store import HadoopStore
from lakespark.operators import predicate as P
from lakespark.operators.background import Compactor
from lakespark.operators.transaction import Isolation, Session
from lakespark.streaming.source import LakeSource, register_source
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In


def five(catalog, spark, name="t", key=(), **options):
    """Five files of ten rows, in a commit each."""
    t = catalog.create_table(name, "id int, dt string, v double", key, ["dt"] if not key else [], {"file.index.all": "min-max", **options})
    for k in range(5):
        t.write(spark.range(k * 10, k * 10 + 10).selectExpr("cast(id as int) id", f"'{k}' dt", "id * 1.5 v").coalesce(1))
    return t


def rewritten(t):
    kinds = [k for k, _ in t.log.entries(t.log.latest().delta)]
    return kinds.count("DELETE"), kinds.count("ADD")


def test_sql_reads_the_files_that_a_plan_names(catalog, spark):
    t = five(catalog, spark)
    for text, predicate, rows in (
        ("SELECT * FROM t WHERE id = 12", P.eq("id", 12), 1),
        ("SELECT * FROM t WHERE dt = '3'", P.eq("dt", "3"), 10),
        ("SELECT * FROM t WHERE id IN (3, 44)", P.is_in("id", [3, 44]), 2),
        ("SELECT * FROM t WHERE id = 3 OR v > 70", P.eq("id", 3) | P.gt("v", 70.0), 4),
        ("WITH q AS (SELECT * FROM t WHERE id < 5) SELECT * FROM q", P.lt("id", 5), 5),
        ("SELECT a.* FROM t a JOIN t b ON a.id = b.id WHERE a.id = 12", P.eq("id", 12), 1),
        ("SELECT x.id FROM (SELECT id + 0 AS i, id, dt FROM t) x WHERE x.dt >= '4'", P.ge("dt", "4"), 10),
        ("SELECT * FROM t WHERE abs(id) = 12", None, 1),
    ):
        got = catalog.sql(text)
        assert len(got.inputFiles()) == len(t.plan(predicate)) and got.count() == rows, text
    assert len(catalog.sql("SELECT * FROM t VERSION AS OF 2 WHERE id > 15").inputFiles()) == 1


def test_a_newer_version_of_a_row_is_never_pruned(catalog, spark):
    t = five(catalog, spark, key=["id"])
    t.write(spark.sql("select 12 id, 'new' dt, 1000.0D v"))
    assert catalog.sql("SELECT * FROM t WHERE v < 100 AND id = 12").count() == 0
    assert catalog.sql("SELECT dt FROM t WHERE id = 12").first().dt == "new"
    assert len(catalog.sql("SELECT * FROM t WHERE id = 44").inputFiles()) == 1


def test_changes_rewrite_only_what_they_must(catalog, spark):
    t = five(catalog, spark)
    catalog.sql("DELETE FROM t WHERE id = 12")
    assert rewritten(t) == (1, 1) and t.count() == 49
    catalog.sql("DELETE FROM t WHERE dt = '3'")
    assert rewritten(t) == (1, 0) and t.count() == 39  # by metadata alone
    t.delete(F.col("dt").isin("4") & (F.col("dt") < "5"))
    assert rewritten(t) == (1, 0) and t.count() == 29
    catalog.sql("UPDATE t SET v = 0 WHERE id BETWEEN 21 AND 22")
    assert rewritten(t) == (1, 1) and catalog.sql("SELECT count(*) n FROM t WHERE v = 0 AND id > 0").first().n == 2
    t.merge(spark.sql("select 5 id, -1.0D v"), ["id"], insert=False)
    assert rewritten(t) == (1, 1) and t.read(predicate=P.eq("id", 5)).first().v == -1
    catalog.sql("MERGE INTO t USING (SELECT 99 AS id, 'x' AS dt) s ON t.id = s.id WHEN NOT MATCHED THEN INSERT (id, dt) VALUES (s.id, s.dt)")
    assert rewritten(t) == (0, 1) and t.count() == 30
    keyed = five(catalog, spark, "k", ["id"])
    catalog.sql("DELETE FROM k WHERE id = 12")
    assert rewritten(keyed) == (1, 1)


def test_merge_on_the_key_writes_versions(catalog, spark):
    t = five(catalog, spark, key=["id"])
    catalog.sql(
        """MERGE INTO t USING (SELECT explode(array(3, 4, 77)) AS id) s ON t.id = s.id
        WHEN MATCHED AND s.id = 3 THEN DELETE WHEN MATCHED THEN UPDATE SET v = -1 WHEN NOT MATCHED THEN INSERT (id, dt, v) VALUES (s.id, 'new', 0)"""
    )
    assert rewritten(t)[0] == 0 and t.log.latest().kind == "APPEND"
    assert sorted((r.id, r.v) for r in t.read().where("id < 6 or id > 48").collect()) == [(0, 0.0), (1, 1.5), (2, 3.0), (4, -1.0), (5, 7.5), (49, 73.5), (77, 0.0)]
    assert t.count() == 50
    with pytest.raises(LakeError):
        t.merge(spark.sql("select explode(array(5, 5)) id"), ["id"])
    # rows that came meanwhile are a conflict
    once = t.log.commit

    def beside(*args, **kwargs):
        t.log.commit = once
        t.write(spark.sql("select 5 id, 'mine' dt, 0.0D v"))
        return once(*args, **kwargs)

    held = t.log
    held.commit = beside
    with pytest.raises(CommitConflict):
        t.merge(spark.sql("select 5 id, 2.0D v"), ["id"])


def test_buckets(catalog, spark):
    t = catalog.create_table("b", "id bigint, name string", ["id"], options={"bucket": "4"})
    for k in range(3):
        t.write(spark.range(40).selectExpr("id", f"'v{k}' name"))
    assert {f.buckets for f in t.plan()} == {4} and {f.bucket for f in t.plan()} <= set(range(4))
    assert t.read().count() == 40 and {r.name for r in t.read().collect()} == {"v2"}
    one = t.plan(P.eq("id", 7))
    assert {f.bucket for f in one} == {bucket_of([7], 4)} and t.get(7).first().name == "v2"
    assert len(catalog.sql("SELECT * FROM b WHERE id = 7").inputFiles()) == len(one) < len(t.plan())
    rows = spark.createDataFrame([(1, "a"), (2, "é"), (-5, "")], "i int, s string")
    assert [r.n for r in rows.select(bucket(["i", "s"], 7).alias("n")).collect()] == [bucket_of(list(r), 7) for r in rows.collect()]
    assert bucket_of([1.5], 4) is None
    bag = catalog.create_table("bag", "id int, s string", options={"bucket": "3", "bucket-key": "s"})
    bag.write(spark.range(30).selectExpr("cast(id as int) id", "concat('s', id % 5) s"))
    assert bag.read(predicate=P.eq("s", "s1")).count() == 6 and len(bag.plan(P.eq("s", "s1"))) == 1
    t.compact(full=True)
    assert t.read().count() == 40


def test_streams_tell_deletions(catalog, spark, tmp_path):
    t = catalog.create_table("s", "id int", ["id"])
    t.write(spark.sql("select explode(array(1, 2)) id"))
    t.write(spark.sql("select 1 id, 'D' _op"))
    register_source(spark)
    seen = []

    def run(name, **options):
        reader = spark.readStream.format("lake").option("path", t.root)
        for k, v in options.items():
            reader = reader.option(k, v)
        q = reader.load().writeStream.foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="deletes rows"):
        run("plain")
    run("changes", changes="true")
    assert sorted(seen) == [(1, "D"), (1, "I"), (2, "I")]


def test_rollback_and_fast_forward_are_overwrites(catalog, spark):
    t = five(catalog, spark, key=["id"])
    t.add_column("note", "string")
    made = t.rollback(2)
    assert made.kind == "OVERWRITE" and made.schema_id == t.schema.id == 1 and t.count() == 20
    with pytest.raises(Unsupported):
        t.read_incremental(0)
    t.write(spark.sql("select 3 id, 'later' dt, 0.0D v, 'n' note"))
    assert t.get(3).first().note == "n" and t.count() == 20
    catalog.create_branch("t", "dev")
    catalog.table("t$branch_dev").write(spark.sql("select 500 id, 'x' dt, 0.0D v, 'n' note"))
    catalog.fast_forward("t", "dev")
    assert t.log.latest().kind == "OVERWRITE" and t.count() == 21


def test_hadoop_store_creates_once_and_whole(spark, tmp_path):
    store, won = HadoopStore(spark), []
    path = f"file://{tmp_path}/log/snapshot-1"

    def claim(k):
        if store.create(path, f"{k}" * 10_000):
            won.append(k)

    threads = [threading.Thread(target=claim, args=(k,)) for k in range(6)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert len(won) == 1 and store.read(path) == f"{won[0]}" * 10_000
    assert store.names(f"file://{tmp_path}/log") == ["snapshot-1"] and set(store.times(f"file://{tmp_path}/log")) == {"snapshot-1"}


def test_orphans_among_data_files(catalog, spark):
    t = five(catalog, spark, key=["id"])
    catalog.create_branch("t", "dev")
    catalog.table("t$branch_dev").write(spark.sql("select 500 id, 'x' dt, 0.0D v"))
    w = t.prepare(spark.sql("select 600 id, 'x' dt, 0.0D v"))  # its writer dies
    assert t.remove_orphans(older_than=3600) == []
    assert t.remove_orphans() == [w.added[0].path]
    assert t.count() == 50 and catalog.table("t$branch_dev").read().count() == 51


def test_isolation_and_sessions(catalog, spark):
    t = five(catalog, spark, key=["id"])
    with Session(Isolation.SERIALIZABLE) as s:
        a = s.begin(t)
        with pytest.raises(LakeError):
            s.begin(t)
        a.read().count()
        a.write(spark.sql("select 900 id, 'x' dt, 0.0D v"))
        t.write(spark.sql("select 901 id, 'x' dt, 0.0D v"))
        with pytest.raises(CommitConflict):
            a.commit()
        b = s.begin(t)
        b.write(spark.sql("select 902 id, 'x' dt, 0.0D v"))
        b.commit()
    with Session(Isolation.READ_COMMITTED) as s:
        c = s.begin(t)
        t.write(spark.sql("select 903 id, 'x' dt, 0.0D v"))
        assert c.read().count() == 53
    assert c.state.value == "ABORTED"


def test_compaction_beside_writes(catalog, spark):
    t = five(catalog, spark, key=["id"])
    with Compactor() as c:
        first = c.submit(t, full=True)
        t.write(spark.sql("select 5 id, 'beside' dt, 0.0D v"))
        first.result()
        c.submit(t, full=True).result()
    assert c.counts["failed"] == 0 and t.get(5).first().dt == "beside" and t.count() == 50


def test_spark_reader(catalog, spark):
    t = five(catalog, spark, **{"cluster-by": "id"})
    register_source(spark)
    read = spark.read.format("lake").option("path", t.root)
    assert read.load().count() == 50 and read.load().where("id = 12").count() == 1 and read.option("snapshot", 2).load().count() == 20
    from pyspark.sql.types import StructType

    def files(*filters):
        reader = LakeSource({"path": t.root}).reader(StructType())
        reader.pushFilters(list(filters))
        return len(reader.partitions())

    assert files() == 5 and files(EqualTo(("id",), 12)) == 1 and files(GreaterThan(("id",), 35)) == 2 and files(In(("id",), (3, 14))) == 2 and files(EqualTo(("dt",), "4")) == 1
    keyed = five(catalog, spark, "k", ["id"])
    with pytest.raises(Exception, match="merged"):
        spark.read.format("lake").option("path", keyed.root).load().count()
    keyed.compact(full=True)
    assert spark.read.format("lake").option("path", keyed.root).load().count() == 50


def test_sets_of_values_are_bounded(catalog, spark):
    t = catalog.create_table("v", "many int, few int", options={"index.many.type": "bitmap", "index.few.type": "bitmap"})
    t.write(spark.range(5000).selectExpr("cast(id as int) many", "cast(id % 7 as int) few").coalesce(1))
    (f,) = t.plan()
    assert set(f.values) == {str(t.schema["few"].id)} and f.values[str(t.schema["few"].id)] == list(range(7))
