"""Merging, writing, commits, time travel, indexes, evolution and branches."""

import datetime
import multiprocessing
import os

import pytest
from pyspark.sql import functions as F

from lakespark import errors
from lakespark.identifiers import Identifier
from lakespark.metadata.files import DataFile
from lakespark.metadata.log import APPEND, COMPACT, OVERWRITE, CommitOptions, Log
from lakespark.metadata.store import LocalStore
from lakespark.operators import predicate as P
from lakespark.operators.predicate import PartitionPredicate as PP
from lakespark.operators.read import sections
from lakespark.operators.transaction import TransactionManager


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def people(catalog, spark, **options):
    t = catalog.create_table("people", "id int, name string, age int", ["id"], options=options)
    t.write(spark.createDataFrame([(k, f"a{k}", 20 + k) for k in (1, 3, 5, 7, 9)], t.schema.struct))
    t.write(spark.createDataFrame([(k, f"b{k}", 20 + k) for k in (2, 4, 6, 8, 10)], t.schema.struct))
    t.write(spark.createDataFrame([(k, f"c{k}", 20 + k) for k in (1, 2, 3, 11, 12)], t.schema.struct))
    return t


def test_newest_file_wins(catalog, spark):
    t = people(catalog, spark)
    got = {r.id: r.name for r in t.read().collect()}
    assert sorted(got) == list(range(1, 13))
    assert [got[k] for k in (1, 2, 3)] == ["c1", "c2", "c3"] and got[5] == "a5" and got[10] == "b10"


def test_many_commits_read_by_join(catalog, spark):
    t = catalog.create_table("many", "id int, v int", ["id"])
    for n in range(35):
        t.write(spark.createDataFrame([(0, n), (n, n)] if n else [(0, 0)], "id int, v int").coalesce(1))
    assert {r.id: r.v for r in t.read().collect()} == {0: 34, **{n: n for n in range(1, 35)}}
    last = t.log.latest()
    assert last.id == 35 and len(last.manifests) < 35 and last.total_rows == 69
    assert t.read(snapshot=3).count() == 3


def test_last_row_of_batch_wins(catalog, spark):
    t = catalog.create_table("users", "id int, name string, age int", ["id"])
    t.write(spark.createDataFrame([(1, "Alice", 25), (5, "Eve", 22), (5, "Eve1", 23)], t.schema.struct).coalesce(1))
    assert rows(t.read()) == [(1, "Alice", 25), (5, "Eve1", 23)]
    t.write(spark.createDataFrame([(1, "old", 5), (1, "new", 9), (1, "older", 1)], t.schema.struct), sequence="age")
    assert rows(t.get(1)) == [(1, "new", 9)]


def test_append_only_keeps_duplicates(catalog, spark):
    t = catalog.create_table("events", "event_id bigint, kind string, user_id bigint", options={"file.index.all": "bloom-filter,min-max"})
    t.write(spark.createDataFrame([(1, "login", 100), (2, "click", 100), (3, "logout", 100)], t.schema.struct))
    t.write(spark.createDataFrame([(1, "login", 200), (4, "purchase", 200)], t.schema.struct))
    assert t.kind == "APPEND_ONLY" and t.read().count() == t.count() == 5
    assert t.read(predicate=P.eq("event_id", 2)).count() == 1


def test_filter_after_merge(catalog, spark):
    t = catalog.create_table("pk", "user_id bigint, age int, country string", ["user_id"], options={"index.age.type": "min_max", "index.country.type": "bitmap"})
    t.write(spark.createDataFrame([(1, 25, "USA"), (2, 30, "UK"), (3, 35, "USA"), (4, 28, "Canada"), (5, 32, "USA")], t.schema.struct))
    t.write(spark.createDataFrame([(1, 26, "USA")], t.schema.struct))
    assert t.read(predicate=P.eq("country", "USA") & P.gt("age", 25)).count() == 3
    assert t.read(predicate=P.eq("age", 25)).count() == 0  # only a stale version matches
    assert len(t.plan(P.eq("user_id", 4))) == 1  # key statistics do prune


def test_key_filter_reaches_scan_and_others_do_not(catalog, spark, capsys):
    t = people(catalog, spark)
    t.read().where("id = 3").explain()
    assert "PushedFilters: [IsNotNull(f0), EqualTo(f0,3)]" in capsys.readouterr().out
    t.read().where("age = 3").select("id").explain()
    out = capsys.readouterr().out
    assert "EqualTo(f2,3)" not in out and "f1" not in out  # no pushdown past the merge, and unused columns are not read


def test_disjoint_files_skip_the_merge(catalog, spark, capsys):
    t = catalog.create_table("wide", "id int, v int", ["id"])
    for n in range(3):
        t.write(spark.range(n * 100, n * 100 + 100).selectExpr("cast(id as int) id", f"{n} v").coalesce(1))
    assert not sections(t.plan(), t.schema)[1] and t.count() == 300
    t.read().explain()
    assert "Window" not in capsys.readouterr().out
    t.write(spark.createDataFrame([(150, 9)], "id int, v int"))
    alone, mixed = sections(t.plan(), t.schema)
    assert len(mixed) >= 2 and alone and {r.v for r in t.read().where("id = 150").collect()} == {9} and t.read().count() == 300


def test_null_key_and_unknown_field_fail(catalog, spark):
    t = catalog.create_table("k", "id int, v string", ["id"])
    with pytest.raises(Exception, match="NOT NULL"):
        t.write(spark.createDataFrame([(None, "x")], "id int, v string"))
    with pytest.raises(errors.SchemaError):
        t.write(spark.createDataFrame([(1, "x", 2)], "id int, v string, w int"))
    assert t.log.latest() is None and not t.store.names(f"{t.root}/data")


def test_tombstones_and_row_kinds(catalog, spark):
    t = catalog.create_table("cdc", "id int, v string", ["id"])
    t.write(spark.createDataFrame([(1, "a", "+I"), (2, "b", "I"), (3, "c", None)], "id int, v string, _op string"))
    t.write(spark.createDataFrame([(1, "a", "-U"), (1, "A", "+U"), (2, "b", "-D")], "id int, v string, _op string").coalesce(1))
    assert rows(t.read()) == [(1, "A"), (3, "c")]
    assert rows(t.read_incremental(1, changes=True)) == [(1, "A", "I"), (2, "b", "D")]
    t.compact(full=True)
    assert rows(t.read()) == [(1, "A"), (3, "c")] and t.count() == 2
    with pytest.raises(errors.Unsupported):
        catalog.create_table("a", "id int").write(spark.createDataFrame([(1, "D")], "id int, _op string"))


def test_overwrite_delete_and_counts(catalog, spark):
    t = people(catalog, spark)
    assert t.delete("id > 100") is not None or True
    t.delete(P.le("id", 3))
    assert sorted(r.id for r in t.read().collect()) == list(range(4, 13))
    t.delete()
    assert t.read().count() == t.count() == 0 and t.log.latest().kind == OVERWRITE
    t.write(spark.createDataFrame([(1, "x", 1)], t.schema.struct))
    t.overwrite(spark.createDataFrame([], t.schema.struct))
    assert t.count() == 0 and t.read(snapshot=1).count() == 5


def test_update_and_merge(catalog, spark):
    t = people(catalog, spark)
    t.update({"name": F.upper("name"), "age": 0}, "id in (1, 5)")
    assert {(r.id, r.name, r.age) for r in t.read().where("age = 0").collect()} == {(1, "C1", 0), (5, "A5", 0)}
    with pytest.raises(errors.SchemaError):
        t.update({"id": 3})
    source = spark.createDataFrame([(1, "m", 1), (50, "n", 50), (2, "gone", 0)], t.schema.struct)
    t.merge(source, ["id"], delete=F.col("s.name") == "gone")
    got = {r.id: r.name for r in t.read().collect()}
    assert got[1] == "m" and got[50] == "n" and 2 not in got and len(got) == 12


def test_time_travel_incremental_and_tags(catalog, spark):
    t = people(catalog, spark)
    assert t.read(snapshot=1).count() == 5 and t.read(snapshot=2).count() == 10
    assert sorted(r.id for r in t.read_incremental(1, 3).collect()) == [1, 2, 3, 4, 6, 8, 10, 11, 12]
    t.create_tag("first", 1)
    with pytest.raises(errors.SnapshotMissing):
        t.read(snapshot=9)
    assert t.read(as_of=t.log.snapshot(2).time_millis).count() in (10, 12)
    t.rollback(1)
    assert t.read().count() == 5
    t.delete("id = 1")
    with pytest.raises(errors.Unsupported):
        t.read_incremental(1)
    t.expire(keep=1)
    assert t.log.snapshot_ids() == [1, 5] and t.read(snapshot=1).count() == 5 and t.read().count() == 4


def test_compaction_keeps_rows_and_order(catalog, spark):
    t = people(catalog, spark)
    before = rows(t.read())
    assert t.needs_compaction(3) and not t.needs_compaction(9)
    made = t.compact(least=2)
    assert made.kind == COMPACT and rows(t.read()) == before and made.total_rows == 12
    t.write(spark.createDataFrame([(4, "z", 1)], t.schema.struct))
    assert {r.name for r in t.get(4).collect()} == {"z"}


def test_compaction_beside_a_write(catalog, spark):
    t = people(catalog, spark)
    prepared = t.prepare(spark.createDataFrame([(1, "later", 0)], t.schema.struct))
    t.compact(full=True)
    prepared.commit()
    assert {r.name for r in t.get(1).collect()} == {"later"}
    stale = t.log.latest()
    doomed = list(t.log.files(stale).values())
    t.compact(full=True)
    with pytest.raises(errors.CommitConflict):
        t.log.commit([], doomed, COMPACT, base=stale.id)


def test_two_phase(catalog, spark):
    t = catalog.create_table("two", "id int")
    w = t.prepare(spark.range(5).selectExpr("cast(id as int) id"))
    assert t.read().count() == 0
    w.commit()
    assert t.read().count() == 5
    with pytest.raises(errors.CommitConflict):
        w.commit()
    w = t.prepare(spark.range(5).selectExpr("cast(id as int) id"))
    w.abort()
    assert t.read().count() == 5 and len(t.store.sizes(f"{t.root}/data")) == len(t.plan()) + sum(n.endswith(".crc") for n in t.store.sizes(f"{t.root}/data"))


def _file(n, **more):
    return DataFile(path=f"data/{n}.parquet", rows=10, size=1, schema_id=0, **more)


def test_commit_protocol(tmp_path):
    log = Log(LocalStore(), str(tmp_path))
    assert log.commit([], user="u", identifier=1) is None  # empty: none
    one = log.commit([_file(1)], user="u", identifier=1)
    assert (one.id, one.kind, one.total_rows) == (1, APPEND, 10)
    assert log.commit([_file("again")], user="u", identifier=1).id == 1  # repeated
    two = log.commit([_file(2)], user="u", identifier=2)
    three = log.commit([_file(3)], list(log.files(two).values()), COMPACT, user="u", identifier=2)  # append and compact: two snapshots
    assert (three.id, three.total_rows, list(log.files(three))) == (3, 10, ["data/3.parquet"])
    assert log.commit([_file("late")], user="u", identifier=1).id == 1  # not only the latest is looked at
    with pytest.raises(errors.CommitConflict):
        log.commit([_file(3)])
    with pytest.raises(errors.CommitConflict):
        log.commit([], [_file(1)], OVERWRITE)
    with pytest.raises(errors.CommitConflict):
        log.commit([_file(9)], [], OVERWRITE, base=1)
    empty = log.commit([], lambda last: list(log.files(last).values()), OVERWRITE)
    assert empty.total_rows == 0 and not log.files(empty)
    for n in range(40):
        last = log.commit([_file(f"n{n}")])
    assert len(last.manifests) <= CommitOptions().base_every and len(log.files(last)) == 40


def _race(args):
    root, k = args
    log = Log(LocalStore(), root, CommitOptions(retries=400))
    return [log.commit([_file(f"{k}-{n}")], user=f"w{k}", identifier=n).id for n in range(10)]


def test_racing_writers(tmp_path):
    with multiprocessing.get_context("spawn").Pool(4) as pool:
        ids = [i for got in pool.map(_race, [(str(tmp_path), k) for k in range(4)]) for i in got]
    log = Log(LocalStore(), str(tmp_path))
    assert sorted(ids) == list(range(1, 41)) and len(log.files(log.latest())) == 40 and log.latest().total_rows == 400


def test_transactions(catalog, spark):
    t = people(catalog, spark)
    m = TransactionManager(t, most=2)
    one, two = m.begin(), m.begin()
    with pytest.raises(errors.LakeError):
        m.begin()
    one.write(spark.createDataFrame([(1, "one", 1)], t.schema.struct))
    two.write(spark.createDataFrame([(1, "two", 1)], t.schema.struct))
    one.commit()
    assert {r.name for r in two.read().where("id = 1").collect()} == {"c1"}  # its own snapshot
    with pytest.raises(errors.CommitConflict):
        two.commit()
    three = m.begin(read_only=True)
    with pytest.raises(errors.LakeError):
        three.write(t.read())
    three.abort()
    four, five = m.begin(), m.begin()
    four.write(spark.createDataFrame([(100, "x", 1)], t.schema.struct))
    five.write(spark.createDataFrame([(101, "y", 1)], t.schema.struct))
    four.commit(), five.commit()
    assert t.read().where("id >= 100").count() == 2 and m.statistics() == {"begun": 5, "committed": 3, "aborted": 2, "active": 0}


def test_indexes_skip_files(catalog, spark):
    t = catalog.create_table("s", "d int, status string, note string", options={"cluster-by": "d", "index.status.type": "bitmap", "file.index.note.bloom-filter": "true"})
    for n in range(4):
        t.write(spark.range(n * 10, n * 10 + 10).selectExpr("cast(id as int) d", f"case when {n} = 3 then null else 's{n}' end status", "concat('n', id) note").coalesce(1))
    assert len(t.plan()) == 4
    assert len(t.plan(P.lt("d", 10))) == 1 and len(t.plan(P.between("d", 15, 25))) == 2 and len(t.plan(P.gt("d", 99))) == 0
    assert len(t.plan(P.eq("status", "s1"))) == 1 and len(t.plan(P.ne("status", "s1"))) == 3
    assert len(t.plan(P.is_in("status", ["s0", None]))) == 2 and len(t.plan(P.is_null("status"))) == 1
    either = P.eq("d", 1) | P.eq("status", "s2")
    assert len(t.plan(either)) == 2 and t.read(predicate=either).count() == 11  # a file stays if one side can be true
    assert len(t.plan(P.eq("d", None))) == 0 and t.read(predicate=P.eq("d", None)).count() == 0
    assert t.read(predicate=P.ne("status", "s1")).count() == 30  # null differs
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(f"{t.root}/{t.plan()[0].path}").metadata.row_group(0)
    assert "RLE_DICTIONARY" not in meta.column(2).encodings  # the bloom filter's column


def test_partitions(catalog, spark):
    t = catalog.create_table("p", "id int, dt string, region string", partitioned_by=["dt", "region"])
    t.write(spark.createDataFrame([(1, "2024-01-01", "a/b"), (2, "2024-01-01", "c d"), (3, "2024-01-02", None), (4, "2024-01-02", "a/b")], t.schema.struct))
    assert {tuple(r) for r in t.partitions().select("dt", "region", "rows").collect()} == {("2024-01-01", "a/b", 1), ("2024-01-01", "c d", 1), ("2024-01-02", None, 1), ("2024-01-02", "a/b", 1)}
    assert rows(t.read()) == sorted([(1, "2024-01-01", "a/b"), (2, "2024-01-01", "c d"), (3, "2024-01-02", None), (4, "2024-01-02", "a/b")], key=repr)
    assert [r.id for r in t.read(partition={"dt": "2024-01-01", "region": "a/b"}).collect()] == [1]
    assert len(t.plan(partition=PP.prefix("dt", "2024-01-02"))) == 2
    assert sorted(r.id for r in t.read(partition=~PP.equal("region", "a/b")).collect()) == [2, 3]
    t.drop_partition({"region": "a/b"})
    assert sorted(r.id for r in t.read().collect()) == [2, 3]
    with pytest.raises(errors.SchemaError):
        t.drop_partition({})
    t.overwrite(spark.createDataFrame([(9, "2024-01-01", "c d"), (10, "2030-01-01", "x")], t.schema.struct), partition={"dt": "2024-01-01"})
    assert sorted(r.id for r in t.read().collect()) == [3, 9]


def test_key_moves_between_partitions(catalog, spark):
    t = catalog.create_table("ue", "user_id int, kind string, dt string", ["user_id"], ["dt"])
    t.write(spark.createDataFrame([(1, "login", "2024-01-01"), (2, "logout", "2024-01-01"), (3, "click", "2024-01-02")], t.schema.struct))
    t.write(spark.createDataFrame([(1, "login", "2024-01-03")], t.schema.struct))
    assert t.read(partition={"dt": "2024-01-01"}).count() == 1  # key 1 has moved on
    t.delete(P.eq("user_id", 1))
    assert sorted(r.user_id for r in t.read().collect()) == [2, 3]
    t.delete(P.eq("dt", "2024-01-02"))
    assert [r.user_id for r in t.read().collect()] == [2]


@pytest.mark.parametrize(
    "made, holds, fails",
    [
        (PP.equal("dt", "2024-01-01"), {"dt": "2024-01-01"}, {"dt": "2024-01-02"}),
        (PP.is_in("hour", ["01", "02"]), {"hour": "02"}, {"hour": "03"}),
        (PP.greater("dt", "2024-01-01"), {"dt": "2024-01-02"}, {"dt": "2024-01-01"}),
        (PP.at_least("dt", "2024-01-01"), {"dt": "2024-01-01"}, {"dt": "2023-12-31"}),
        (PP.less("hour", "10"), {"hour": "09"}, {"hour": "10"}),
        (PP.at_most("hour", "10"), {"hour": "10"}, {"hour": "11"}),
        (PP.between("hour", "08", "10"), {"hour": "09"}, {"hour": "11"}),
        (PP.prefix("dt", "2024-"), {"dt": "2024-05"}, {"dt": "2023-05"}),
        (PP.equal("a", "1") & PP.equal("b", "2"), {"a": "1", "b": "2"}, {"a": "1"}),
        (PP.equal("a", "1") | PP.equal("b", "2"), {"b": "2"}, {"a": "2"}),
        (~PP.equal("a", "1"), {"b": "1"}, {"a": "1"}),
        (PP.always(True), {}, None),
        (~PP.always(False), {}, None),
    ],
)
def test_partition_predicates(spark, made, holds, fails):
    for spec, want in ((holds, True), (fails, False)):
        if spec is not None:
            assert made(spec) is want
            given = {k: spec.get(k) for k in ("a", "b", "dt", "hour")}
            one = spark.createDataFrame([tuple(given.values())], "a string, b string, dt string, hour string")
            assert (one.where(made.column()).count() == 1) is want


def test_predicates_have_two_values(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",)], "n string")
    count = lambda p: df.where(p.column()).count()
    assert [count(p) for p in (P.ne("n", "a"), P.eq("n", "a"), P.eq("n", None), P.ne("n", None), P.gt("n", "a"), P.is_in("n", ["a", None]), P.is_in("n", [None]), ~P.eq("n", "a"))] == [2, 1, 0, 3, 1, 2, 1, 2]


def test_schema_evolution(catalog, spark):
    t = catalog.create_table("e", "id int, price double, name string", ["id"])
    t.write(spark.createDataFrame([(1, 1.5, "x")], t.schema.struct))
    t.add_column("category", "VARCHAR(20)", after="id")
    t.rename_column("name", "title")
    t.widen_column("id", "BIGINT")
    t.write(spark.createDataFrame([(2, "new", 2.5, "y")], t.schema.struct))
    assert t.schema.names == ["id", "category", "price", "title"] and rows(t.read()) == [(1, None, 1.5, "x"), (2, "new", 2.5, "y")]
    t.drop_column("category")
    t.add_column("category", "string")
    assert rows(t.read(["id", "category"])) == [(1, None), (2, None)]  # a new column, not the old one
    t.rename_column("id", "key")
    assert t.schema.primary_key == ("key",) and t.log.schema_ids() == list(range(7))
    with pytest.raises(errors.SchemaError):
        t.drop_column("key")
    with pytest.raises(errors.SchemaError):
        t.widen_column("title", "int")
    catalog.alter_table("e", [("key", "bigint"), ("title", "string"), ("extra", "int")])
    assert t.read().columns == ["key", "title", "extra"]


def test_types(catalog, spark):
    t = catalog.create_table("c", "id int, tags array<string>, attrs map<string,string>, at timestamp_ntz, d decimal(10,2), b boolean, n struct<x:int>", ["id"])
    row = (1, ["a", None], {"k": "v"}, datetime.datetime(2024, 1, 1), __import__("decimal").Decimal("1.25"), True, (3,))
    t.write(spark.createDataFrame([row], t.schema.struct))
    assert tuple(t.read().first()) == row
    with pytest.raises(errors.SchemaError):
        catalog.create_table("bad", "a array<int>", ["a"])


def test_keys_of_many_kinds(catalog, spark):
    t = catalog.create_table("k", "s string, n int, v int", ["s", "n"])
    t.write(spark.createDataFrame([("b", -1, 1), ("ab", 5, 1), ("a\n,\"'", 0, 1), ("", 7, 1), ("é", -9, 1)], t.schema.struct))
    t.write(spark.createDataFrame([("b", -1, 2), ("", 7, 2)], t.schema.struct))
    assert {(r.s, r.n): r.v for r in t.read().collect()} == {("b", -1): 2, ("ab", 5): 1, ("a\n,\"'", 0): 1, ("", 7): 2, ("é", -9): 1}
    assert {(r.s, r.n) for r in t.read_key_range(["ab", 0], ["b", 0]).collect()} == {("ab", 5), ("b", -1)}


def test_branches(catalog, spark):
    t = people(catalog, spark)
    dev = catalog.create_branch("people", "dev")
    dev.write(spark.createDataFrame([(1, "dev", 0)], t.schema.struct))
    assert {r.name for r in t.get(1).collect()} == {"c1"} and {r.name for r in catalog.read("people$branch_dev", predicate=P.eq("id", 1)).collect()} == {"dev"}
    old = catalog.create_branch("people", "old", snapshot=1)
    assert old.read().count() == 5 and catalog.create_branch("people", "bare", empty=True).read().count() == 0
    t.create_tag("two", 2)
    assert catalog.create_branch("people", "tagged", tag="two").read().count() == 10
    assert catalog.branches("people") == ["bare", "dev", "old", "tagged"]
    for bad in ("main", "", "123", "a b"):
        with pytest.raises(errors.InvalidName):
            catalog.create_branch("people", bad)
    with pytest.raises(errors.BranchExists):
        catalog.create_branch("people", "dev")
    catalog.fast_forward("people", "dev")
    assert {r.name for r in t.get(1).collect()} == {"dev"}
    with pytest.raises(errors.LakeError):
        catalog.fast_forward("people", "old")
    catalog.drop_branch("people", "old")
    with pytest.raises(errors.BranchMissing):
        catalog.table("people$branch_old")


def test_catalog(catalog, spark):
    catalog.create_database("db")
    with pytest.raises(errors.DatabaseExists):
        catalog.create_database("db")
    catalog.create_table("db.t", "a int", description="d", options={"x": "y"})
    with pytest.raises(errors.TableExists):
        catalog.create_table("db.t", "a int")
    with pytest.raises(errors.DatabaseNotEmpty):
        catalog.drop_database("db")
    with pytest.raises(errors.TableMissing):
        catalog.table("db.none")
    with pytest.raises(errors.DatabaseMissing):
        catalog.create_table("none.t", "a int")
    assert catalog.metadata("db.t")["options"] == {"x": "y"} and catalog.tables("db") == ["t"]
    catalog.rename_table("db.t", "u")
    assert catalog.tables("db") == ["u"]
    catalog.drop_table("db.u")
    catalog.drop_table("db.u", if_exists=True)
    catalog.drop_database("db", cascade=True)
    assert Identifier.parse("db.t$branch_x$files") == Identifier("db", "t", "x", "files")
    for bad in ("a-b", "t$what", "a.b.c", ""):
        with pytest.raises(errors.InvalidName):
            Identifier.parse(bad)


def test_metadata_tables(catalog, spark):
    t = people(catalog, spark)
    assert [r.snapshot_id for r in catalog.read("people$snapshots").orderBy("snapshot_id").collect()] == [1, 2, 3]
    assert catalog.read("people$files").agg(F.sum("rows")).first()[0] == 15
    assert catalog.read("people$schemas").count() == 3 and catalog.read("people$manifests").count() == 6
    assert catalog.read("people$branches").count() == 0
    made = t.analyze()
    assert made.kind == "ANALYZE" and "statistics" in made.properties and t.read().count() == 12


def test_formats(catalog, spark, tmp_path):
    from lakespark.sources.exchange import export_files, import_files

    t = catalog.create_table("src", "id int, s string", ["id"])
    t.write(spark.createDataFrame([(1, 'a,"b"'), (2, ""), (3, None), (4, "x\ny")], t.schema.struct))
    for kind in ("csv", "json", "orc", "parquet"):
        export_files(t, str(tmp_path / kind), kind)
        copy = catalog.create_table(f"copy_{kind}", "id int, s string", ["id"])
        import_files(copy, str(tmp_path / kind), kind)
        assert rows(copy.read()) == rows(t.read()), kind
    with pytest.raises(errors.Unsupported):
        export_files(t, str(tmp_path / "x"), "sst")


def test_streams(catalog, spark, tmp_path):
    from lakespark.streaming.tables import follow, sink

    t = catalog.create_table("s", "id int, v string, _x int", ["id"])
    put = sink(t, "query", compact_at=3)
    put(spark.createDataFrame([(1, "a", 0)], t.schema.struct), 0)
    put(spark.createDataFrame([(1, "replayed", 0)], t.schema.struct), 0)
    assert rows(t.read()) == [(1, "a", 0)]
    for n in range(1, 4):
        put(spark.createDataFrame([(1, f"v{n}", n)], t.schema.struct), n)
    assert rows(t.read()) == [(1, "v3", 3)] and COMPACT in {s.kind for s in t.log.snapshots()}
    seen = []
    state = str(tmp_path / "state")
    last = follow(t, lambda df, n: seen.append((n, df.count())), state=state)
    assert last == t.log.latest().id and len(seen) == 4
    assert follow(t, lambda df, n: seen.append(n), state=state) == last and len(seen) == 4


def test_orc_files_beside_parquet(catalog, spark):
    t = catalog.create_table("o", "id int, s string", ["id"], options={"file.format": "orc"})
    t.write(spark.createDataFrame([(1, "a"), (2, "b")], t.schema.struct))
    t.set_options(**{"file.format": "parquet"})
    t.write(spark.createDataFrame([(2, "c"), (3, "d")], t.schema.struct))
    assert rows(t.read()) == [(1, "a"), (2, "c"), (3, "d")] and {f.path.rsplit(".", 1)[1] for f in t.plan()} == {"orc", "parquet"}
    t.set_options(**{"file.format": "sst"})
    with pytest.raises(errors.Unsupported):
        t.write(spark.createDataFrame([(4, "e")], t.schema.struct))
