"""A table's branch: reads, writes, and what is known of them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, replace
from typing import TYPE_CHECKING
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import CommitConflict, SchemaError, Unsupported
from .identifiers import MAIN, Identifier
from .metadata.files import DataFile
from .metadata.log import ANALYZE, APPEND, COMPACT, OVERWRITE, CommitOptions, Log, Snapshot
from .metadata.schema import Schema
from .operators.predicate import PartitionPredicate, Predicate
from .operators.pruning import prune
from .operators.read import OPERATION, merge_rows, read_merged, read_rows, sections, with_path, with_sequence
from .operators.write import conform, latest_of_batch, write_files
from .sql.pushdown import StandIn, pruning

if TYPE_CHECKING:
    from .catalog import Catalog


class Write:
    """Files that are durable but in no snapshot yet; ``commit`` publishes them, ``abort`` takes them away."""

    def __init__(self, table: "Table", added: list[DataFile], removed=(), kind: str = APPEND, base: int | None = None, check: Callable[[Snapshot | None], None] | None = None):
        self.table, self.added, self.removed, self.kind, self.base, self.check, self.open = table, added, removed, kind, base, check, True

    def commit(self, user: str | None = None, identifier: int | None = None, watermark: int | None = None, properties: dict[str, str] | None = None) -> Snapshot | None:
        if not self.open:
            raise CommitConflict("this write was committed or aborted before")
        self.open = False
        try:
            made = self.table.log.commit(self.added, self.removed, self.kind, user, identifier, self.table.schema.id, watermark, properties, self.base, self.check)
        except CommitConflict:
            self._discard()
            raise
        if made and self.added and not {f.path for f in self.added} <= {f.path for k, f in self.table.log.entries(made.delta) if k == "ADD"}:
            self._discard()  # an earlier try of the same commit stands
        return made

    def abort(self) -> None:
        self.open = False
        self._discard()

    def _discard(self) -> None:
        for f in self.added:
            self.table.store.delete(f"{self.table.root}/{f.path}")


class Table:
    def __init__(self, catalog: "Catalog", identifier: Identifier, store, root: str, options: CommitOptions = CommitOptions()):
        self.catalog, self.identifier, self.store, self.root = catalog, identifier, store, root
        self.spark: SparkSession = catalog.spark
        self.log = Log(store, root if identifier.branch == MAIN else f"{root}/branch/branch-{identifier.branch}", options)

    @property
    def schema(self) -> Schema:
        return self.log.schema()

    @property
    def kind(self) -> str:
        return self.schema.kind

    # reads

    def _snapshot(self, snapshot: int | None, as_of: int | None) -> Snapshot | None:
        if snapshot is not None:
            return self.log.snapshot(snapshot)
        return self.log.at_time(as_of) if as_of is not None else self.log.latest()

    def plan(self, predicate: Predicate | None = None, partition: PartitionPredicate | dict[str, str] | None = None, snapshot: int | None = None, as_of: int | None = None) -> list[DataFile]:
        """The files that a read takes, after pruning."""
        schema, files = self.schema, list(self.log.files(self._snapshot(snapshot, as_of)).values())
        if isinstance(partition, dict):
            partition = PartitionPredicate.of(partition)
        if partition is not None and schema.primary_key and not set(schema.partition_keys) <= set(schema.primary_key):
            partition = None  # a newer version of a row can be in another partition
        merged = not schema.primary_key or not sections(files, schema)[1]
        return prune(files, schema, predicate, partition, merged)

    def scan(self, files: list[DataFile]) -> DataFrame:
        """All rows of files, the latest of each key."""
        return (read_merged if self.schema.primary_key else read_rows)(self.spark, self.root, files, self.schema)

    def read(self, columns: Sequence[str] | None = None, predicate: Predicate | None = None, partition: PartitionPredicate | dict[str, str] | None = None, snapshot: int | None = None, as_of: int | None = None) -> DataFrame:
        """Rows of a version (the latest, a snapshot's, or that of a time in milliseconds) as a DataFrame.

        Files are chosen now; rows are merged and filtered when the DataFrame runs.  Columns can be asked
        for in any order, and more than once.
        """
        schema = self.schema
        rows = self.scan(self.plan(predicate, partition, snapshot, as_of))
        if partition is not None:
            rows = rows.where((PartitionPredicate.of(partition) if isinstance(partition, dict) else partition).column())
        if predicate is not None:
            rows = rows.where(predicate.column())
        return rows.select(*[F.col(f"`{schema[c].name}`").alias(c) for c in columns]) if columns is not None else rows

    def read_incremental(self, after: int, until: int | None = None, changes: bool = False) -> DataFrame:
        """Rows that snapshots in (after, until] appended: all of an append-only table's, the latest of each key of
        a primary-key table's; ``changes`` keeps its deletions, with the operation.  Compactions hold no new rows;
        an overwrite in between is an error."""
        last = self.log.latest()
        until = until if until is not None else last.id if last else 0
        schema, files = self.schema, []
        for n in range(after + 1, until + 1):
            s = self.log.snapshot(n)
            if s.kind == OVERWRITE:
                raise Unsupported(f"snapshot {n} is an overwrite")
            if s.kind == APPEND:
                files += [f for k, f in self.log.entries(s.delta) if k == "ADD"]
        if not changes:
            return (read_merged if schema.primary_key else read_rows)(self.spark, self.root, files, schema)
        if not files:
            return read_rows(self.spark, self.root, [], schema).withColumn(OPERATION, F.lit("I"))
        rows = with_sequence(self.spark, self.root, files, schema)
        if schema.primary_key:
            rows = merge_rows(rows, [schema[k].stored for k in schema.primary_key], [F.col("_sequence")])
        op = F.coalesce(F.col(OPERATION), F.lit("I")) if OPERATION in rows.columns else F.lit("I")
        return rows.select(*[F.col(f.stored).alias(f.name) for f in schema.fields], op.alias(OPERATION))

    def get(self, *key) -> DataFrame:
        """The row of a key: its files are found by statistics and bloom filters."""
        from .operators.predicate import And, eq

        return self.read(predicate=And(tuple(eq(k, v) for k, v in zip(self.schema.primary_key, key, strict=True))))

    def read_key_range(self, low: Sequence, high: Sequence) -> DataFrame:
        """Rows with keys in [low, high]; keys of several fields compare field by field, as values."""
        from .operators.predicate import between

        keys = self.schema.primary_key
        rows = self.read(predicate=between(keys[0], low[0], high[0]))
        if len(keys) == 1:
            return rows
        whole = F.struct(*[F.col(f"`{k}`") for k in keys])
        bound = lambda v: F.struct(*[F.lit(x).cast(self.schema[k].data_type).alias(k) for k, x in zip(keys, v, strict=True)])
        return rows.where((whole >= bound(low)) & (whole <= bound(high)))

    def rows(self, **options) -> Iterator:
        """Merged rows one after the other, a partition at a time in the driver."""
        return self.read(**options).toLocalIterator()

    def count(self) -> int:
        """From the log alone, where no row can hide another."""
        schema, last = self.schema, self.log.latest()
        if last is None:
            return 0
        if schema.primary_key and sections(list(self.log.files(last).values()), schema)[1]:
            return self.read().count()
        return last.total_rows

    # writes

    def _files(self, rows: DataFrame, schema: Schema, sequence: str | None) -> list[DataFile]:
        rows = conform(rows, schema)
        if not schema.primary_key:
            if OPERATION in rows.columns:
                raise Unsupported("deletions need a primary key")
            return write_files(rows, self.root, schema, self.store)
        rows = latest_of_batch(rows, schema, sequence or schema.options.get("sequence.field"))
        return write_files(rows, self.root, schema, self.store, dealt=not schema.partition_keys and "cluster-by" not in schema.options)

    def prepare(self, rows: DataFrame, sequence: str | None = None) -> Write:
        """Writes files and leaves them out of sight until ``commit``.

        Of rows with the same key the last counts, by the field ``sequence`` (or the option
        ``sequence.field``), else by place.  A column ``_op`` of I, U or D (and +I, +U, -D; -U is left
        out) marks rows that take their key away.
        """
        schema = self.schema
        if OPERATION in rows.columns:
            op = F.regexp_replace(F.upper(F.coalesce(F.col(OPERATION), F.lit("I"))), r"^\+", "")
            rows = rows.withColumn(OPERATION, op).where(f"{OPERATION} not in ('-U', 'UPDATE_BEFORE')")
            rows = rows.withColumn(OPERATION, F.when(F.col(OPERATION).isin("D", "-D", "DELETE"), "D").otherwise("I"))
        return Write(self, self._files(rows, schema, sequence))

    def write(self, rows: DataFrame, sequence: str | None = None, user: str | None = None, identifier: int | None = None, watermark: int | None = None, properties: dict[str, str] | None = None) -> Snapshot | None:
        """Appends rows; in a primary-key table they replace those of the same keys.  No rows make no snapshot."""
        if user is not None and identifier is not None and (done := self.log.committed(user, identifier, APPEND)):
            return done
        return self.prepare(rows, sequence).commit(user, identifier, watermark, properties)

    def overwrite(self, rows: DataFrame, partition: dict[str, str] | PartitionPredicate | None = None, sequence: str | None = None, **commit) -> Snapshot | None:
        """Replaces all rows, or those of matching partitions; no rows leave nothing behind."""
        schema = self.schema
        if isinstance(partition, dict):
            partition = PartitionPredicate.of(partition)
        if partition is not None:
            rows = conform(rows, schema).where(partition.column())
        added = self._files(rows, schema, sequence)
        removed = lambda last: [f for f in self.log.files(last).values() if partition is None or partition(f.partition)]
        return Write(self, added, removed, OVERWRITE).commit(**commit)

    def rewrite(self, change: Callable[[DataFrame], DataFrame], predicate: Predicate | Column | str | None = None, **commit) -> Snapshot | None:
        """Copies files that can hold rows of ``predicate``, changed by a function of their merged rows."""
        schema, last = self.schema, self.log.latest()
        if last is None:
            return None
        files = list(self.log.files(last).values())
        if isinstance(predicate, (str, Column)):
            predicate = pruning(self.spark, schema, predicate)
        touched = prune(files, schema, predicate, None, True)
        if schema.primary_key and touched:
            alone, mixed = sections(files, schema)
            paths = {f.path for f in touched}
            # versions of a key stay together
            touched = [f for f in alone if f.path in paths] + (mixed if any(f.path in paths for f in mixed) else [])
        if not touched:
            return None
        return Write(self, write_files(conform(change(self.scan(touched)), schema), self.root, schema, self.store), touched, OVERWRITE, last.id).commit(**commit)

    def _condition(self, where: Predicate | Column | str | None) -> Column:
        if where is None:
            return F.lit(True)
        if isinstance(where, Predicate):
            return where.column()
        return F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))

    def delete(self, where: Predicate | Column | str | None = None, **commit) -> Snapshot | None:
        """Takes away rows for which ``where`` is true; all, if there is none."""
        if where is None:
            return Write(self, [], lambda last: list(self.log.files(last).values()), OVERWRITE).commit(**commit)
        schema, last = self.schema, self.log.latest()
        names = self._names(where)
        if names and names <= set(schema.partition_keys) and last:
            whole = self._whole_partitions(self._condition(where), list(self.log.files(last).values()))
            if whole is not None:
                return Write(self, [], whole, OVERWRITE, last.id).commit(**commit) if whole else None
        return self.rewrite(lambda rows: rows.where(~self._condition(where)), where, **commit)

    def _names(self, where: Predicate | Column | str) -> set[str]:
        """Fields that a condition looks at; none if it isn't one over rows alone."""
        if isinstance(where, Predicate):
            return {self.schema[n].name for n in where.fields()}
        rows = StandIn(self.spark, self.schema)
        plan = rows.rows.where(self._condition(where))._jdf.queryExecution().analyzed()
        names = {plan.condition().references().toSeq().apply(k).name() for k in range(plan.condition().references().size())} if plan.condition().deterministic() else set()
        return {n for n in self.schema.names if n in names}

    def _whole_partitions(self, where: Column, files: list[DataFile]) -> list[DataFile] | None:
        """Files of partitions that a predicate takes whole, told by one row for each partition; None if a newer
        version of a row could be elsewhere."""
        schema = self.schema
        if schema.primary_key and not set(schema.partition_keys) <= set(schema.primary_key) and sections(files, schema)[1]:
            return None
        specs = {tuple(f.partition.items()) for f in files}
        if not specs:
            return []
        rows = self.spark.createDataFrame([tuple(dict(s).get(k) for k in schema.partition_keys) for s in specs], ", ".join(f"`{k}` string" for k in schema.partition_keys))
        typed = rows.select(*[F.col(f"`{k}`").cast(schema[k].data_type).alias(k) for k in schema.partition_keys], *[F.col(f"`{k}`").alias(f"_{k}") for k in schema.partition_keys])
        gone = {tuple(r) for r in typed.where(where).select(*[f"`_{k}`" for k in schema.partition_keys]).collect()}
        return [f for f in files if tuple(f.partition.get(k) for k in schema.partition_keys) in gone]

    def update(self, changes: dict[str, Column | str | object], where: Predicate | Column | str | None = None, **commit) -> Snapshot | None:
        """Sets fields (to columns, or to values) in rows for which ``where`` is true."""
        schema = self.schema
        if keys := {schema[n].name for n in changes} & set(schema.primary_key):
            raise SchemaError(f"key fields can't change: {sorted(keys)}")
        to = {schema[n].name: v if isinstance(v, Column) else F.lit(v) for n, v in changes.items()}
        holds = self._condition(where)
        change = lambda rows: rows.select(*[(F.when(holds, to[n].cast(schema[n].data_type)).otherwise(F.col(f"`{n}`")) if n in to else F.col(f"`{n}`")).alias(n) for n in rows.columns])
        return self.rewrite(change, where, **commit)

    def merge(self, source: DataFrame, on: Sequence[str], update: dict[str, Column] | bool = True, insert: bool = True, delete: Column | None = None, **commit) -> Snapshot | None:
        """Joins rows (``t``) with ``source`` (``s``; unique by ``on``) and updates, deletes (if ``delete`` is true) or
        inserts.  ``update`` is True for all fields of the source, False for none, or new values by field."""
        condition = F.lit(True)
        for c in on:
            condition = condition & F.col(f"t.`{c}`").eqNullSafe(F.col(f"s.`{c}`"))
        given = {c.lower() for c in source.columns}
        matched: list[tuple[Column | None, dict[str, Column] | None]] = [(delete, None)] if delete is not None else []
        if update:
            matched.append((None, {n: F.col(f"s.`{n}`") for n in self.schema.names if n.lower() in given} if update is True else update))
        new = [(None, {n: F.col(f"s.`{n}`") for n in self.schema.names if n.lower() in given})] if insert else []
        keys = {self.schema[c].name: F.col(f"`{c}`") for c in on}
        return self.merge_clauses(source, condition, matched, new, keys=keys if set(keys) == set(self.schema.primary_key) else None, **commit)

    def merge_clauses(self, source: DataFrame, on: Column, matched: list[tuple[Column | None, dict[str, Column] | None]], unmatched: list[tuple[Column | None, dict[str, Column]]], target: str = "t", using: str = "s", lone: list[tuple[Column | None, dict[str, Column] | None]] = (), keys: dict[str, Column] | None = None, **commit) -> Snapshot | None:
        """MERGE: for each row with a partner the first clause of ``matched`` whose condition holds sets fields, or takes
        the row away (None); rows of the source without one are inserted by the first clause of ``unmatched`` that
        holds; rows of the table without one are changed by ``lone``.  A row that meets two of the source is an error.

        ``keys`` tells that ``on`` asks for equality of the primary key and nothing else, with the source's columns:
        then changed rows are written as new versions, and no file is rewritten.  Otherwise files with partners
        are found first, and only they are rewritten (all of them, if ``lone`` has clauses).
        """
        schema, last = self.schema, self.log.latest()
        files = list(self.log.files(last).values()) if last else []
        base = last.id if last else None
        s = source.withColumn("_s", F.lit(True)).alias(using)
        versions = bool(keys) and bool(schema.primary_key) and not lone
        if versions:
            files = self._of_keys(source, keys, files)
            t = self.scan(files)
            how = "right"
        else:
            if not lone and files:
                files = self._with_partners(s, on, target, files)
            t = self.scan(files)
            how = "full" if unmatched else "left"
        t = t.withColumn("_t", F.monotonically_increasing_id()).alias(target)
        both = t.join(s, on, how)
        pair, new = F.col("_t").isNotNull() & F.col("_s").isNotNull(), F.col("_t").isNull()
        single = F.col("_s").isNull()
        clauses = [*((pair, c) for c in matched), *((new, c) for c in unmatched), *((single, c) for c in lone)]
        which = F.when(F.lit(False), F.lit(0))
        for k, (side, (condition, _)) in enumerate(clauses):
            which = which.when(side & (F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))), k)
        both = both.withColumn("_clause", which.otherwise(F.when(new, -2).otherwise(-1)))
        gone = [k for k, (_, (_, sets)) in enumerate(clauses) if sets is None]
        columns = []
        for f in schema.fields:
            own = F.col(f"{target}.`{f.name}`")
            value = F.when(F.col("_clause").isin(-1, *gone), own)
            for k, (side, (_, sets)) in enumerate(clauses):
                if sets is not None:
                    given = {schema[n].name: c for n, c in sets.items()}
                    if versions and side is pair and f.name in schema.primary_key:
                        given.pop(f.name, None)  # it is the same
                    value = value.when(F.col("_clause") == k, given.get(f.name, F.lit(None) if side is new else own).cast(f.data_type))
            columns.append(value.cast(f.data_type).alias(f.name))
        # rows with several partners are rare; only if there are any do rows have to be gathered by target row
        several = both.where(pair).groupBy("_t").agg(F.count("*").alias("n"), F.sum((F.col("_clause") >= 0).cast("int")).alias("hits")).where("n > 1")
        worst = several.orderBy(F.desc("hits")).head()
        if worst and worst.hits > 1:
            raise SchemaError("a row of the table meets two of the source")
        if worst:
            key = F.coalesce(F.col("_t"), -1 - F.monotonically_increasing_id())
            both = both.withColumn("_key", key).withColumn("_place", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("_clause")))).where("_place = 1")
        if versions:
            changed = both.where("_clause >= 0")
            if gone:
                columns.append(F.when(F.col("_clause").isin(gone), "D").otherwise("I").alias(OPERATION))
            added = self._files(changed.select(*columns), schema, None)
            return Write(self, added, kind=APPEND, check=self._unchanged(base)).commit(**commit)
        checked = both.where(~F.col("_clause").isin(-2, *gone)).select(*columns)
        added = write_files(conform(checked, schema), self.root, schema, self.store)
        return Write(self, added, files, OVERWRITE, base).commit(**commit) if added or files else None

    def _unchanged(self, base: int | None) -> Callable[[Snapshot | None], None]:
        """For ``check`` of a commit: rows came or went since a snapshot."""

        def check(last: Snapshot | None) -> None:
            since = [self.log.snapshot(n) for n in self.log.snapshot_ids() if n > (base or 0)] if last else []
            if any(s.kind not in (COMPACT, ANALYZE) for s in since):
                raise CommitConflict(f"the table changed since snapshot {base}")

        return check

    def _of_keys(self, source: DataFrame, keys: dict[str, Column], files: list[DataFile]) -> list[DataFile]:
        """Files that can hold keys of the source, by the least and most of the first one."""
        from .operators.predicate import between

        first = self.schema.primary_key[0]
        column = keys[first].cast(self.schema[first].data_type)
        low, high = source.agg(F.min(column), F.max(column)).first()
        if low is None or not files:
            return []
        return prune(files, self.schema, between(first, low, high), None, not sections(files, self.schema)[1])

    def _with_partners(self, source: DataFrame, on: Column, target: str, files: list[DataFile]) -> list[DataFile]:
        """Files with rows that meet one of the source; with files that hold other versions of their keys."""
        schema = self.schema
        rows = with_path(self.spark, self.root, files, schema).alias(target)
        paths = {unquote(r[0]).rpartition(f"{self.root}/")[2] for r in rows.join(source, on, "left_semi").select("_path").distinct().toLocalIterator()}
        if not schema.primary_key:
            return [f for f in files if f.path in paths]
        alone, mixed = sections(files, schema)
        return [f for f in alone if f.path in paths] + (mixed if any(f.path in paths for f in mixed) else [])

    # maintenance

    def compact(self, full: bool = False, least: int = 4, target_bytes: int = 256 << 20, **commit) -> Snapshot | None:
        """Rewrites files as merged, larger ones.

        By size tiers: files well below ``target_bytes`` (and, of a primary-key table, all files whose key
        ranges overlap) are taken if there are ``least`` of them; ``full`` takes all.  Old files stay for older
        snapshots until these expire.
        """
        schema, last = self.schema, self.log.latest()
        if last is None:
            return None
        files = list(self.log.files(last).values())
        if schema.primary_key:
            alone, mixed = sections(files, schema)
            small = [f for f in alone if f.size < target_bytes // 4]
            taken = files if full else (mixed if len(mixed) >= least else []) + (small if len(small) >= least else [])
        else:
            taken = files if full else [f for f in files if f.size < target_bytes // 4]
            taken = taken if full or len(taken) >= least else []
        if not taken or len(taken) == 1 and not taken[0].tombstones:
            return None
        if schema.primary_key:
            # what stays must not fall between versions that are merged here
            rows = read_merged(self.spark, self.root, taken, schema)
        else:
            rows = read_rows(self.spark, self.root, taken, schema)
        pieces = max(1, -(-sum(f.size for f in taken) // target_bytes))
        level = 1 + max(f.level for f in taken)
        top = max(f.sequence for f in taken)
        added = [replace(f, level=level, sequence=top) for f in write_files(rows, self.root, schema, self.store, files=pieces)]
        return Write(self, added, taken, COMPACT, last.id).commit(**commit)

    def needs_compaction(self, least: int = 4) -> bool:
        """Whether ``least`` or more commits hold overlapping keys."""
        schema, last = self.schema, self.log.latest()
        if last is None or not schema.primary_key:
            return False
        return len({f.sequence for f in sections(list(self.log.files(last).values()), schema)[1]}) >= least

    def expire(self, keep: int = 10) -> list[int]:
        """Drops all but the last ``keep`` snapshots, and files that no snapshot of any branch needs."""
        ids = self.log.snapshot_ids()
        old, kept = ids[:-keep] if keep else ids[:-1], ids[-keep:] if keep else ids[-1:]
        if not old:
            return []
        tagged = set(self.tags().values())
        old = [n for n in old if n not in tagged]
        logs = [self.log, *(self.catalog.table(replace(self.identifier, branch=b)).log for b in self.catalog.branches(self.identifier) if b != self.identifier.branch)]
        if self.identifier.branch != MAIN:
            logs.append(self.catalog.table(replace(self.identifier, branch=MAIN)).log)
        needed: set[str] = set()
        for log in logs:
            for n in log.snapshot_ids():
                if log is not self.log or n not in old:
                    s = log.snapshot(n)
                    needed |= set(log.files(s)) | {f.path for k, f in log.entries(s.delta) if k == "ADD"}
        gone = {p for n in old for p in self.log.files(self.log.snapshot(n))} - needed
        manifests = {m for n in old for m in (*self.log.snapshot(n).manifests, self.log.snapshot(n).delta)}
        manifests -= {m for n in self.log.snapshot_ids() if n not in old for m in (*self.log.snapshot(n).manifests, self.log.snapshot(n).delta)}
        for n in old:
            self.store.delete(f"{self.log.root}/snapshot/snapshot-{n}")
        for m in manifests:
            self.store.delete(f"{self.log.root}/manifest/{m}")
        for p in gone:
            self.store.delete(f"{self.root}/{p}")
        return old

    def remove_orphans(self, older_than: float = 0.0) -> list[str]:
        """Deletes staging folders, and data files that no snapshot of any branch names, of broken writes, if they are
        ``older_than`` seconds; to be run while no write that began before is under way."""
        before = (time.time() - older_than) * 1000
        gone = []
        for n in self.store.names(f"{self.root}/_staging"):
            if all(t <= before for t in self.store.times(f"{self.root}/_staging/{n}").values()):
                self.store.delete(f"{self.root}/_staging/{n}")
                gone.append(n)
        names = [MAIN, *self.catalog.branches(self.identifier)]
        needed: set[str] = set()
        for log in (self.catalog.table(replace(self.identifier, branch=b)).log for b in names):
            for s in log.snapshots():
                needed |= set(log.files(s)) | {f.path for _, f in log.entries(s.delta)}
        for path, written in self.store.times(f"{self.root}/data").items():
            if f"data/{path}" not in needed and written <= before:
                self.store.delete(f"{self.root}/data/{path}")
                gone.append(f"data/{path}")
        return gone

    def analyze(self) -> Snapshot | None:
        """Statistics of all columns, kept as properties of a snapshot of kind ANALYZE."""
        from .functions.statistics import column_statistics

        found = {r["column"]: {k: r[k] for k in ("least", "most", "nulls", "distinct", "rows")} for r in column_statistics(self.read()).collect()}
        if self.log.latest() is None:
            return None
        return self._mark(ANALYZE, {"statistics": json.dumps(found)})

    def _mark(self, kind: str, properties: dict[str, str]) -> Snapshot:
        while True:
            last = self.log.latest()
            made = replace(last, id=last.id + 1, kind=kind, user="analyze", identifier=time.time_ns(), time_millis=int(time.time() * 1000), delta=self.log._put_manifest(f"delta-{last.id + 1}", []), delta_rows=0, properties=properties)
            if self.store.create(f"{self.log.root}/snapshot/snapshot-{made.id}", json.dumps(asdict(made), indent=1)):
                return made

    def rollback(self, snapshot: int) -> Snapshot | None:
        """Makes a snapshot's files the latest ones again, by a new snapshot."""
        then = self.log.files(self.log.snapshot(snapshot))
        last = self.log.latest()
        now = self.log.files(last)
        back = [f for p, f in then.items() if p not in now]
        return self._replace(back, [f for p, f in now.items() if p not in then], last)

    def _replace(self, back: list[DataFile], gone: list[DataFile], last: Snapshot) -> Snapshot:
        # returning files keep their sequence, as compacted ones do; rows come and go, so it is no compaction
        made = self.log.commit(back, gone, OVERWRITE, schema_id=self.schema.id, base=last.id, renumber=False) if back or gone else last
        return made or last

    def tags(self) -> dict[str, int]:
        return {n: int(self.store.read(f"{self.log.root}/tag/{n}")) for n in self.store.names(f"{self.log.root}/tag")}

    def create_tag(self, name: str, snapshot: int | None = None) -> None:
        s = self._snapshot(snapshot, None)
        if s is None or not self.store.create(f"{self.log.root}/tag/{name}", str(s.id)):
            raise CommitConflict(f"tag {name} can't be made")

    # what is known

    def snapshots(self) -> DataFrame:
        rows = [(s.id, s.schema_id, s.kind, s.user, s.identifier, s.time_millis, s.total_rows, s.delta_rows, s.watermark) for s in self.log.snapshots()]
        return self.spark.createDataFrame(rows, "snapshot_id long, schema_id int, kind string, commit_user string, commit_identifier long, time_millis long, total_rows long, delta_rows long, watermark long")

    def files(self, snapshot: int | None = None) -> DataFrame:
        names = {str(f.id): f.name for f in self.schema.fields}
        told = lambda d: {names[k]: str(v) for k, v in d.items() if k in names}
        rows = [(f.path, f.partition, f.rows, f.size, f.schema_id, f.sequence, f.level, told(f.least), told(f.most), {names[k]: v for k, v in f.nulls.items() if k in names}) for f in self.log.files(self._snapshot(snapshot, None)).values()]
        return self.spark.createDataFrame(rows, "path string, partition map<string,string>, rows long, size long, schema_id int, sequence long, level int, least map<string,string>, most map<string,string>, nulls map<string,long>")

    def manifests(self) -> DataFrame:
        rows = []
        for s in self.log.snapshots():
            for m in s.manifests:
                kinds = [k for k, _ in self.log.entries(m)]
                rows.append((s.id, m, kinds.count("ADD"), kinds.count("DELETE")))
        return self.spark.createDataFrame(rows, "snapshot_id long, manifest string, added int, deleted int")

    def partitions(self, where: PartitionPredicate | None = None) -> DataFrame:
        """A row for each partition: its values, and rows, bytes and files in it."""
        keys, found = self.schema.partition_keys, {}
        for f in self.log.files(self.log.latest()).values():
            if where is None or where(f.partition):
                n = found.setdefault(tuple(f.partition.get(k) for k in keys), [0, 0, 0])
                n[0], n[1], n[2] = n[0] + f.rows, n[1] + f.size, n[2] + 1
        return self.spark.createDataFrame([(*k, *v) for k, v in found.items()], ", ".join([*(f"`{k}` string" for k in keys), "rows long", "bytes long", "files long"]))

    def schemas(self) -> DataFrame:
        rows = [(s.id, f.id, f.name, f.type, f.nullable, f.name in s.primary_key, f.name in s.partition_keys) for s in map(self.log.schema, self.log.schema_ids()) for f in s.fields]
        return self.spark.createDataFrame(rows, "schema_id int, field_id int, name string, type string, nullable boolean, primary_key boolean, partition_key boolean")

    def drop_partition(self, spec: dict[str, str]) -> Snapshot | None:
        """Takes a partition's rows away by a snapshot; an empty spec is refused."""
        if not spec:
            raise SchemaError("an empty partition spec would drop the table's rows")
        if unknown := set(spec) - set(self.schema.partition_keys):
            raise SchemaError(f"no partition keys {sorted(unknown)}")
        where = PartitionPredicate.of(spec)
        return Write(self, [], lambda last: [f for f in self.log.files(last).values() if where(f.partition)], OVERWRITE).commit()

    # schema

    def _evolve(self, schema: Schema) -> Schema:
        return self.log.put_schema(schema)

    def add_column(self, name: str, kind: str, nullable: bool = True, after: str | None = None) -> Schema:
        return self._evolve(self.schema.add(name, kind, nullable, after))

    def drop_column(self, name: str) -> Schema:
        return self._evolve(self.schema.drop(name))

    def rename_column(self, old: str, new: str) -> Schema:
        return self._evolve(self.schema.rename(old, new))

    def widen_column(self, name: str, kind: str) -> Schema:
        return self._evolve(self.schema.widen(name, kind))

    def set_options(self, **options: str) -> Schema:
        schema = self.schema
        return self._evolve(replace(schema, options=schema.options | options))
