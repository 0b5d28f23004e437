"""SQL over tables of a catalog.

Statements are parsed by Spark; tables in them are found in its syntax tree, bound to DataFrames as
temporary views, and the rest is left to Spark.  Filters that Catalyst moves down to a table choose its
files (``pushdown``).  DDL and changes of rows go to the catalog and tables.  In
CREATE TABLE, columns that are NOT NULL make up the primary key, unless the property ``primary-key`` names it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError, Unsupported
from ..identifiers import Identifier
from ..metadata.schema import spark_type
from .pushdown import StandIn, filters

_CREATE = re.compile(r"\s*create\s+table\s+(?P<if>if\s+not\s+exists\s+)?(?P<name>[\w.`$-]+)\s*\(", re.I)


def _plain(text: str) -> str:
    """Without comments and a last semicolon; text in quotes stays."""
    parts = re.split(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)""", text)
    bare = [p if k % 2 else re.sub(r"/\*.*?\*/|--[^\n]*", " ", p, flags=re.S) for k, p in enumerate(parts)]
    return "".join(bare).strip().rstrip(";").strip()


def _nodes(node):
    yield node
    children = node.children().iterator()
    while children.hasNext():
        yield from _nodes(children.next())
    expressions = node.expressions().iterator()
    while expressions.hasNext():
        yield from _subqueries(expressions.next())


def _subqueries(expression):
    name = expression.getClass().getSimpleName()
    if name in ("ScalarSubquery", "Exists", "InSubquery", "ListQuery", "LateralSubquery", "UnresolvedScalarSubquery"):
        plan = expression.query().plan() if name == "InSubquery" else expression.plan()
        yield from _nodes(plan)
    children = expression.children().iterator()
    while children.hasNext():
        yield from _subqueries(children.next())


def _parts(relation) -> list[str]:
    parts = relation.multipartIdentifier().iterator()
    found = []
    while parts.hasNext():
        found.append(parts.next())
    return found


def _parse(catalog, text: str):
    return catalog.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)


def _name(parts: list[str]) -> str:
    return ".".join(parts)


def _cte_names(plan) -> set[str]:
    found = set()
    for node in _nodes(plan):
        if node.getClass().getSimpleName() == "UnresolvedWith":
            ctes = node.cteRelations().iterator()
            while ctes.hasNext():
                pair = ctes.next()
                found.add(pair._1().lower())
    return found


def _with_bodies(plan):
    yield from _nodes(plan)
    for node in list(_nodes(plan)):
        if node.getClass().getSimpleName() == "UnresolvedWith":
            ctes = node.cteRelations().iterator()
            while ctes.hasNext():
                yield from _with_bodies(ctes.next()._2())


def query(catalog, text: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A query as a DataFrame.  ``t VERSION AS OF n`` and ``TIMESTAMP AS OF`` (milliseconds or a time) read older versions.

    ``known`` gives names that stand for DataFrames.
    """
    plan = _parse(catalog, text)
    hidden = _cte_names(plan)
    edits: dict[tuple[int, int], str] = {}
    tables: dict[str, tuple] = {}
    inside = set()
    for node in _with_bodies(plan):
        kind = node.getClass().getSimpleName()
        if kind == "RelationTimeTravel":
            relation, options = node.relation(), {}
            inside.add((relation.origin().startIndex().get(), relation.origin().stopIndex().get()))
            if node.version().isDefined():
                options["snapshot"] = int(node.version().get())
            else:
                moment = node.timestamp().get().sql()
                options["as_of"] = int(catalog.spark.sql(f"select case when try_cast({moment} as long) is not null then try_cast({moment} as long) else unix_millis(cast({moment} as timestamp)) end").first()[0])
            origin = node.origin()
        elif kind == "UnresolvedRelation":
            relation, options, origin = node, {}, node.origin()
            if (origin.startIndex().get(), origin.stopIndex().get()) in inside:
                continue
        else:
            continue
        parts = _parts(relation)
        if len(parts) == 1 and parts[0].lower() in hidden:
            continue
        at = origin.startIndex().get(), origin.stopIndex().get()
        if at in edits:
            continue
        # Spark counts UTF-16 units and, for time travel, may leave out the table's name
        first, stop = min(at[0], relation.origin().startIndex().get()), at[1]
        name = _name(parts)
        given = (known or {}).get(name)
        if given is None and not catalog.table_exists(Identifier.parse(name, catalog.current)):
            if len(parts) == 1 and catalog.spark.catalog.tableExists(parts[0]):
                continue
        view = f"_lake_{uuid.uuid4().hex}"
        i = Identifier.parse(name, catalog.current)
        if given is not None:
            given.createOrReplaceTempView(view)
        elif i.system is not None:
            catalog.read(name, **options).createOrReplaceTempView(view)
        else:
            table = catalog.table(i)
            tables[view] = table, options, StandIn(catalog.spark, table.schema)
        named = re.match(r"\s*(?:as\s+)?(?!(?:where|join|on|inner|left|right|full|cross|semi|anti|natural|group|order|having|limit|union|intersect|except|minus|window|lateral|tablesample|using|sort|cluster|distribute|pivot|unpivot|offset|qualify)\b)[A-Za-z_`]", text[stop + 1 :], re.I)
        edits[(first, stop)] = f"`{view}`" + ("" if named else f" AS `{i.table}`")
    for (first, stop), to in sorted(edits.items(), reverse=True):
        text = text[:first] + to + text[stop + 1 :]
    asked: dict = {}
    if tables:
        for view, (_, _, stand_in) in tables.items():
            stand_in.rows.createOrReplaceTempView(view)
        asked = filters(catalog.spark.sql(text), [x[2] for x in tables.values()])
    for view, (table, options, stand_in) in tables.items():
        table.scan(table.plan(asked.get(stand_in.name), **options)).createOrReplaceTempView(view)
    return catalog.spark.sql(text)


def _done(catalog, **values) -> DataFrame:
    schema = T.StructType([T.StructField(k, T.LongType() if isinstance(v, int) else T.StringType()) for k, v in values.items()])
    return catalog.spark.createDataFrame([tuple(values.values())], schema)


def _snapshot(catalog, made) -> DataFrame:
    return _done(catalog, snapshot_id=made.id if made else -1, changed_rows=made.delta_rows if made else 0)


def _split(text: str) -> list[str]:
    """At commas outside brackets and quotes."""
    found, depth, quote, start = [], 0, "", 0
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "(<":
            depth += 1
        elif c in ")>":
            depth -= 1
        elif c == "," and not depth:
            found.append(text[start:k].strip())
            start = k + 1
    return [x for x in [*found, text[start:].strip()] if x]


def _closing(text: str, start: int) -> int:
    depth, quote = 0, ""
    for k in range(start, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return k
    raise SchemaError("a bracket isn't closed")


def _create(catalog, text: str, m: re.Match) -> DataFrame:
    _parse(catalog, re.sub(r"\bTEXT\b|\bBOOL\b", "STRING", text, flags=re.I))  # for the errors of Spark's parser
    stop = _closing(text, m.end() - 1)
    fields, keys = [], []
    for part in _split(text[m.end() : stop]):
        if k := re.match(r"primary\s+key\s*\(([^)]*)\)", part, re.I):
            keys = [x.strip(" `") for x in k[1].split(",")]
            continue
        c = re.match(r"(`[^`]+`|\w+)\s+(.+?)(\s+not\s+null)?(\s+comment\s+'[^']*')?$", part, re.I | re.S)
        if not c:
            raise SchemaError(f"no column: {part!r}")
        fields.append((c[1].strip("`"), spark_type(c[2]), bool(c[3])))
    rest = text[stop + 1 :]
    parted = re.search(r"partitioned\s+by\s*\(([^)]*)\)", rest, re.I)
    properties = re.search(r"tblproperties\s*\((.*?)\)\s*(?:$|partitioned|using|comment)", rest, re.I | re.S)
    options = {}
    for pair in _split(properties[1]) if properties else []:
        k, _, v = pair.partition("=")
        options[k.strip().strip("'\"`")] = v.strip().strip("'\"")
    keys = keys or [k.strip() for k in options.get("primary-key", "").split(",") if k.strip()] or [n for n, _, required in fields if required]
    struct = T.StructType([T.StructField(n, t, not required) for n, t, required in fields])
    catalog.create_table(m["name"], struct, keys, [k.strip(" `") for k in parted[1].split(",")] if parted else [], options, if_not_exists=True)
    return _done(catalog, result=f"table {m['name']}")


def execute(catalog, text: str) -> DataFrame:
    """Runs one statement; queries give their rows, others what they did."""
    text = _plain(text)
    word = (re.match(r"\w+", text) or [""])[0].lower()
    if m := _CREATE.match(text):
        return _create(catalog, text, m)
    if m := re.fullmatch(r"create\s+(?:database|schema|namespace)\s+(if\s+not\s+exists\s+)?`?(\w+)`?", text, re.I):
        catalog.create_database(m[2], bool(m[1]))
        return _done(catalog, result=f"database {m[2]}")
    if m := re.fullmatch(r"drop\s+(?:database|schema|namespace)\s+(if\s+exists\s+)?`?(\w+)`?(\s+cascade|\s+restrict)?", text, re.I):
        catalog.drop_database(m[2], bool(m[1]), "cascade" in (m[3] or "").lower())
        return _done(catalog, result=f"dropped {m[2]}")
    if m := re.fullmatch(r"use\s+(?:database\s+|schema\s+)?`?(\w+)`?", text, re.I):
        catalog.use(m[1])
        return _done(catalog, result=m[1])
    if m := re.fullmatch(r"drop\s+table\s+(if\s+exists\s+)?([\w.`$-]+)", text, re.I):
        catalog.drop_table(m[2].replace("`", ""), bool(m[1]))
        return _done(catalog, result=f"dropped {m[2]}")
    if re.fullmatch(r"show\s+(databases|schemas|namespaces)", text, re.I):
        return catalog.spark.createDataFrame([(n,) for n in catalog.databases()], "name string")
    if m := re.fullmatch(r"show\s+tables(?:\s+(?:in|from)\s+`?(\w+)`?)?", text, re.I):
        return catalog.spark.createDataFrame([(n,) for n in catalog.tables(m[1])], "name string")
    if m := re.fullmatch(r"show\s+partitions\s+([\w.`$-]+)", text, re.I):
        return catalog.table(m[1].replace("`", "")).partitions()
    if m := re.fullmatch(r"(?:describe|desc)\s+(?:table\s+)?([\w.`$-]+)", text, re.I):
        s = catalog.table(m[1].replace("`", "")).schema
        return catalog.spark.createDataFrame([(f.name, f.type, f.nullable, f.name in s.primary_key, f.name in s.partition_keys) for f in s.fields], "name string, type string, nullable boolean, primary_key boolean, partition_key boolean")
    if m := re.fullmatch(r"alter\s+table\s+([\w.`$-]+)\s+(.+)", text, re.I | re.S):
        return _alter(catalog, m[1].replace("`", ""), m[2])
    if m := re.fullmatch(r"call\s+(?:\w+\.)*(\w+)\s*\((.*)\)", text, re.I | re.S):
        return _call(catalog, m[1].lower(), [a.strip().strip("'\"") for a in _split(m[2])])
    if word in ("insert", "delete", "update", "merge", "truncate"):
        return _change(catalog, text, word)
    return query(catalog, text)


def _alter(catalog, name: str, rest: str) -> DataFrame:
    t = catalog.table(name)
    if m := re.fullmatch(r"add\s+columns?\s*\(?\s*(.+?)\s*\)?", rest, re.I | re.S):
        for part in _split(m[1]):
            column, kind = part.split(None, 1)
            after = re.search(r"\s+after\s+`?(\w+)`?$", kind, re.I)
            t.add_column(column.strip("`"), kind[: after.start()] if after else kind, after=after[1] if after else None)
    elif m := re.fullmatch(r"drop\s+columns?\s*\(?\s*(.+?)\s*\)?", rest, re.I | re.S):
        for part in _split(m[1]):
            t.drop_column(part.strip("` "))
    elif m := re.fullmatch(r"rename\s+column\s+`?(\w+)`?\s+to\s+`?(\w+)`?", rest, re.I):
        t.rename_column(m[1], m[2])
    elif m := re.fullmatch(r"alter\s+column\s+`?(\w+)`?\s+type\s+(.+)", rest, re.I):
        t.widen_column(m[1], m[2])
    elif m := re.fullmatch(r"rename\s+to\s+([\w.`]+)", rest, re.I):
        catalog.rename_table(name, m[1].replace("`", ""))
    elif m := re.fullmatch(r"set\s+tblproperties\s*\((.+)\)", rest, re.I | re.S):
        pairs = (p.partition("=") for p in _split(m[1]))
        t.set_options(**{k.strip().strip("'\""): v.strip().strip("'\"") for k, _, v in pairs})
    elif m := re.fullmatch(r"drop\s+partition\s*\((.+)\)", rest, re.I | re.S):
        pairs = (p.partition("=") for p in _split(m[1]))
        t.drop_partition({k.strip(" `"): v.strip().strip("'\"") for k, _, v in pairs})
    else:
        raise Unsupported(f"ALTER TABLE ... {rest}")
    return _done(catalog, result=f"altered {name}")


def _call(catalog, procedure: str, arguments: list[str]) -> DataFrame:
    if procedure == "create_branch":
        catalog.create_branch(arguments[0], arguments[1], tag=arguments[2] if len(arguments) > 2 else None)
    elif procedure == "drop_branch":
        catalog.drop_branch(*arguments)
    elif procedure == "list_branches":
        return catalog.spark.createDataFrame([(b,) for b in catalog.branches(arguments[0])], "branch string")
    elif procedure == "fast_forward":
        catalog.fast_forward(*arguments)
    elif procedure == "create_tag":
        catalog.table(arguments[0]).create_tag(arguments[1], int(arguments[2]) if len(arguments) > 2 else None)
    elif procedure == "compact":
        return _snapshot(catalog, catalog.table(arguments[0]).compact(full=True))
    elif procedure == "rollback":
        return _snapshot(catalog, catalog.table(arguments[0]).rollback(int(arguments[1])))
    elif procedure == "expire_snapshots":
        return _done(catalog, expired=len(catalog.table(arguments[0]).expire(int(arguments[1]) if len(arguments) > 1 else 10)))
    else:
        raise Unsupported(f"no procedure {procedure}")
    return _done(catalog, result=f"{procedure} {' '.join(arguments)}")


def _items(sequence) -> list:
    found, it = [], sequence.iterator()
    while it.hasNext():
        found.append(it.next())
    return found


def _change(catalog, text: str, word: str) -> DataFrame:
    if word == "truncate":
        m = re.fullmatch(r"truncate\s+table\s+([\w.`$-]+)", text, re.I)
        return _snapshot(catalog, catalog.table(m[1].replace("`", "")).delete())
    plan = _parse(catalog, text)
    kind = plan.getClass().getSimpleName()
    if kind == "InsertIntoStatement":
        relation = plan.table()
        t = catalog.table(_name(_parts(relation)))
        rest = text[relation.origin().stopIndex().get() + 1 :]
        columns = _items(plan.userSpecifiedCols())
        if columns:
            rest = rest[rest.index(")") + 1 :]
        names = [t.schema[c].name for c in columns] or t.schema.names
        rows = query(catalog, rest.strip())
        if len(rows.columns) != len(names):
            raise SchemaError(f"{len(rows.columns)} values for {len(names)} columns")
        rows = rows.toDF(*names)
        return _snapshot(catalog, t.overwrite(rows) if plan.overwrite() else t.write(rows))
    if kind == "DeleteFromTable":
        t = catalog.table(_name(_parts(_relation(plan.table()))))
        condition = plan.condition().sql()
        if _has_subquery(plan.condition()):
            return _snapshot(catalog, t.rewrite(lambda rows: _chosen(catalog, rows, t, text, "*", "not coalesce(({condition}), false)")))
        return _snapshot(catalog, t.delete(None if condition.lower() == "true" else condition))
    if kind == "UpdateTable":
        t = catalog.table(_name(_parts(_relation(plan.table()))))
        changes = {a.key().sql().strip("`"): F.expr(a.value().sql()) for a in _items(plan.assignments())}
        where = plan.condition().get().sql() if plan.condition().isDefined() else None
        if where and _has_subquery(plan.condition().get()) or any(_has_subquery(a.value()) for a in _items(plan.assignments())):
            raise Unsupported("subqueries in UPDATE; MERGE can say the same")
        return _snapshot(catalog, t.update(changes, where))
    if kind == "MergeIntoTable":
        return _merge(catalog, text, plan)
    raise Unsupported(f"{word.upper()}: {kind}")


def _has_subquery(expression) -> bool:
    return next(_subqueries(expression), None) is not None


def _chosen(catalog, rows: DataFrame, t, text: str, columns: str, test: str) -> DataFrame:
    """Rows of ``t`` for which ``test`` of a statement's WHERE condition, as text, holds; tables in it are those of the catalog."""
    m = re.match(r"delete\s+from\s+(?P<name>[\w.`$-]+)(?:\s+(?:as\s+)?(?P<alias>(?!where\b)\w+))?\s+where\s+(?P<condition>.*)", text, re.I | re.S)
    alias = m["alias"] or t.identifier.table
    return query(catalog, f"SELECT {columns} FROM _rows AS `{alias}` WHERE {test.format(condition=m['condition'])}", {"_rows": rows})


def _alias(node) -> str | None:
    return node.alias() if node.getClass().getSimpleName() == "SubqueryAlias" else None


def _merge(catalog, text: str, plan) -> DataFrame:
    target = _relation(plan.targetTable())
    t = catalog.table(_name(_parts(target)))
    given = plan.sourceTable()
    inner = given.child() if _alias(given) else given
    if inner.getClass().getSimpleName() == "UnresolvedRelation":
        name = _name(_parts(inner))
        source = catalog.read(name) if catalog.table_exists(Identifier.parse(name, catalog.current)) else catalog.spark.table(name)
        using = _alias(given) or _parts(inner)[-1]
    else:
        m = re.search(r"\busing\s*\(", text, re.I)
        source = query(catalog, text[m.end() : _closing(text, m.end() - 1)])
        using = _alias(given)
    names = t.schema.names
    own = {c.lower() for c in source.columns}

    def clause(action) -> tuple:
        condition = F.expr(action.condition().get().sql()) if action.condition().isDefined() else None
        kind = action.getClass().getSimpleName()
        if kind == "DeleteAction":
            return condition, None
        if kind in ("UpdateStarAction", "InsertStarAction"):
            return condition, {n: F.col(f"`{using}`.`{n}`") for n in names if n.lower() in own}
        return condition, {a.key().sql().split(".")[-1].strip("`"): F.expr(a.value().sql()) for a in _items(action.assignments())}

    own_name = _alias(plan.targetTable()) or t.identifier.table
    matched, unmatched, lone = ([clause(x) for x in _items(a)] for a in (plan.matchedActions(), plan.notMatchedActions(), plan.notMatchedBySourceActions()))
    stars = all(sets is None or x.getClass().getSimpleName() == "UpdateStarAction" or not {t.schema[n].name for n in sets} & set(t.schema.primary_key) for x, (_, sets) in zip(_items(plan.matchedActions()), matched))
    keys = _equalities(plan.mergeCondition(), own_name, using, t.schema) if stars else None
    return _snapshot(catalog, t.merge_clauses(source, F.expr(plan.mergeCondition().sql()), matched, unmatched, own_name, using, lone, keys))


def _equalities(condition, target: str, using: str, schema) -> dict | None:
    """The source's columns that a condition equates with the primary key, if it asks for nothing else."""
    if condition.getClass().getSimpleName() == "And":
        sides = [_equalities(c, target, using, None) for c in _items(condition.children())]
        found = None if None in sides else {k: v for s in sides for k, v in s.items()}
    elif condition.getClass().getSimpleName() in ("EqualTo", "EqualNullSafe"):
        names = [_parts_of(c) for c in _items(condition.children())]
        by = {p[0].lower(): p[1] for p in names if p and len(p) == 2}
        found = {by[target.lower()]: F.col(f"`{by[using.lower()]}`")} if using and {target.lower(), using.lower()} == set(by) else None
    else:
        found = None
    if schema is None or found is None:
        return found
    known = {n.lower(): n for n in schema.names}
    found = {known.get(k.lower(), k): v for k, v in found.items()}
    return found if schema.primary_key and set(found) == set(schema.primary_key) else None


def _parts_of(e) -> list[str] | None:
    return _items(e.nameParts()) if e.getClass().getSimpleName() == "UnresolvedAttribute" else None


def _relation(node):
    while node.getClass().getSimpleName() != "UnresolvedRelation":
        node = node.children().head()
    return node


