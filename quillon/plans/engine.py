"""A statement facade: SQL text in, DataFrames out.

Queries go to Spark SQL as they are, after variables are bound and clauses that Spark
lacks are taken off. Statements that change tables go to versioned tables; expressions in
them are Spark SQL expressions. Procedures are texts (``procedures``) or Python callables.
Triggers map the frame of a statement's rows, whether their bodies are texts or callables.
A statement on one table counts as a whole; what references and AFTER triggers change in
other tables are statements of their own.
"""

from __future__ import annotations

import datetime
import decimal
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import documents
from quillon.plans import procedures
from quillon.plans.matviews import MaterialisedView
from quillon.plans.procedures import Node, Run, Signal, split_top
from quillon.sources import files
from quillon.sources.catalog import columns_of, schemata_of, statistics_of, tables_of, views_of
from quillon.sources.store import Conflict, Folder, VersionedTable, checked, orphans

NAME = r"`?([A-Za-z_]\w*)`?"
#: Accepted column types. Lengths are read and not enforced.
COLUMN_TYPES = {"INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "TEXT": "string", "STRING": "string", "VARCHAR": "string", "CHAR": "string", "DATE": "date", "TIMESTAMP": "date", "BLOB": "binary"}
LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'")
VERSION = "quillon 1"
#: Queries of a batch that run at the same time.
PARALLEL = 8


class Unsupported(ValueError):
    pass


def outside(text: str, change: Callable[[str], str]) -> str:
    """``change`` applied to what isn't within quotes."""
    out, at = [], 0
    for start, end in [(m.start(), m.end()) for m in LITERAL.finditer(text)] + [(len(text), len(text))]:
        out += [change(text[at:start]), text[start:end]]
        at = end
    return "".join(out)


def _both(a: str | None, b: str | None) -> str | None:
    return f"({a}) AND {b}" if a and b else a or b


def column_type(text: str) -> str:
    m = re.match(r"(\w+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", text)
    kind = m[1].upper()
    if kind in ("DECIMAL", "NUMERIC"):
        scale = int(m[3]) if m[3] else 4
        if scale > 12:
            raise Unsupported("a decimal has 12 digits after the point at most")
        return f"decimal(18,{scale})"
    if kind not in COLUMN_TYPES:
        raise Unsupported(f"column type {kind}")
    return COLUMN_TYPES[kind]


def check_recursive(text: str) -> None:
    """The recursive term names its table once, in FROM or a join, and not within a subquery
    or an aggregate."""
    m = re.match(rf"WITH\s+RECURSIVE\s+{NAME}\s*(?:\([^()]*\))?\s*AS\s*\(", text, re.I)
    if not m:
        raise Unsupported("a recursive query")
    depth, end = 1, m.end()
    while depth and end < len(text):
        depth += {"(": 1, ")": -1}.get(text[end], 0)
        end += 1
    body = LITERAL.sub("''", text[m.end() : end - 1])
    terms = re.split(r"\bUNION(?:\s+ALL)?\b", body, flags=re.I)
    if len(terms) < 2:
        return
    own = rf"\b{m[1]}\b"
    flat, before = terms[-1], None
    while flat != before:  # what stands in brackets goes
        before, flat = flat, re.sub(r"\([^()]*\)", " ", flat)
    sources = re.findall(rf"(?:\bFROM|\bJOIN|,)\s+`?{m[1]}`?(?!\s*\.)\b", flat, re.I)
    if re.search(rf"\bSELECT\b[^()]*\bFROM\s+`?{m[1]}\b", terms[0], re.I) or len(sources) != 1:
        raise Unsupported(f"the recursive term must read {m[1]} once")
    for inner in re.findall(r"\(([^()]*)\)", terms[-1]):
        if re.search(r"\bSELECT\b", inner, re.I) and re.search(own, inner, re.I):
            raise Unsupported(f"{m[1]} within a subquery")
    if re.search(rf"\b(?:COUNT|SUM|AVG|MIN|MAX)\s*\([^()]*{own}", terms[-1], re.I):
        raise Unsupported(f"{m[1]} within an aggregate")


class Engine:
    """Tables live under ``root``. A statement that returns no rows returns None."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables: dict[str, VersionedTable] = {}
        self.views: dict[str, str] = {}
        self.checked: set[str] = set()  # views with a check option
        self.matviews: dict[str, MaterialisedView] = {}
        self.external: dict[str, DataFrame] = {}
        self.variables: dict[str, object] = {}
        self.prepared: dict[str, str] = {}
        self.procedures: dict[str, Callable] = {}
        self.routines: dict[str, tuple[list[tuple[str, str, str]], Node]] = {}
        self.triggers: dict[tuple[str, str, str], list[tuple[str, Callable]]] = {}
        self.depth, self.database = 0, "default"
        self.caching, self.cache, self.cached_at = False, {}, {}
        self.folder = Folder(spark, self.root)
        for name in self.folder.names("tables"):
            self.tables[name] = VersionedTable(spark, self._path(name))
        for name in [*self.folder.names("procedures"), *self.folder.names("triggers")]:
            if name.endswith(".sql"):
                self.execute(self.folder.read("triggers" if name.startswith("t-") else "procedures", name))

    def _path(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def register(self, name: str, df: DataFrame) -> None:
        """A read-only table."""
        self.external[name] = df

    def procedure(self, name: str, body: Callable) -> None:
        """``CALL name(...)`` runs ``body(engine, *arguments)``; what it returns is bound to
        the ``@variables`` among the arguments."""
        self.procedures[name.lower()] = body

    def trigger(self, when: str, event: str, table: str, action: Callable[[DataFrame], DataFrame | None]) -> None:
        """BEFORE actions map the rows that a statement brings; AFTER actions see them.
        Actions run in the order they were added; their own statements fire none."""
        def on(both: DataFrame) -> DataFrame | None:
            side = "NEW" if event.upper() != "DELETE" else "OLD"
            found = action(both.select(f"{side}.*"))
            if found is None or when.upper() == "AFTER":
                return None
            if event.upper() != "UPDATE":
                return found.select(F.struct(*found.columns).alias(side))
            key = self._table(table).key
            return both.select("OLD", *(F.col(f"NEW.{c}").alias(f"_{c}") for c in key)).join(found.select(F.struct(*found.columns).alias("NEW"), *(F.col(c).alias(f"_{c}") for c in key)), [f"_{c}" for c in key]).select("OLD", "NEW")

        self.triggers.setdefault((when.upper(), event.upper(), table), []).append(("", on))

    def _fire(self, when: str, event: str, table: str, both: DataFrame) -> DataFrame:
        """``both`` has a statement's rows as structs: NEW, OLD or the two. BEFORE triggers
        may change NEW. Their own statements fire none."""
        actions = self.triggers.get((when, event, table), [])
        held, self.triggers = self.triggers, {}
        try:
            for _, action in actions:
                found = action(both)
                both = found if when == "BEFORE" and found is not None else both
        finally:
            self.triggers = held
        return both

    # --- text

    def _literal(self, value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, (datetime.datetime, datetime.date)):
            return f"{'TIMESTAMP' if isinstance(value, datetime.datetime) else 'DATE'} '{value}'"
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)

    def _bound(self, text: str) -> str:
        """@variables as literals, outside quotes; an unset one is an error."""
        def value(m: re.Match) -> str:
            if m[1] not in self.variables:
                raise Unsupported(f"@{m[1]} is not set")
            return self._literal(self.variables[m[1]])

        return outside(text, lambda x: re.sub(r"@(\w+)", value, x))

    def batch(self, texts: list[str]) -> list[list]:
        """The rows of several queries, run at the same time, in the queries' order. For
        results that the driver can hold."""
        if bad := [t for t in texts if not re.match(r"\s*(SELECT|WITH|VALUES|EXPLAIN|SHOW)\b", t, re.I)]:
            raise Unsupported(f"only queries go in a batch: {bad[0]}")
        made = [self.execute(t) for t in texts]
        with ThreadPoolExecutor(PARALLEL) as pool:
            return list(pool.map(lambda df: df.collect(), made))

    def query(self, text: str) -> DataFrame:
        """A SELECT. LIMIT 0 means no limit; FOR UPDATE is ignored. With ``query_cache`` on,
        Spark keeps results until a version of any table is new."""
        if not self.caching:
            return self._query(text)
        now = {n: t.version() for n, t in [*self.tables.items(), *self.matviews.items()]}
        if now != self.cached_at:
            self._forget()
            self.cached_at = now
        name = " ".join(outside(self._bound(text), lambda x: re.sub(r"\s+", " ", x)).split(" ")).strip()
        if name not in self.cache:
            self.cache[name] = self._query(text).persist()
        return self.cache[name]

    def _forget(self) -> None:
        for df in self.cache.values():
            df.unpersist()
        self.cache.clear()

    def _caching(self, m: re.Match) -> None:
        self.caching = m[1].lower() in ("on", "1", "true")
        self._forget()

    def _query(self, text: str) -> DataFrame:
        text = re.sub(r"\s+FOR\s+UPDATE\s*$", "", self._bound(text), flags=re.I)
        text = outside(text, lambda x: re.sub(r"\bVERSION\(\)", f"'{VERSION}'", re.sub(r"\s+LIMIT\s+0\b(?!\s*\.)", "", x, flags=re.I), flags=re.I))
        for name in sorted({m[1].lower() for m in re.finditer(r"information_schema\.(\w+)", LITERAL.sub("", text), re.I)}):
            self._information_schema(name).createOrReplaceTempView(f"_information_schema_{name}")
            text = outside(text, lambda x, name=name: re.sub(rf"information_schema\.{name}\b", f"_information_schema_{name}", x, flags=re.I))
        if re.match(r"WITH\s+RECURSIVE\b", text, re.I):
            check_recursive(text)
        self._views(text)
        if re.search(r"\bJSON_\w+\(", text, re.I):
            self._json_functions()
        return self.spark.sql(text)

    def _information_schema(self, name: str) -> DataFrame:
        known = {n: t.read() for n, t in self.tables.items()} | self.external
        if name == "schemata":
            return schemata_of(self.spark)
        if name == "views":
            return views_of(self.spark, self.views)
        if name == "statistics":
            return statistics_of(self.spark, {n: t.meta for n, t in self.tables.items()})
        source = {"columns": columns_of, "tables": tables_of}.get(name)
        if not source:
            raise Unsupported(f"information_schema.{name}")
        return source(self.spark, known)

    def _views(self, text: str, held: tuple[str, ...] = ()) -> None:
        words = set(re.findall(r"[A-Za-z_]\w*", text))
        for name in words & set(self.external):
            self.external[name].createOrReplaceTempView(name)
        for name in words & set(self.tables):
            self.tables[name].read().createOrReplaceTempView(name)
        for name in words & set(self.matviews):
            self.matviews[name].read().createOrReplaceTempView(name)
        for name in words & set(self.views):
            if name in held:
                raise Unsupported(f"view {name} refers to itself")
            self._views(self.views[name], (*held, name))
            self.spark.sql(self.views[name]).createOrReplaceTempView(name)

    def _json_functions(self) -> None:
        """JSON_EXTRACT and its kin by name; JSON_SET, JSON_OBJECT and JSON_ARRAY take any
        number of arguments of one type each call."""
        def named(name: str, kind: str, f: Callable) -> None:
            @F.pandas_udf(kind)
            def batch(*series: pd.Series) -> pd.Series:
                return pd.Series([f(*row) for row in zip(*(s.astype(object).where(s.notna(), None) for s in series), strict=True)], dtype=object)

            self.spark.udf.register(name, batch)

        d = documents
        skip = lambda f: lambda x, *more: None if x is None else f(x, *more)

        def get(text: str, *paths: str) -> str | None:
            found = [d.walk(d.parse(text), d.parse_path(p)) for p in paths]
            if len(found) == 1:
                return None if found[0] is d.MISSING else d.render(found[0])
            return d.render([None if x is d.MISSING else x for x in found])

        def is_valid(text: str) -> int:
            try:
                d.parse(text)
            except d.BadDocument:
                return 0
            return 1

        def change(text: str, *pairs) -> str:
            node = d.parse(text)
            for path, value in zip(pairs[::2], pairs[1::2], strict=True):
                node = d.put(node, d.parse_path(path), d.to_node(value))
            return d.render(node)

        def count(text: str, path: str = "$") -> int | None:
            node = d.walk(d.parse(text), d.parse_path(path))
            return None if node is d.MISSING else len(node) if isinstance(node, (dict, list)) else 1

        named("json_extract", "string", skip(get))
        named("json_valid", "bigint", skip(is_valid))
        named("json_set", "string", skip(change))
        named("json_length", "bigint", skip(count))
        named("json_object", "string", lambda *xs: d.render({str(k): d.to_node(v) for k, v in zip(xs[::2], xs[1::2], strict=True)}))
        named("json_array", "string", lambda *xs: d.render([d.to_node(x) for x in xs]))
        self.spark.udf.register("json_unquote", d.unquote_function())
        self.spark.udf.register("json_type", d.kind_function())

    # --- statements

    def execute(self, text: str) -> DataFrame | None:
        text = text.strip().rstrip(";").strip()
        for pattern, run in STATEMENTS:
            if m := re.match(pattern, text, re.I | re.S):
                return run(self, m)
        if re.match(r"(SELECT|WITH|VALUES)\b", text, re.I):
            return self.query(text)
        raise Unsupported(text.split(None, 1)[0] if text else "an empty statement")

    def script(self, text: str) -> DataFrame | None:
        """Statements one after another; the last one's result."""
        out = None
        for one in split_top(text, ";"):
            out = self.execute(one)
        return out

    def _table(self, name: str) -> VersionedTable:
        if name not in self.tables:
            raise Unsupported(f"no table {name}")
        return self.tables[name]

    def _create(self, m: re.Match) -> None:
        name = m[2]
        if name in self.tables:
            if m[1]:
                return
            raise Conflict(f"{name} exists")
        fields, key, unique, required, references, indexes, defaults, counted = [], [], [], [], [], [], {}, None
        for item in split_top(m[3]):
            item = re.sub(rf"^CONSTRAINT\s+(?:{NAME}\s+)?(?=(?:PRIMARY|UNIQUE|FOREIGN)\b)", "", item, flags=re.I)
            if k := re.match(r"PRIMARY\s+KEY\s*\((.*)\)", item, re.I):
                key = [x.strip("` ") for x in k[1].split(",")]
            elif k := re.match(r"UNIQUE\s*(?:KEY|INDEX)?\s*`?\w*`?\s*\((.*)\)", item, re.I):
                unique.append([x.strip("` ") for x in k[1].split(",")])
            elif k := re.match(rf"FOREIGN\s+KEY\s*(?:{NAME}\s*)?\(\s*{NAME}\s*\)\s*(REFERENCES\b.*)$", item, re.I | re.S):
                references.append(self._reference(k[2], k[3], name))
            elif k := re.match(rf"(?:KEY|INDEX)\s+{NAME}\s*\((.*)\)", item, re.I):
                indexes.append({"name": k[1], "columns": [x.strip("` ") for x in k[2].split(",")], "unique": False})
            elif re.match(r"(?:KEY|INDEX|CONSTRAINT|FOREIGN|CHECK)\b", item, re.I):
                raise Unsupported(item)
            else:
                column, kind = item.split(None, 1)
                column = column.strip("`")
                fields.append(f"`{column}` {column_type(kind)}")
                plain = LITERAL.sub("''", kind)
                if re.search(r"\bPRIMARY\s+KEY\b", plain, re.I):
                    key = [column]
                if re.search(r"\bUNIQUE\b", plain, re.I):
                    unique.append([column])
                if re.search(r"\bNOT\s+NULL\b", plain, re.I):
                    required.append(column)
                if re.search(r"\bAUTO_INCREMENT\b", plain, re.I):
                    counted = column
                if k := re.search(r"\bDEFAULT\s+('(?:[^'\\]|\\.|'')*'|[+-]?[\w.]+(?:\(\))?)", kind, re.I):
                    defaults[column] = k[1]
                if k := re.search(r"\b(REFERENCES\b.*)$", kind, re.I | re.S):
                    references.append(self._reference(column, k[1], name))
        schema = T.StructType.fromDDL(", ".join(fields))
        self.tables[name] = VersionedTable.create(self.spark.createDataFrame([], schema), self._path(name), key or [schema[0].name], unique, required=required, defaults=defaults, counted=counted, references=references, indexes=indexes)

    def _reference(self, column: str, text: str, own: str) -> dict:
        m = re.match(rf"REFERENCES\s+{NAME}\s*\(\s*{NAME}\s*\)(.*)$", text, re.I | re.S)
        if not m or m[1] != own and m[1] not in self.tables:
            raise Unsupported(text)
        actions = {}
        for event in ("DELETE", "UPDATE"):
            k = re.search(rf"ON\s+{event}\s+(CASCADE|RESTRICT|SET\s+NULL|NO\s+ACTION)", m[3], re.I)
            actions[event] = {"NO ACTION": "RESTRICT"}.get(x := " ".join(k[1].upper().split()), x) if k else "RESTRICT"
        return {"column": column, "table": m[1], "to": m[2], "actions": actions}

    # --- references

    def _check_references(self, name: str, rows: DataFrame) -> None:
        for r in self._table(name).meta.get("references", []):
            parents = self._table(r["table"]).read().select(F.col(r["to"]))
            if r["table"] == name:  # a statement's rows may refer to each other
                parents = parents.unionByName(rows.select(F.col(r["to"])))
            if not orphans(rows, r["column"], parents, r["to"]).isEmpty():
                raise Conflict(f"{name}.{r['column']} refers to no {r['table']}.{r['to']}")

    def _children(self, name: str) -> list[tuple[str, dict]]:
        return [(child, r) for child, t in self.tables.items() for r in t.meta.get("references", []) if r["table"] == name]

    def _release(self, name: str, gone: DataFrame, level: int = 0) -> None:
        """What references to rows that are deleted ask for, deepest first. All refusals come
        before the first change."""
        if level > 64:
            raise Conflict("references go round")
        for apply in (False, True):
            for child, r in self._children(name):
                hit = self._table(child).hit(F.col(r["column"]).isNotNull()).join(gone.select(F.col(r["to"]).alias(r["column"])), r["column"], "left_semi")
                if child == name:
                    hit = hit.join(gone.select(*self._table(name).key), self._table(name).key, "left_anti")
                if hit.isEmpty():
                    continue
                action = r["actions"]["DELETE"]
                if action == "RESTRICT":
                    raise Conflict(f"{child}.{r['column']} refers to rows of {name}")
                if action == "CASCADE" and not apply:
                    self._refused(child, hit, level + 1)
                elif action == "CASCADE":
                    self._release(child, hit, level + 1)
                    self._table(child).delete(hit)
                elif apply:
                    self._table(child).update(hit, {r["column"]: F.lit(None)})

    def _refused(self, name: str, gone: DataFrame, level: int) -> None:
        """Fails where a cascade would meet a refusal further down."""
        if level > 64:
            raise Conflict("references go round")
        for child, r in self._children(name):
            hit = self._table(child).read().join(gone.select(F.col(r["to"]).alias(r["column"])), r["column"], "left_semi")
            if child == name or hit.isEmpty():
                continue
            if r["actions"]["DELETE"] == "RESTRICT":
                raise Conflict(f"{child}.{r['column']} refers to rows of {name}")
            if r["actions"]["DELETE"] == "CASCADE":
                self._refused(child, hit, level + 1)

    def _follow(self, name: str, both: DataFrame, level: int = 0) -> None:
        """What references to rows whose referenced values change (OLD to NEW) ask for."""
        if level > 64:
            raise Conflict("references go round")
        for child, r in self._children(name):
            table = self._table(child)
            moved = both.select(F.col(f"OLD.{r['to']}").alias(r["column"]), F.col(f"NEW.{r['to']}").alias("_to")).filter(~F.col(r["column"]).eqNullSafe(F.col("_to")))
            met = table.read().join(moved, r["column"])
            if met.isEmpty():
                continue
            action, columns = r["actions"]["UPDATE"], table.read().columns
            if action == "RESTRICT":
                raise Conflict(f"{child}.{r['column']} refers to rows of {name}")
            value = F.col("_to") if action == "CASCADE" else F.lit(None)
            old = F.struct(*columns).alias("OLD")
            new = F.struct(*((value.cast(table.read().schema[c].dataType) if c == r["column"] else F.col(c)).alias(c) for c in columns)).alias("NEW")
            pair = met.select(old, new)
            self._follow(child, pair, level + 1)
            table.change(pair.select("OLD.*"), pair.select("NEW.*"), changed={r["column"]})

    def _create_as(self, m: re.Match) -> None:
        if m[2] in self.tables and m[1]:
            return
        rows = self.query(m[3])
        self.tables[m[2]] = VersionedTable.create(rows, self._path(m[2]), [rows.columns[0]])

    def _drop(self, m: re.Match) -> None:
        if m[2] not in self.tables:
            if m[1]:
                return
            raise Unsupported(f"no table {m[2]}")
        self.tables.pop(m[2]).folder.delete()

    def _base(self, name: str) -> tuple[str, str | None, bool]:
        """The table that a statement on ``name`` changes, the condition that its view adds,
        and whether new rows must meet it. A view can be changed if it selects bare columns
        of one table."""
        if name not in self.views:
            return name, None, False
        m = re.match(rf"SELECT\s+(?:\*|[\w\s,`]+?)\s+FROM\s+{NAME}(?:\s+WHERE\s+(.*))?$", self.views[name], re.I | re.S)
        if not m or m[1] == name:
            raise Unsupported(f"view {name} can't be changed")
        base, where, check = self._base(m[1])
        return base, " AND ".join(f"({w})" for w in (m[2], where) if w) or None, check or name in self.checked

    def _insert(self, m: re.Match) -> None:
        mode, listed, body = m[1].upper(), m[3], m[4]
        name, inside, check = self._base(m[2])
        if m[2] in self.views and not listed:
            listed = ",".join(self.query(f"SELECT * FROM {m[2]}").columns)
        table = self._table(name)
        schema = table.read().schema
        updates = None
        if k := re.search(r"\sON\s+DUPLICATE\s+KEY\s+UPDATE\s+(.*)$", body, re.I | re.S):
            updates = {c.strip("` "): F.expr(re.sub(r"VALUES\(\s*`?(\w+)`?\s*\)", r"\1", self._bound(e), flags=re.I)) for c, e in (x.split("=", 1) for x in split_top(k[1]))}
            body = body[: k.start()]
        rows = self.spark.sql(self._bound(body)) if re.match(r"VALUES\b", body, re.I) else self.query(body)
        columns = [c.strip("` ") for c in listed.split(",")] if listed else schema.fieldNames()
        rows = rows.toDF(*columns)
        rows = rows.select(*(F.col(c).cast(schema[c].dataType).alias(c) for c in columns))
        # left-out columns take their default, else that of their type
        zero, meta = {"bigint": 0, "string": "", "binary": b""}, table.meta
        counted = meta.get("counted")
        for f in schema:
            if f.name not in columns:
                kind = f.dataType.simpleString()
                value = F.expr(d) if (d := meta.get("defaults", {}).get(f.name)) else F.current_date() if kind == "date" else F.lit(None if f.name == counted else zero.get(kind, 0))
                rows = rows.withColumn(f.name, value.cast(f.dataType))
        if counted:
            rows = self._counted(table, rows, counted)
        rows = self._fire("BEFORE", "INSERT", name, rows.select(F.struct(*schema.fieldNames()).alias("NEW"))).select("NEW.*")
        self._check_references(name, rows)
        if check and inside:
            rows = checked(rows, F.expr(inside))
        if mode == "REPLACE":
            table.replace(rows)
        elif updates is not None:
            table.upsert(rows, updates)
        else:
            table.insert(rows)
        self._fire("AFTER", "INSERT", name, rows.select(F.struct(*schema.fieldNames()).alias("NEW")))

    def _counted(self, table: VersionedTable, rows: DataFrame, column: str) -> DataFrame:
        """Numbers for the rows whose counted column is null, above all that the table has: by
        partition and place, so no row goes to one task."""
        most = max(table.read().agg(F.max(column)).first()[0] or 0, rows.agg(F.max(column)).first()[0] or 0)
        from quillon.operators.recursion import written

        held = written(self.spark, rows.withColumn("_at", F.monotonically_increasing_id()))
        part = F.shiftright("_at", 33)
        sizes = [(r["p"], r["n"]) for r in held.filter(F.col(column).isNull()).groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()]
        starts, total = [], most
        for p, n in sizes:
            starts.append((p, total))
            total += n
        if not starts:
            return held.drop("_at")
        from pyspark.sql import Window

        empty = held.filter(F.col(column).isNull()).withColumn("_p", part).join(F.broadcast(self.spark.createDataFrame(starts, "_p long, _start long")), "_p")
        empty = empty.withColumn(column, (F.col("_start") + F.row_number().over(Window.partitionBy("_p").orderBy("_at"))).cast(rows.schema[column].dataType))
        return held.filter(F.col(column).isNotNull()).select(rows.columns).unionByName(empty.select(rows.columns))

    def _where(self, text: str | None, name: str):
        if not text:
            return F.lit(True)
        text = self._bound(text)
        if not re.search(r"\bSELECT\b", text, re.I):
            return F.expr(text)
        # a condition with a subquery becomes a frame of keys
        return self.query(f"SELECT {', '.join(self._table(name).key)} FROM {name} WHERE {text}")

    def _update(self, m: re.Match) -> None:
        name, inside, check = self._base(m[1])
        table, where = self._table(name), self._where(_both(m[3], inside), name)
        assignments = {c.strip("` "): F.expr(self._bound(e)) for c, e in (x.split("=", 1) for x in split_top(m[2]))}
        n = table.version()
        old = table.hit(where, n)
        rows = old.select(F.struct(*old.columns).alias("OLD"), *old.columns)
        for c, e in assignments.items():
            rows = rows.withColumn(c, e.cast(old.schema[c].dataType))
        both = rows.select("OLD", F.struct(*old.columns).alias("NEW"))
        fired = self._fire("BEFORE", "UPDATE", name, both)
        changed = None if ("BEFORE", "UPDATE", name) in self.triggers else set(assignments)
        new = fired.select("NEW.*")
        if check and inside and not new.filter(~F.coalesce(F.expr(inside), F.lit(False))).isEmpty():
            raise Conflict(f"row is outside the view {m[1]}")
        if any(changed is None or r["column"] in changed for r in table.meta.get("references", [])):
            self._check_references(name, new)
        if any(changed is None or r["to"] in changed for _, r in self._children(name)):
            self._follow(name, fired)
        table.change(fired.select("OLD.*"), new, n, changed)
        self._fire("AFTER", "UPDATE", name, fired)

    def _delete(self, m: re.Match) -> None:
        name, inside, _ = self._base(m[1])
        table, where = self._table(name), self._where(_both(m[2], inside), name)
        n = table.version()
        gone = table.hit(where, n)
        both = gone.select(F.struct(*gone.columns).alias("OLD"))
        self._fire("BEFORE", "DELETE", name, both)
        self._release(name, gone)
        table.delete(where if not isinstance(where, DataFrame) else gone)
        self._fire("AFTER", "DELETE", name, both)

    def _alter(self, m: re.Match) -> None:
        table, change = self._table(m[1]), m[2].strip()
        if k := re.match(rf"ADD\s+(?:COLUMN\s+)?{NAME}\s+(.*)", change, re.I | re.S):
            kind = column_type(k[2])
            zero = F.lit("1970-01-01") if kind == "date" else F.lit("" if kind in ("string", "binary") else 0)
            table.alter(lambda df: df.withColumn(k[1], zero.cast(kind)))
        elif k := re.match(rf"DROP\s+(?:COLUMN\s+)?{NAME}$", change, re.I):
            if k[1] in table.key:
                raise Conflict(f"{k[1]} is of the key")
            table.alter(lambda df: df.drop(k[1]))
        elif k := re.match(rf"RENAME\s+(?:TO\s+|AS\s+)?(?!COLUMN\b){NAME}$", change, re.I):
            self._rename(m[1], k[1])
        elif k := re.match(rf"RENAME\s+COLUMN\s+{NAME}\s+TO\s+{NAME}", change, re.I):
            table.alter(lambda df: df.withColumnRenamed(k[1], k[2]), {k[1]: k[2]})
        elif k := re.match(rf"MODIFY\s+(?:COLUMN\s+)?{NAME}\s+(.*)", change, re.I | re.S):
            kind = column_type(k[2])
            table.alter(lambda df: df.withColumn(k[1], F.col(k[1]).try_cast(kind)))
        elif k := re.match(rf"ADD\s+(UNIQUE\s+)?(?:INDEX|KEY)\s+{NAME}\s*\(([^)]*)\)$", change, re.I):
            self.execute(f"CREATE {k[1] or ''}INDEX {k[2]} ON {m[1]} ({k[3]})")
        elif k := re.match(rf"DROP\s+(?:INDEX|KEY)\s+{NAME}$", change, re.I):
            self.execute(f"DROP INDEX {k[1]} ON {m[1]}")
        else:
            raise Unsupported(f"ALTER TABLE ... {change}")

    def _rename(self, old: str, new: str) -> None:
        """A table under another name; references, triggers and the folder follow."""
        if new in self.tables or not self.folder.move(("tables", old), ("tables", new)):
            raise Conflict(f"{new} exists")
        del self.tables[old]
        self.tables[new] = VersionedTable(self.spark, self._path(new))
        for table in self.tables.values():
            references = table.meta.get("references", [])
            if any(r["table"] == old for r in references):
                table.describe(references=[{**r, "table": new if r["table"] == old else r["table"]} for r in references])
        for when, event, table in [k for k in self.triggers if k[2] == old]:
            self.triggers[when, event, new] = self.triggers.pop((when, event, old))
        for name in self.folder.names("triggers"):
            text = self.folder.read("triggers", name)
            renamed = re.sub(rf"(\sON\s+)`?{old}`?(\s+FOR\s+EACH\b)", rf"\g<1>{new}\g<2>", text, count=1, flags=re.I)
            if renamed != text:
                self.folder.write(renamed, "triggers", name)

    def _view(self, m: re.Match) -> None:
        text = re.sub(r"\s+WITH\s+(?:CASCADED\s+|LOCAL\s+)?CHECK\s+OPTION$", "", m[2], flags=re.I)
        self.views[m[1]] = text
        if text != m[2]:
            self.checked.add(m[1])

    def _matview(self, m: re.Match) -> None:
        name, text = m[1], m[2]
        words = set(re.findall(r"[A-Za-z_]\w*", text))
        sources = {n: s for n, s in [*self.tables.items(), *self.matviews.items()] if n in words}

        def define(frames) -> DataFrame:
            for n, df in frames.items():
                df.createOrReplaceTempView(n)
            return self.spark.sql(text)

        simple = re.match(r"SELECT\s+([\w\s,`]+?)\s+FROM\s+`?\w+`?(\s+WHERE\s+(?!.*\bSELECT\b).*)?$", text, re.I | re.S)
        source = next(iter(sources.values()), None)
        key = source.key if simple and len(sources) == 1 and isinstance(source, VersionedTable) and set(source.key) <= {c.strip("` ") for c in simple[1].split(",")} else None
        view = MaterialisedView(self.spark, f"{self.root}/views/{name}", sources, define, key)
        view.refresh()
        self.matviews[name] = view

    def _index(self, m: re.Match) -> None:
        """A unique index is a key that is enforced; others are names of columns."""
        table, columns = self._table(m[3]), [c.strip("` ") for c in m[4].split(",")]
        if any(i["name"] == m[2] for i in table.meta.get("indexes", [])):
            raise Conflict(f"index {m[2]} exists")
        if missing := set(columns) - set(table.read().columns):
            raise Unsupported(f"no columns {', '.join(sorted(missing))}")
        if m[1]:
            table.add_unique(columns)
        table.describe(indexes=[*table.meta.get("indexes", []), {"name": m[2], "columns": columns, "unique": bool(m[1])}])

    def _drop_index(self, m: re.Match) -> None:
        table = self._table(m[2])
        found = next((i for i in table.meta.get("indexes", []) if i["name"] == m[1]), None)
        if found is None:
            raise Unsupported(f"no index {m[1]}")
        unique = [k for k in table.unique if not found["unique"] or k != found["columns"]]
        table.describe(indexes=[i for i in table.meta["indexes"] if i is not found], unique=unique)

    # --- stored programs

    def _create_procedure(self, m: re.Match) -> None:
        parameters = []
        for x in split_top(m[3]):
            k = re.match(r"(?:(IN|OUT|INOUT)\s+)?`?(\w+)`?\s+(.+)$", x, re.I | re.S)
            if not k:
                raise Unsupported(f"parameter {x}")
            parameters.append(((k[1] or "IN").upper(), k[2], k[3]))
        name = m[2].lower()
        if name in self.routines and not m[1]:
            raise Conflict(f"procedure {m[2]} exists")
        self.routines[name] = (parameters, procedures.parse(m[4]))
        if not self.folder.exists("procedures", f"{name}.sql") or m[1]:
            self.folder.write(m[0], "procedures", f"{name}.sql")

    def _drop_procedure(self, m: re.Match) -> None:
        if self.procedures.pop(m[2].lower(), None) is None and self.routines.pop(m[2].lower(), None) is None and not m[1]:
            raise Unsupported(f"no procedure {m[2]}")
        self.folder.delete("procedures", f"{m[2].lower()}.sql")

    def _cast(self, value: object, kind: str | None) -> object:
        """A value in the type that a variable was declared with."""
        if value is None or kind is None:
            return value
        name = column_type(kind)
        if name == "bigint":
            return int(decimal.Decimal(str(value)).to_integral_value(decimal.ROUND_HALF_UP)) if not isinstance(value, bool) else int(value)
        if name.startswith("decimal"):
            return decimal.Decimal(str(value)).quantize(decimal.Decimal(1).scaleb(-int(name[11:-1])), decimal.ROUND_DOWN)
        if name == "date":
            return value if isinstance(value, datetime.date) else datetime.date.fromisoformat(str(value)[:10])
        return str(value) if name == "string" else value

    def _state_of(self, e: Exception) -> str:
        return "23000" if isinstance(e, Conflict) else "42000" if isinstance(e, Unsupported) else "22012" if "DIVIDE_BY_ZERO" in str(e) else "HY000"

    def _routine(self, name: str, given: list[str], values: list) -> DataFrame | None:
        parameters, body = self.routines[name]
        if len(parameters) != len(given):
            raise Unsupported(f"{name} takes {len(parameters)} arguments")
        if self.depth >= procedures.DEPTH:
            raise Signal(procedures.OWN_ERROR, f"calls go deeper than {procedures.DEPTH}")
        run = Run(lambda x: self.query(f"SELECT ({x}) AS v").first()["v"], self.execute, lambda x: iter([tuple(r) for r in self.query(x).collect()]), self._literal, self.variables, self._cast, self._state_of)
        frame = run.frames[0]
        for (mode, parameter, kind), text, value in zip(parameters, given, values, strict=True):
            if mode != "IN" and not text.startswith("@"):
                raise Unsupported(f"{parameter} wants a @variable")
            frame.kinds[parameter.lower()] = kind
            frame.values[parameter.lower()] = self._cast(value, kind) if mode != "OUT" else None
        self.depth += 1
        try:
            run.step(body)
        finally:
            self.depth -= 1
        for (mode, parameter, _), text in zip(parameters, given, strict=True):
            if mode != "IN":
                self.variables[text[1:]] = frame.values[parameter.lower()]
        return run.result

    def _call(self, m: re.Match) -> DataFrame | None:
        name, given = m[1].lower(), split_top(m[2])
        values = [self.variables.get(x[1:]) if re.match(r"@\w+$", x) else self.query(f"SELECT {x} AS v").first()["v"] for x in given]
        if name in self.routines:
            return self._routine(name, given, values)
        body = self.procedures.get(name)
        if body is None:
            raise Unsupported(f"no procedure {m[1]}")
        out = [x[1:] for x in given if x.startswith("@")]
        found = body(self, *values)
        if isinstance(found, DataFrame) or found is None:
            return found
        self.variables.update(zip(out, found if isinstance(found, tuple) else (found,), strict=False))
        return None

    def _create_trigger(self, m: re.Match) -> None:
        name, when, event, table, order, other, text = m[1], m[2].upper(), m[3].upper(), m[4], (m[6] or "").upper(), m[7], m[8]
        self._table(table)
        if any(n == name for actions in self.triggers.values() for n, _ in actions):
            raise Conflict(f"trigger {name} exists")
        body = procedures.parse(text)
        actions = self.triggers.setdefault((when, event, table), [])
        at = len(actions)
        if order:
            found = [i for i, (n, _) in enumerate(actions) if n == other]
            if not found:
                raise Unsupported(f"no trigger {other}")
            at = found[0] + (order == "FOLLOWS")
        actions.insert(at, (name, lambda both: self._body(body, when, event, both)))
        there = self.folder.names("triggers")  # in the order in which they were made
        if not any(x.endswith(f"-{name}.sql") for x in there):
            self.folder.write(m[0], "triggers", f"t-{max((int(x.split('-')[1]) for x in there if x.startswith('t-')), default=0) + 1:06d}-{name}.sql")

    def _drop_trigger(self, m: re.Match) -> None:
        for actions in self.triggers.values():
            actions[:] = [x for x in actions if x[0] != m[2]]
        for x in self.folder.names("triggers"):
            if x.endswith(f"-{m[2]}.sql"):
                self.folder.delete("triggers", x)

    def _body(self, node: Node, when: str, event: str, both: DataFrame) -> DataFrame:
        """A trigger's body over all rows at once: NEW and OLD are columns of ``both``, and a
        condition limits what a part does to the rows that meet it."""

        def run(node: Node, both: DataFrame, inside) -> DataFrame:
            if node.kind == "block":
                for x in node.parts:
                    both = run(x, both, inside)
            elif node.kind == "if":
                arms, other = node.parts
                rest = inside
                for i, (test, body) in enumerate([*arms, ("TRUE", other)]):
                    # kept as a column: what a part changes must not change who is in it
                    column = f"_in{both.columns.__len__()}_{i}"
                    both = both.withColumn(column, rest & F.coalesce(F.expr(f"({self._bound(test)})").cast("boolean"), F.lit(False)))
                    rest = rest & ~F.col(column)
                    for x in body:
                        both = run(x, both, F.col(column))
            elif node.kind == "set" and when == "BEFORE" and event != "DELETE":
                for target, text in node.parts:
                    k = re.match(r"NEW\.`?(\w+)`?$", target.strip(), re.I)
                    if not k:
                        raise Unsupported(f"SET {target} in a trigger")
                    kind = both.schema["NEW"].dataType[k[1]].dataType
                    value = F.when(inside, F.expr(self._bound(text)).cast(kind)).otherwise(F.col(f"NEW.{k[1]}"))
                    both = both.withColumn("NEW", F.col("NEW").withField(k[1], value))
            elif node.kind == "signal":
                if not both.filter(inside).isEmpty():
                    raise Signal(node.parts[0].strip("'"), str(self.query(f"SELECT {node.text} AS v").first()["v"]))
            elif node.kind == "sql" and (k := re.match(rf"INSERT\s+INTO\s+{NAME}\s*(?:\(([^()]*)\))?\s*VALUES\s*\((.*)\)$", node.text, re.I | re.S)):
                values = [F.expr(self._bound(x)) for x in split_top(k[3])]
                columns = [c.strip("` ") for c in k[2].split(",")] if k[2] else self._table(k[1]).read().columns
                rows = both.filter(inside).select(*(v.alias(c) for v, c in zip(values, columns, strict=True)))
                view = "_trigger_rows"
                rows.createOrReplaceTempView(view)
                self.execute(f"INSERT INTO {k[1]} ({', '.join(columns)}) SELECT * FROM {view}")
            elif node.kind == "sql" and not re.search(r"\b(NEW|OLD)\.", LITERAL.sub("", node.text), re.I):
                if not both.filter(inside).isEmpty():
                    self.execute(node.text)
            else:
                raise Unsupported(f"{node.kind} {node.text} in a trigger")
            return both

        return run(node, both, F.lit(True)).select(*(c for c in ("OLD", "NEW") if c in both.columns))

    def _set(self, m: re.Match) -> None:
        self.variables[m[1]] = self.query(f"SELECT {m[2]} AS v").first()["v"]

    def _prepare(self, m: re.Match) -> None:
        self.prepared[m[1]] = m[2].replace("''", "'")

    def _run(self, m: re.Match) -> DataFrame | None:
        parts = self.prepared[m[1]].split("?")
        values = [self._literal(self.variables[x.strip().lstrip("@")]) for x in m[2].split(",")] if m[2] else []
        if len(values) != len(parts) - 1:
            raise Unsupported(f"{len(parts) - 1} parameters are wanted")
        return self.execute("".join(p + v for p, v in zip(parts, [*values, ""], strict=True)))

    def _export(self, m: re.Match) -> None:
        columns = [c.strip("` ") for c in m[2].split(",")] if m[2] else None
        rows, kind = self._table(m[1]).read(), (m[4] or "CSV").upper()
        if kind == "CSV":
            files.export_csv(rows, m[3], columns)
        else:
            {"JSON": files.export_json, "PARQUET": files.export_parquet}[kind](rows.select(*(columns or rows.columns)), m[3])

    def _import(self, m: re.Match) -> None:
        table = self._table(m[1])
        rows = files.import_csv(self.spark, m[2], table.read().schema, table.key, ignore_errors=bool(m[3]))
        table.insert(rows.join(table.read().select(*table.key), table.key, "left_anti"))

    def _dump(self, m: re.Match) -> None:
        for name, rows in files.read_dump(self.spark, "\n".join(r[0] for r in self.spark.read.text(m[1]).collect())).items():
            self.tables[name] = VersionedTable.create(rows, self._path(name), [rows.columns[0]])

    def _show(self, m: re.Match) -> DataFrame:
        what = " ".join(m[1].upper().split())
        if what == "DATABASES":
            return schemata_of(self.spark).selectExpr("schema_name AS name")
        if what == "TRIGGERS":
            rows = [(n, when, event, table) for (when, event, table), actions in self.triggers.items() for n, _ in actions]
            return self.spark.createDataFrame(sorted(rows), "name string, timing string, event string, table string")
        if what == "STATS":
            rows = [(n, t.version(), len(t.read().columns), t.read().count()) for n, t in sorted(self.tables.items())]
            return self.spark.createDataFrame(rows, "name string, version long, n_columns long, n_rows long")
        if k := re.match(rf"(?:INDEX|INDEXES|KEYS)\s+(?:FROM|IN|ON)\s+{NAME}$", m[1], re.I):
            return statistics_of(self.spark, {k[1]: self._table(k[1]).meta}).drop("table_schema")
        if k := re.match(rf"COLUMNS\s+(?:FROM|IN)\s+{NAME}$", m[1], re.I):
            return columns_of(self.spark, {k[1]: self._table(k[1]).read()}).select("column_name", "data_type")
        if k := re.match(rf"CREATE\s+TABLE\s+{NAME}$", m[1], re.I):
            return self.spark.createDataFrame([(k[1], self._definition(k[1]))], "name string, definition string")
        rows = {"TABLES": self.tables, "VIEWS": {**self.views, **self.matviews}, "PROCEDURES": {**self.procedures, **self.routines}}.get(what)
        if rows is None:
            raise Unsupported(f"SHOW {what}")
        return self.spark.createDataFrame([(n,) for n in sorted(rows)], "name string")

    def _definition(self, name: str) -> str:
        """The statement that makes a table like this one."""
        table = self._table(name)
        meta, lines, names = table.meta, [], {v: k for k, v in {"BIGINT": "bigint", "TEXT": "string", "DATE": "date", "BLOB": "binary"}.items()}
        for f in table.read().schema:
            kind = f.dataType.simpleString()
            words = [f"`{f.name}`", names.get(kind, kind.upper())]
            words += ["NOT NULL"] * (f.name in meta.get("required", [])) + ["AUTO_INCREMENT"] * (f.name == meta.get("counted"))
            if f.name in meta.get("defaults", {}):
                words += ["DEFAULT", meta["defaults"][f.name]]
            lines.append(" ".join(words))
        listed = lambda columns: ", ".join(f"`{c}`" for c in columns)
        lines.append(f"PRIMARY KEY ({listed(meta['key'])})")
        lines += [f"UNIQUE KEY ({listed(k)})" for k in meta["unique"]]
        lines += [f"KEY `{i['name']}` ({listed(i['columns'])})" for i in meta.get("indexes", []) if not i["unique"]]
        lines += [f"FOREIGN KEY (`{r['column']}`) REFERENCES `{r['table']}` (`{r['to']}`) ON DELETE {r['actions']['DELETE']} ON UPDATE {r['actions']['UPDATE']}" for r in meta.get("references", [])]
        return f"CREATE TABLE `{name}` (" + ", ".join(lines) + ")"

    def _drop_matview(self, m: re.Match) -> None:
        if m[2] not in self.matviews:
            if m[1]:
                return
            raise Unsupported(f"no materialised view {m[2]}")
        self.matviews[m[2]].drop(list(self.matviews.values()))
        del self.matviews[m[2]]

    def _use(self, m: re.Match) -> None:
        if not self.spark.catalog.databaseExists(m[1]):
            raise Unsupported(f"no database {m[1]}")
        self.database = m[1]

    def _events(self, m: re.Match) -> DataFrame:
        from quillon.streaming.changefeed import events

        return events(self._table(m[1]), int(m[2] or 0), int(m[3]) if m[3] else None)

    def _explain(self, m: re.Match) -> DataFrame:
        plan = self.query(m[1])._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.spark.createDataFrame([(x,) for x in plan.splitlines()], "plan string")


STATEMENTS: list[tuple[str, Callable]] = [
    (rf"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?{NAME}\s+AS\s+(.*)$", Engine._create_as),
    (rf"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?{NAME}\s*\((.*)\)[^)]*$", Engine._create),
    (rf"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?{NAME}$", Engine._drop),
    (rf"(INSERT|REPLACE)\s+INTO\s+{NAME}\s*(?:\(([^()]*)\))?\s*((?:VALUES|SELECT|WITH)\b.*)$", Engine._insert),
    (rf"UPDATE\s+{NAME}\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?$", Engine._update),
    (rf"DELETE\s+FROM\s+{NAME}(?:\s+WHERE\s+(.*))?$", Engine._delete),
    (rf"ALTER\s+TABLE\s+{NAME}\s+(.*)$", Engine._alter),
    (rf"CREATE\s+(UNIQUE\s+)?INDEX\s+{NAME}\s+ON\s+{NAME}\s*\(([^)]*)\)$", Engine._index),
    (rf"DROP\s+INDEX\s+{NAME}\s+ON\s+{NAME}$", Engine._drop_index),
    (rf"CREATE\s+(OR\s+REPLACE\s+)?PROCEDURE\s+{NAME}\s*\((.*?)\)\s*((?:\w+\s*:\s*)?BEGIN\b.*)$", Engine._create_procedure),
    (rf"DROP\s+PROCEDURE\s+(IF\s+EXISTS\s+)?{NAME}$", Engine._drop_procedure),
    (rf"CREATE\s+TRIGGER\s+{NAME}\s+(BEFORE|AFTER)\s+(INSERT|UPDATE|DELETE)\s+ON\s+{NAME}\s+FOR\s+EACH\s+(ROW|STATEMENT)\s+(?:(FOLLOWS|PRECEDES)\s+{NAME}\s+)?(.*)$", Engine._create_trigger),
    (rf"DROP\s+TRIGGER\s+(IF\s+EXISTS\s+)?{NAME}$", Engine._drop_trigger),
    (rf"USE\s+{NAME}$", Engine._use),
    (rf"CREATE\s+MATERIALIZED\s+VIEW\s+{NAME}\s+AS\s+(.*)$", Engine._matview),
    (rf"REFRESH\s+MATERIALIZED\s+VIEW\s+(?:CONCURRENTLY\s+)?{NAME}$", lambda self, m: self.matviews[m[1]].refresh() and None),
    (rf"DROP\s+MATERIALIZED\s+VIEW\s+(IF\s+EXISTS\s+)?{NAME}$", Engine._drop_matview),
    (rf"CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+{NAME}\s+AS\s+(.*)$", Engine._view),
    (rf"DROP\s+VIEW\s+{NAME}$", lambda self, m: self.views.pop(m[1]) and None),
    (rf"CREATE\s+DATABASE\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}$", lambda self, m: self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {m[1]}") and None),
    (rf"DROP\s+DATABASE\s+(?:IF\s+EXISTS\s+)?{NAME}$", lambda self, m: self.spark.sql(f"DROP SCHEMA IF EXISTS {m[1]} CASCADE") and None),
    (rf"CALL\s+{NAME}\s*\((.*)\)$", Engine._call),
    (r"SET\s+query_cache\s*=\s*'?(\w+)'?$", Engine._caching),
    (r"SET\s+@(\w+)\s*:?=\s*(.*)$", Engine._set),
    (rf"PREPARE\s+{NAME}\s+FROM\s+'(.*)'$", Engine._prepare),
    (rf"EXECUTE\s+{NAME}(?:\s+USING\s+(.*))?$", Engine._run),
    (rf"DEALLOCATE\s+PREPARE\s+{NAME}$", lambda self, m: self.prepared.pop(m[1]) and None),
    (rf"EXPORT\s+TABLE\s+{NAME}\s*(?:\(([^)]*)\))?\s+TO\s+'([^']*)'(?:\s+FORMAT\s+(\w+))?$", Engine._export),
    (r"IMPORT\s+MYSQLDUMP\s+FROM\s+'([^']*)'.*$", Engine._dump),
    (rf"IMPORT\s+INTO\s+{NAME}\s+FROM\s+'([^']*)'(?:\s+BATCH\s+\d+)?(\s+IGNORE\s+ERRORS)?$", Engine._import),
    (rf"BACKUP\s+TABLE\s+{NAME}\s+TO\s+'([^']*)'$", lambda self, m: self._table(m[1]).backup(m[2]) and None),
    (rf"RESTORE\s+TABLE\s+{NAME}\s+FROM\s+'([^']*)'(?:\s+TO\s+LSN\s+(\d+))?$", lambda self, m: self._table(m[1]).restore(m[2], int(m[3]) if m[3] else None) and None),
    (rf"SHOW\s+BINLOG\s+EVENTS\s+FOR\s+{NAME}(?:\s+FROM\s+(\d+))?(?:\s+LIMIT\s+(\d+))?$", Engine._events),
    (r"SHOW\s+(.+)$", Engine._show),
    (r"EXPLAIN\s+(.*)$", Engine._explain),
]
