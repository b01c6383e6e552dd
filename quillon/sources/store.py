"""Versioned tables on any Hadoop file system.

A table is a folder of immutable layers, a log and a change feed. A statement writes the
rows that it puts and the keys whose rows it takes away as a layer, so what it writes follows
what it changes and not the table; after ``LAYERS`` statements the rows are written as one
layer again. It counts once its log entry (``log/<n>.json``, which names the layers of the
version) is there. The entry comes by a rename that fails where one exists, so readers see
whole statements only, of two writers of one version the second fails and changes nothing,
and what a failed statement has left is never read. Statements read the version that was
current when they began. Row events are moved to ``changes/lsn=<n>`` after the commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Layers beyond which a version is written as one.
LAYERS = 8


class Conflict(ValueError):
    """A key, reference or view condition would be violated."""


class Folder:
    """Listing, small text files and deletion through Spark's own file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm

    def _at(self, *parts: str):
        target = self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def names(self, *parts: str) -> list[str]:
        fs, target = self._at(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def exists(self, *parts: str) -> bool:
        fs, target = self._at(*parts)
        return fs.exists(target)

    def delete(self, *parts: str) -> None:
        fs, target = self._at(*parts)
        fs.delete(target, True)

    def write(self, text: str, *parts: str) -> None:
        fs, target = self._at(*parts)
        out = fs.create(target, True)
        out.write(bytearray(text.encode()))
        out.close()

    def create(self, text: str, *parts: str) -> bool:
        """A small file that must not exist; False if it does. Others see all of it or
        nothing."""
        self.write(text, "tmp", name := uuid.uuid4().hex)
        return self.move(("tmp", name), parts)

    def move(self, source: tuple[str, ...], target: tuple[str, ...]) -> bool:
        """Renames; False if the target exists or the source doesn't."""
        fs, a = self._at(*source)
        _, b = self._at(*target)
        fs.mkdirs(b.getParent())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            files.rename(fs.makeQualified(a), fs.makeQualified(b), options)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "FileNotFoundException"):
                return False
            raise
        return True

    def read(self, *parts: str) -> str:
        _, target = self._at(*parts)
        return "\n".join(r[0] for r in self.spark.read.text(str(target)).collect())


class VersionedTable:
    """A table with a primary key, unique keys and a change log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        self.path = self.folder.path
        self._entries: dict[int, dict] = {}
        if not self.versions():
            raise Conflict(f"no table at {path}")

    @classmethod
    def create(cls, df: DataFrame, path: str, key: list[str], unique: list[list[str]] | None = None, **more) -> VersionedTable:
        """A table of the rows of ``df``; repeated or null keys are an error. ``more`` is kept
        with the table: ``required`` columns, and what its user stores there."""
        table = cls.__new__(cls)
        table.spark, table.folder, table._entries = df.sparkSession, Folder(df.sparkSession, path), {}
        table.path = table.folder.path
        if table.versions():
            raise Conflict(f"{path} exists")
        meta = {"key": key, "unique": unique or [], **more}
        table._check_keys(df, meta)
        table._check_required(df, meta)
        table._commit(0, df, None, meta=meta)
        return table

    # --- versions

    def versions(self, *also: str) -> list[int]:
        return sorted(int(n[:-5]) for folder in ("log", *also) for n in self.folder.names(folder) if n.endswith(".json"))

    def version(self) -> int:
        return self.versions()[-1]

    def _entry(self, n: int) -> dict:
        if n not in self._entries:
            self._entries[n] = json.loads(self.folder.read("log" if self.folder.exists("log", f"{n}.json") else "past", f"{n}.json"))
        return self._entries[n]

    @property
    def meta(self) -> dict:
        return self._entry(self.version())["meta"]

    @property
    def key(self) -> list[str]:
        return self.meta["key"]

    @property
    def unique(self) -> list[list[str]]:
        return self.meta["unique"]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version: of each layer those whose keys no later layer takes away."""
        entry = self._entry(self.version() if version is None else version)
        schema, key = T.StructType.fromJson(entry["schema"]), entry["meta"]["key"]
        keys = T.StructType([schema[c] for c in key])
        rows = None
        for i, layer in enumerate(entry["layers"]):
            put = self.spark.read.schema(schema).parquet(f"{self.path}/layers/{layer['id']}/put")
            gone = [f"{self.path}/layers/{x['id']}/gone" for x in entry["layers"][i + 1 :] if x["gone"]]
            if gone:
                put = put.join(self.spark.read.schema(keys).parquet(*gone).distinct(), key, "left_anti").select(schema.names)
            rows = put if rows is None else rows.unionByName(put)
        return rows

    def changes(self) -> DataFrame:
        """All row events: lsn, op (PUT or DELETE) and the row, in the columns of now."""
        self._publish()
        now, groups = self._entry(self.version())["schema"], []
        for n in self.versions("past"):
            shape = self._entry(n)["schema"]
            if not groups or groups[-1][0] != shape:
                groups.append((shape, []))
            groups[-1][1].append(f"{self.path}/changes/lsn={n}")
        target, found = T.StructType.fromJson(now), None
        for shape, paths in groups:
            schema = T.StructType([*T.StructType.fromJson(shape), T.StructField("op", T.StringType()), T.StructField("lsn", T.LongType())])
            rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/changes").parquet(*paths)
            if shape != now:
                rows = rows.select(*((F.col(f.name).try_cast(f.dataType) if f.name in schema.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in target), "op", "lsn")
            found = rows if found is None else found.unionByName(rows)
        return found

    def _publish(self) -> None:
        """Moves the events of committed versions to where feeds read them; a writer that
        ended between its commit and this leaves it to the next."""
        there = set(self.folder.names("changes"))
        for n in self.versions():
            if f"lsn={n}" not in there:
                self.folder.move(("staged", self._entry(n)["id"]), ("changes", f"lsn={n}"))

    def _commit(self, base: int, put: DataFrame | None, gone: DataFrame | None, meta: dict | None = None, whole: bool = False) -> int:
        """Version ``base`` + 1: without the rows ``gone``, with the rows ``put``; or, as a
        ``whole``, of the rows ``put`` alone. Nothing counts before the log entry is there, and
        of two writers of one version the second fails."""
        name, before = uuid.uuid4().hex, self._entry(base) if base else None
        meta = meta or before["meta"]
        layer = f"{self.path}/layers/{name}"
        schema = put.schema if put is not None else T.StructType.fromJson(before["schema"])
        (put if put is not None else self.spark.createDataFrame([], schema)).write.parquet(f"{layer}/put")
        stored = self.spark.read.schema(schema).parquet(f"{layer}/put")
        events = stored.withColumn("op", F.lit("PUT"))
        if gone is not None:
            lost = gone.join(stored.select(*meta["key"]), meta["key"], "left_anti").select(*schema.names)
            events = events.unionByName(lost.withColumn("op", F.lit("DELETE")))
        events.write.parquet(f"{self.path}/staged/{name}")
        entry = {"id": name, "meta": meta, "schema": json.loads(schema.json())}
        mine = {"id": name, "gone": gone is not None and not whole}
        if mine["gone"]:
            gone.select(*meta["key"]).distinct().write.parquet(f"{layer}/gone")
        entry["layers"] = [mine] if whole or not base else [*before["layers"], mine]
        if len(entry["layers"]) > LAYERS:
            self._entries[base + 1] = entry
            rows = self.read(base + 1)
            del self._entries[base + 1]
            rows.write.parquet(f"{layer}-all/put")
            entry["layers"] = [{"id": f"{name}-all", "gone": False}]
        if not self.folder.create(json.dumps(entry), "log", f"{base + 1}.json"):
            raise Conflict("another statement has changed the table; nothing was changed")
        self._publish()
        return base + 1

    def vacuum(self, keep: int = 2) -> None:
        """Drops all but the last ``keep`` versions, and the layers that only they hold. The
        feed keeps its events."""
        self._publish()
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        used = {x["id"] for n in kept for x in self._entry(n)["layers"]}
        for n in old:
            layers = self._entry(n)["layers"]
            self.folder.move(("log", f"{n}.json"), ("past", f"{n}.json"))  # feeds need its schema
            for x in layers:
                if x["id"] not in used:
                    self.folder.delete("layers", x["id"])

    # --- constraints

    def _check_keys(self, df: DataFrame, meta: dict | None = None) -> None:
        meta = meta or self.meta
        if not df.filter(" or ".join(f"`{c}` is null" for c in meta["key"])).isEmpty():
            raise Conflict(f"null in the key {', '.join(meta['key'])}")
        for key in [meta["key"], *meta["unique"]]:
            if not df.groupBy(*key).count().filter("count > 1").filter(" and ".join(f"`{c}` is not null" for c in key)).isEmpty():
                raise Conflict(f"duplicate {', '.join(key)}")

    def _check_required(self, df: DataFrame, meta: dict | None = None) -> None:
        required = [c for c in (meta or self.meta).get("required", []) if c in df.columns]
        if required and not df.filter(" or ".join(f"`{c}` is null" for c in required)).isEmpty():
            raise Conflict(f"null in one of {', '.join(required)}")

    def _check_others(self, rows: DataFrame, others: DataFrame) -> None:
        """No key of ``rows`` is one of the ``others``."""
        for key in [self.key, *self.unique]:
            if not rows.join(others.select(*key), key, "left_semi").isEmpty():
                raise Conflict(f"duplicate {', '.join(key)}")

    def describe(self, **more) -> int:
        """Keeps more with the table, as a version of its own; the rows stay."""
        return self._commit(self.version(), None, None, {**self.meta, **more})

    def add_unique(self, columns: list[str]) -> int:
        """A further unique key; repeated values are an error."""
        meta, n = {**self.meta, "unique": [*self.unique, columns]}, self.version()
        self._check_keys(self.read(n), meta)
        return self._commit(n, None, None, meta)

    # --- statements

    def insert(self, df: DataFrame, defaults: Mapping[str, object] | None = None) -> int:
        """Appends rows; columns left out take ``defaults``, else null. A key or unique
        value that exists is an error and nothing is written."""
        n = self.version()
        now = self.read(n)
        fresh = self._shaped(df, now, defaults)
        self._check_keys(fresh)
        self._check_required(fresh)
        self._check_others(fresh, now)
        return self._commit(n, fresh, None)

    def _shaped(self, df: DataFrame, like: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
        extra = set(df.columns) - set(like.columns)
        if extra:
            raise Conflict(f"no such columns: {', '.join(sorted(extra))}")
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit((defaults or {}).get(f.name))).cast(f.dataType).alias(f.name) for f in like.schema))

    def upsert(self, df: DataFrame, updates: Mapping[str, Column] | None = None) -> int:
        """Inserts rows; where the key or a unique key exists, that row is updated instead.
        ``updates`` gives columns from the incoming row (its columns by name); by default
        all but the key take the incoming values."""
        n, keys = self.version(), [self.key, *self.unique]
        now = self.read(n)
        fresh = self._shaped(df, now)
        self._check_keys(fresh)
        value = updates if updates is not None else {c: F.col(c) for c in now.columns if c not in self.key}
        incoming = fresh.select(F.struct(*fresh.columns).alias("_in"), *fresh.columns).select("_in", *(e.alias(f"_set_{c}") for c, e in value.items()))
        old, taken = now.alias("old"), None
        for key in keys:
            on = F.lit(True)
            for c in key:
                on = on & (F.col(f"old.{c}") == F.col(f"_in.{c}"))
            pairs = old.join(incoming, on).select(F.struct(*(F.col(f"old.{c}") for c in now.columns)).alias("_old"), "_in", *(f"_set_{c}" for c in value))
            taken = pairs if taken is None else taken.unionByName(pairs.join(taken.select(F.col("_in").alias("_seen")), F.col("_in").eqNullSafe(F.col("_seen")), "left_anti"))
        changed = taken.select(*((F.col(f"_set_{c}").cast(now.schema[c].dataType) if c in value else F.col(f"_old.{c}")).alias(c) for c in now.columns))
        new = fresh.join(taken.select("_in.*").select(*self.key), self.key, "left_anti").select(*now.columns)  # keys of the incoming rows differ
        put, gone = changed.unionByName(new), taken.select("_old.*")
        self._check_keys(put)
        self._check_required(put)
        if self.unique or set(value) & set(self.key):
            self._check_others(put, now.join(gone.select(*self.key), self.key, "left_anti"))
        return self._commit(n, put, gone)

    def replace(self, df: DataFrame) -> int:
        """Deletes every row that conflicts with an incoming one, then inserts."""
        n = self.version()
        now = self.read(n)
        fresh = self._shaped(df, now)
        self._check_keys(fresh)
        self._check_required(fresh)
        hit = None
        for key in [self.key, *self.unique]:
            found = now.join(fresh.select(*key), key, "left_semi").select(*now.columns)
            hit = found if hit is None else hit.unionByName(found.join(hit.select(*self.key), self.key, "left_anti"))
        return self._commit(n, fresh, hit)

    def hit(self, where: Column | DataFrame, version: int | None = None) -> DataFrame:
        """The rows that meet a condition, or whose keys a frame holds."""
        now = self.read(version)
        return now.join(where.select(*self.key), self.key, "left_semi").select(*now.columns) if isinstance(where, DataFrame) else now.filter(where)

    def update(self, where: Column | DataFrame, assignments: Mapping[str, Column]) -> int:
        """Assignments apply from left to right: a later one sees the earlier."""
        n = self.version()
        gone = self.hit(where, n)
        put = gone
        for c, e in assignments.items():
            put = put.withColumn(c, e.cast(gone.schema[c].dataType))
        return self.change(gone, put, n, set(assignments))

    def change(self, gone: DataFrame, put: DataFrame, version: int | None = None, changed: set[str] | None = None) -> int:
        """Takes away the rows whose keys ``gone`` has, and puts others; ``changed``: the
        columns that may differ (default: any)."""
        n = self.version() if version is None else version
        self._check_required(put)
        if changed is None or changed & {c for key in [self.key, *self.unique] for c in key}:
            self._check_keys(put)
            self._check_others(put, self.read(n).join(gone.select(*self.key), self.key, "left_anti"))
        return self._commit(n, put, gone)

    def delete(self, where: Column | DataFrame) -> int:
        n = self.version()
        return self._commit(n, None, self.hit(where, n))

    # --- schema

    def alter(self, change: Callable[[DataFrame], DataFrame], renamed: Mapping[str, str] | None = None) -> int:
        """Rewrites all rows: columns added, dropped, renamed (``renamed`` names those of keys)
        or cast by ``change``. The feed gets all rows in their new shape."""
        n, to = self.version(), lambda c: (renamed or {}).get(c, c)
        rows, meta = change(self.read(n)), self.meta
        unique = [[to(c) for c in key] for key in meta["unique"]]
        meta = {**meta, "key": [to(c) for c in meta["key"]], "unique": [k for k in unique if set(k) <= set(rows.columns)], "required": [to(c) for c in meta.get("required", []) if to(c) in rows.columns]}
        return self._commit(n, rows, None, meta, whole=True)

    # --- backups

    def backup(self, path: str) -> int:
        """The current version as a snapshot folder; returns the version."""
        n = self.version()
        self.read(n).write.mode("overwrite").parquet(f"{path}/rows")
        Folder(self.spark, path).write(json.dumps({"version": n, "meta": self.meta}), "backup.json")
        return n

    def restore(self, path: str, to_lsn: int | None = None) -> int:
        """The rows of a snapshot as a new version, with the changes up to ``to_lsn``
        replayed on them. Doing it twice gives the same rows. The feed gets the rows that
        differ."""
        n = self.version()
        saved = json.loads(Folder(self.spark, path).read("backup.json"))
        rows, now = self.spark.read.parquet(f"{path}/rows"), self.read(n)
        if to_lsn is not None:
            later = self.changes().filter((F.col("lsn") > saved["version"]) & (F.col("lsn") <= to_lsn))
            rows = replay(rows, later, self.key)
        if rows.schema != now.schema or saved["meta"]["key"] != self.key:
            return self._commit(n, rows, None, saved["meta"], whole=True)
        same = F.lit(True)
        for c in now.columns:
            same = same & F.col(f"now.{c}").eqNullSafe(F.col(f"then.{c}"))
        gone = now.alias("now").join(rows.alias("then"), same, "left_anti")
        return self._commit(n, rows.alias("then").join(now.alias("now"), same, "left_anti"), gone)


def replay(base: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with row events (lsn, op, row) applied in order: the last event of a key
    wins. One shuffle on the key, with partial aggregation."""
    columns = base.columns
    last = events.groupBy(*key).agg(F.max_by(F.struct("op", *(c for c in columns if c not in key)), F.struct("lsn", (F.col("op") == "PUT").alias("put"))).alias("_last"))
    untouched = base.join(last.select(*key), key, "left_anti").select(*columns)
    put = last.filter(F.col("_last.op") == "PUT").select(*(F.col(c) if c in key else F.col(f"_last.{c}").alias(c) for c in columns))
    return untouched.unionByName(put)


# --- references -------------------------------------------------------------------------


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference has no parent (null references nothing)."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def delete_parent(parent: VersionedTable, child: VersionedTable, column: str, where: Column, action: str = "RESTRICT") -> None:
    """Deletes parents; children are refused (RESTRICT), deleted (CASCADE) or set to null
    (SET NULL)."""
    key = parent.key[0]
    gone = parent.hit(where).select(F.col(key).alias(column))
    hit = child.read().join(gone, column, "left_semi")
    if action == "RESTRICT" and not hit.isEmpty():
        raise Conflict(f"rows of the child refer to {key}")
    if action == "CASCADE":
        child.delete(hit)
    elif action == "SET NULL":
        child.update(hit, {column: F.lit(None)})
    parent.delete(where)


def checked(rows: DataFrame, condition: Column, message: str = "row is outside the view") -> DataFrame:
    """``rows``, failing when one doesn't meet ``condition`` (WITH CHECK OPTION)."""
    return rows.filter(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
