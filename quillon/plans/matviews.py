"""Materialised views as version folders.

A refresh is skipped when no version of a source is new. A definition that selects bare
columns, the key among them, from one table (rows filtered or not) is refreshed by its
changed keys only; any other is computed again. The pointer moves last, so readers see the
old rows or the new.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.store import Folder, VersionedTable

#: With more changed keys than this share of the rows a full refresh is cheaper.
SHARE = 0.3


class MaterialisedView:
    def __init__(self, spark: SparkSession, path: str, sources: Mapping[str, VersionedTable | MaterialisedView], define: Callable[[Mapping[str, DataFrame]], DataFrame], row_key: list[str] | None = None):
        """``row_key``: the source's key, if the definition maps each source row to at most
        one row that holds it; only then are refreshes incremental."""
        self.spark, self.path, self.sources, self.define, self.row_key = spark, path.rstrip("/"), dict(sources), define, row_key
        if row_key and len(self.sources) != 1:
            raise ValueError("row by row only from one table")
        self.folder = Folder(spark, path)

    def _state(self) -> dict:
        return json.loads(self.folder.read("view.json")) if self.folder.exists("view.json") else {"n": 0, "from": {}}

    def version(self) -> int:
        return self._state()["n"]

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.version() if version is None else version}")

    def refresh(self) -> str:
        """Sources that are views first. Returns how: ``skipped``, ``full`` or
        ``incremental``."""
        for source in self.sources.values():
            if isinstance(source, MaterialisedView):
                source.refresh()
        state = self._state()
        now = {name: source.version() for name, source in self.sources.items()}
        if state["n"] and state["from"] == now:
            return "skipped"
        how, rows = "full", None
        if state["n"] and self.row_key:
            rows = self._increment(state, now)
            how = "full" if rows is None else "incremental"
        if rows is None:
            rows = self.define({name: source.read(now[name]) for name, source in self.sources.items()})
        n = state["n"] + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v={n}")
        self.folder.write(json.dumps({"n": n, "from": now}), "view.json")
        return how

    def _increment(self, state: dict, now: dict) -> DataFrame | None:
        (name, source), = self.sources.items()
        if not isinstance(source, VersionedTable):
            return None
        events = source.changes().filter(f"lsn > {state['from'][name]} and lsn <= {now[name]}")
        dirty = events.select(*self.row_key).distinct()
        old = self.read(state["n"])
        if not set(self.row_key) <= set(source.key):
            return None  # the key's columns have other names now
        if dirty.count() > SHARE * max(1, old.count()):
            return None
        fresh = self.define({name: source.read(now[name]).join(dirty, self.row_key, "left_semi")})
        return old.join(dirty, self.row_key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))

    def drop(self, dependants: list[MaterialisedView] | None = None) -> None:
        """Refused while another view reads this one."""
        if any(self in d.sources.values() for d in dependants or [] if d is not self):
            raise ValueError("another materialised view depends on this one")
        self.folder.delete()
