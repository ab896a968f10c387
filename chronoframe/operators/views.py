"""Materialized views: named queries whose rows are kept as Parquet snapshots."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.plans import filters
from chronoframe.plans.filters import Filter
from chronoframe.plans.query import Query


@dataclass
class View:
    name: str
    source: str
    query: Query
    auto_refresh: bool = False
    description: str = ""
    refreshed: float = 0.0
    version: int = 0


def _told(f: Filter) -> dict:
    """A filter as plain values."""
    values = {x.name: getattr(f, x.name) for x in fields(f)}
    if "parts" in values:
        values["parts"] = [_told(p) for p in values["parts"]]
    if "part" in values:
        values["part"] = _told(values["part"])
    return {"kind": type(f).__name__, **values}


def _made(told: dict) -> Filter:
    values = {k: v for k, v in told.items() if k != "kind"}
    if "parts" in values:
        values["parts"] = [_made(p) for p in values["parts"]]
    if "part" in values:
        values["part"] = _made(values["part"])
    return getattr(filters, told["kind"])(**values)


def definition(view: View) -> str:
    """A view as JSON; values in its filters must be such that JSON has."""
    q = view.query
    if q.aggregate is not None:
        raise ValueError("a view keeps rows: its query has no aggregate")
    query = {"filters": [_told(f) for f in q.filters], "fields": q.fields, "order": q.order, "skip": q.skip, "most": q.most, "key": q.key, "value": q.value}
    return json.dumps(asdict(replace(view, query=None)) | {"query": query})


def from_definition(text: str) -> View:
    told = json.loads(text)
    q = told["query"]
    query = Query(
        tuple(_made(f) for f in q["filters"]), tuple(q["fields"]), tuple((n, up) for n, up in q["order"]),
        q["skip"], q["most"], None, q["key"], q["value"],
    )
    return View(**(told | {"query": query}))


class Views:
    """Views of the sources that ``read`` opens by name, kept below ``path``.

    A refresh writes the next version beside the one in use, then a definition that names it,
    so a reader never sees half a view.  Definitions are files: a new ``Views`` on the same
    path has all views that are there."""

    def __init__(self, spark: SparkSession, path: str, read: Callable[[str], DataFrame]):
        self.spark, self.path, self.read = spark, path.rstrip("/"), read
        self.views: dict[str, View] = {}
        self.reload()

    def _folder(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def reload(self) -> list[str]:
        """Reads the definitions; of a view that has several the one of the last version."""
        path, files = self._folder(f"{self.path}/_definitions")
        found: dict[str, View] = {}
        if files.exists(path):
            rows = self.spark.read.option("recursiveFileLookup", "true").text(f"{self.path}/_definitions")
            for (text,) in rows.where(F.length("value") > 0).collect():
                view = from_definition(text)
                if view.name not in found or view.version > found[view.name].version:
                    found[view.name] = view
        self.views = found
        return self.names()

    def _keep(self, view: View) -> None:
        row = self.spark.createDataFrame([(definition(view),)], "value string").coalesce(1)
        row.write.mode("overwrite").text(f"{self.path}/_definitions/{view.name}/v{view.version}")

    def info(self, name: str) -> dict:
        view = self.views[name]
        return {"name": name, "source": view.source, "description": view.description, "auto_refresh": view.auto_refresh,
                "version": view.version, "refreshed": view.refreshed, "rows": self.rows(name).count()}

    def create(self, view: View) -> View:
        if view.name in self.views:
            raise ValueError(f"view {view.name!r} exists")
        self.views[view.name] = view
        self.refresh(view.name)
        return view

    def names(self) -> list[str]:
        return sorted(self.views)

    def _place(self, view: View) -> str:
        return f"{self.path}/{view.name}/v{view.version}"

    def refresh(self, name: str) -> None:
        view = self.views[name]
        view.version += 1
        view.query.page(self.read(view.source)).write.mode("overwrite").parquet(self._place(view))
        view.refreshed = time.time()
        self._keep(view)

    def refresh_source(self, source: str) -> list[str]:
        """Refreshes the views that follow writes to ``source``."""
        due = [v.name for v in self.views.values() if v.source == source and v.auto_refresh]
        for name in due:
            self.refresh(name)
        return due

    def refresh_stale(self, seconds: float) -> list[str]:
        due = [v.name for v in self.views.values() if time.time() - v.refreshed > seconds]
        for name in due:
            self.refresh(name)
        return due

    def rows(self, name: str, *filters: Filter) -> DataFrame:
        """The kept rows, or those of them that further filters leave."""
        view = self.views[name]
        kept = self.spark.read.parquet(self._place(view))
        return Query(key=view.query.key).where(*filters).page(kept) if filters else kept

    def delete(self, name: str) -> None:
        """The view goes with its definitions and rows."""
        del self.views[name]
        for folder in (f"{self.path}/_definitions/{name}", f"{self.path}/{name}"):
            path, files = self._folder(folder)
            files.delete(path, True)
