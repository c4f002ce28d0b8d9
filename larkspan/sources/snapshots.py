"""Tables that are switched as one: versions in folders of their own, and a marker that commits a version.

A writer writes all tables of a version to a new folder, then names it in a marker, which appears by one rename. Readers take the newest marker, so that they see all
tables of one version or of the next, never some of each, and a writer that fails leaves the old version as it is. A version has the number of the batch that made it;
the same batch again changes nothing. Folders that the last ``KEPT`` markers don't name go, with their markers.

``Folded`` is a table that grows by batches: each adds a small part, and every ``PARTS`` parts are folded into one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Versions that readers may still be reading; parts of a folded table.
KEPT, PARTS = 3, 8


class GateError(ValueError):
    """What is to be written breaks a check; nothing was committed."""

    def __init__(self, found: dict[str, dict[str, Any]]) -> None:
        super().__init__("; ".join(f"{table}: {name}: {n}" for table, counts in found.items() for name, n in counts.items() if name != "rows"))
        self.found = found


@dataclass
class Store:
    """The versions below a folder that writers and readers share."""

    spark: SparkSession
    root: str
    kept: int = KEPT
    #: Rows and broken checks of the last version that was written, by table.
    counts: dict[str, dict[str, Any]] = field(default_factory=dict)

    def _path(self, *parts: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))

    @property
    def _fs(self) -> Any:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _markers(self) -> list[str]:
        return [m for m in self._listed("markers") if not m.startswith((".", "_"))]

    def _marker(self, name: str) -> dict[str, Any]:
        stream = self._fs.open(self._path("markers", name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> dict[str, Any] | None:
        """The newest marker: batch and, by table, its folders and schema."""
        markers = self._markers()
        return self._marker(markers[-1]) if markers else None

    def read(self, name: str) -> DataFrame:
        """A table of the newest version."""
        marker = self.current()
        if marker is None or name not in marker["tables"]:
            raise ValueError(f"no version of {name} in {self.root}")
        return self._table(marker, name)

    def _table(self, marker: dict[str, Any], name: str) -> DataFrame:
        table = marker["tables"][name]
        return self.spark.read.schema(table["schema"]).parquet(*(f"{self.root.rstrip('/')}/data/{p}" for p in table["folders"]))

    def _written(self, name: str, rows: DataFrame, checks: dict[str, Column]) -> str:
        """The folder of a table, written by one job that counts rows and broken checks on its way."""
        folder, seen = f"{uuid.uuid4().hex}/{name}", Observation()
        broken = [F.count_if(F.coalesce(bad, F.lit(False))).alias(f"check_{i}") for i, bad in enumerate(checks.values())]
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), *broken).write.parquet(f"{self.root.rstrip('/')}/data/{folder}")
        found = seen.get
        self.counts[name] = {"rows": found["rows"]} | {c: found[f"check_{i}"] for i, c in enumerate(checks) if found[f"check_{i}"]}
        return folder

    def publish(self, tables: dict[str, DataFrame], *, batch: int | None = None, checks: dict[str, dict[str, Column]] | None = None, least: dict[str, int] | None = None) -> bool:
        """Write all tables and switch to them; whether that was done (not for a batch that is there already).

        checks: by table, names and conditions that no row may meet; least: the rows that a table has at least. What is broken ends the job with ``GateError`` before anything is switched.
        """
        before = self.current()
        number = batch if batch is not None else 0 if before is None else before["batch"] + 1
        if before is not None and number <= before["batch"]:
            return False
        self.counts = {}
        folders = {name: self._written(name, rows, (checks or {}).get(name, {})) for name, rows in tables.items()}
        for name, n in (least or {}).items():
            if self.counts[name]["rows"] < n:
                self.counts[name]["rows too few"] = self.counts[name]["rows"]
        if any(len(c) > 1 for c in self.counts.values()):
            for folder in folders.values():
                self._fs.delete(self._path("data", folder.split("/")[0]), True)
            raise GateError({t: c for t, c in self.counts.items() if len(c) > 1})
        self._commit(number, {name: ([folders[name]], rows) for name, rows in tables.items()})
        return True

    def _commit(self, number: int, written: dict[str, tuple[list[str], DataFrame]]) -> None:
        tables = {name: {"folders": folders, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)} for name, (folders, rows) in written.items()}
        made = self._path("markers", f".{uuid.uuid4().hex}")
        stream = self._fs.create(made, False)
        stream.write(bytearray(json.dumps({"batch": number, "tables": tables}).encode()))
        stream.close()
        jvm = self.spark._jvm
        renames = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        renames.rename(made, self._path("markers", f"{number:020}"), none)  # fails if another writer was first
        self._vacuum()

    def _vacuum(self) -> None:
        markers = self._markers()
        for old in markers[: -self.kept]:
            self._fs.delete(self._path("markers", old), False)
        named = {p.split("/")[0] for m in markers[-self.kept :] for t in self._marker(m)["tables"].values() for p in t["folders"]}
        for folder in self._listed("data"):
            if folder not in named:
                self._fs.delete(self._path("data", folder), True)


@dataclass
class Folded:
    """A table that batches add to; ``fold`` brings rows of several batches together and may be applied again and again."""

    store: Store
    name: str
    fold: Callable[[DataFrame], DataFrame]
    parts: int = PARTS

    def add(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``: a part for this batch; a batch that is run again changes nothing."""
        before = self.store.current()
        if before is not None and number <= before["batch"]:
            return
        rows = self.fold(batch)
        old = before["tables"][self.name]["folders"] if before else []
        if len(old) + 1 >= self.parts:
            rows, old = self.fold(rows.unionByName(self.store._table(before, self.name))), []
        folder = self.store._written(self.name, rows, {})
        self.store._commit(number, {self.name: ([*old, folder], rows)})

    def read(self) -> DataFrame:
        return self.fold(self.store.read(self.name))
