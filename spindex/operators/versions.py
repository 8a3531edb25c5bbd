"""Versioned folders: immutable runs and a manifest that names the current ones.

A *run* is a folder of tables that never changes once a manifest names it.
Every change ends in one atomic step, a new manifest, so readers resolve the
manifest once and finish on the version they began with, and a job that dies
half-way leaves nothing behind that anybody reads.  Batches are known by id; one
that a run already holds is refused, so a replay changes nothing.  There is
one writer at a time; a second one fails at its manifest.

Layout: ``manifest/<version>.json`` and ``run-<id>/<table>/``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import file_system, list_names, read_text, write_new_text


def new_run() -> str:
    return f"run-{uuid.uuid4().hex}"


class VersionedFolder:
    """Subclasses list the settings that are part of the stored data."""

    SETTINGS: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, **settings):
        """A new, empty folder; its settings are stored and read back with it."""
        made = cls(spark, path)
        if made.versions():
            raise ValueError(f"{path} already holds a {cls.__name__}")
        made._commit(0, settings | {"runs": []})
        return made

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in list_names(self.spark, f"{self.path}/manifest")
                      if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """The current manifest, or that of an older version."""
        if version is None:
            version = self.versions()[-1]
        return json.loads(read_text(self.spark, f"{self.path}/manifest/{version:012d}.json")) | {"version": version}

    def holds(self, manifest: dict, batch_id: str) -> bool:
        return any(batch_id in r["batches"] for r in manifest["runs"])

    def _commit(self, version: int, content: dict) -> None:
        content = {k: content[k] for k in (*self.SETTINGS, "runs")}
        write_new_text(self.spark, f"{self.path}/manifest/{version:012d}.json", json.dumps(content))

    def _add_run(self, now: dict, run: str, batch_id: str, **more) -> None:
        self._commit(now["version"] + 1, now | {"runs": [*now["runs"], {"path": run, "batches": [batch_id], **more}]})

    def _one_run(self, now: dict, run: str, **more) -> None:
        """The given run takes the place of all of ``now``'s."""
        batches = [b for r in now["runs"] for b in r["batches"]]
        self._commit(now["version"] + 1, now | {"runs": [{"path": run, "batches": batches, **more}]})

    def read_run(self, name: str, schema: str, run: dict) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{run['path']}/{name}")

    def union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes the runs that none of the last ``keep`` manifests names, and
        older manifests.  Returns the removed runs."""
        versions = self.versions()
        kept = {r["path"] for v in versions[-keep:] for r in self.manifest(v)["runs"]}
        fs, path = file_system(self.spark, self.path)
        gone = [n for n in list_names(self.spark, self.path) if n.startswith("run-") and n not in kept]
        for v in versions[:-keep]:
            fs.delete(path(f"{self.path}/manifest/{v:012d}.json"), False)
        for n in gone:
            fs.delete(path(f"{self.path}/{n}"), True)
        return gone
