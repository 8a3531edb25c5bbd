"""Breadth-first depths that are kept while the link graph grows (LG7, LG8).

A ``VersionedFolder`` whose runs hold::

    edges/     (node, next): the links a batch added
    depths/    (node, depth): the nodes whose depth the batch set or lowered

A node's depth is the least over the runs.  Added links can only lower depths,
and only behind their own targets: a batch starts from its new links' ends that
are nearer than before and follows all links from nodes that changed, until
nothing changes.  Every round is one join of the changed nodes with the links
and one with the stored depths of their targets; a run holds the changed nodes
only, and nodes that stay are never written again.  A crawl that goes on
tomorrow opens the folder and adds its links; a batch that died is added again.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .versions import VersionedFolder, new_run

_EDGES = "node string, next string"
_DEPTHS = "node string, depth int"


class DepthStore(VersionedFolder):
    SETTINGS = ("max_depth",)

    @classmethod
    def create(cls, spark: SparkSession, path: str, max_depth: int | None = None) -> DepthStore:
        return super().create(spark, path, max_depth=max_depth)

    def _edges(self, now: dict) -> DataFrame:
        return self.union([self.read_run("edges", _EDGES, r) for r in now["runs"]], _EDGES)

    def depths(self, version: int | None = None) -> DataFrame:
        """(node, depth) of every node reached so far."""
        return self._depths(self.manifest(version))

    def _depths(self, now: dict) -> DataFrame:
        rows = self.union([self.read_run("depths", _DEPTHS, r) for r in now["runs"]], _DEPTHS)
        return rows if len(now["runs"]) < 2 else rows.groupBy("node").agg(F.min("depth").alias("depth"))

    def add(self, batch_id: str, edges: DataFrame, seeds: DataFrame | None = None) -> bool:
        """Adds links ``(node, next)`` and seeds ``(node)``; False if the batch is in."""
        now = self.manifest()
        if self.holds(now, batch_id):
            return False
        checkpoint_dir(self.spark)
        run, limit = new_run(), now["max_depth"]
        edges.select("node", "next").distinct().write.parquet(f"{self.path}/{run}/edges")
        added = self.read_run("edges", _EDGES, {"path": run})
        links, before = self._edges(now).unionByName(added), self._depths(now)
        # the batch's own starts: seeds, and new links from nodes that have a depth
        near = added.join(before, "node").select(F.col("next").alias("node"), (F.col("depth") + 1).alias("depth"))
        if seeds is not None:
            near = near.unionByName(seeds.select("node", F.lit(0).alias("depth")))
        steps = []
        for _ in count():
            if limit is not None:
                near = near.where(F.col("depth") <= limit)
            near = near.groupBy("node").agg(F.min("depth").alias("depth"))
            old = before
            for s in steps:
                old = old.unionByName(s)
            # only the stored depths of the nodes in question are looked up
            old = old.join(near.select("node"), "node", "left_semi").groupBy("node").agg(F.min("depth").alias("_old"))
            changed = (near.join(old, "node", "left").where(F.col("_old").isNull() | (F.col("depth") < F.col("_old")))
                       .select("node", F.col("depth").cast("int").alias("depth")).checkpoint())
            if changed.isEmpty():
                break
            steps.append(changed)
            near = changed.join(links, "node").select(F.col("next").alias("node"), (F.col("depth") + 1).alias("depth"))
        found = self.union(steps, _DEPTHS).groupBy("node").agg(F.min("depth").cast("int").alias("depth"))
        found.write.parquet(f"{self.path}/{run}/depths")
        self._add_run(now, run, batch_id)
        return True

    def compact(self) -> bool:
        now = self.manifest()
        if len(now["runs"]) < 2:
            return False
        run = new_run()
        self._edges(now).distinct().write.parquet(f"{self.path}/{run}/edges")
        self._depths(now).write.parquet(f"{self.path}/{run}/depths")
        self._one_run(now, run)
        return True
