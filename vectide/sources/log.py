"""The mutation log: batches of mutations under one root, snapshots, and the state they give.

    root/log/<version>/   Parquet of a batch; committed by renaming its folder to the next free version
    root/snapshot/<v>/    points and collections as of version v
    root/CURRENT          the version of the snapshot to start from

Load: the snapshot and the batches after it, folded. A batch is all or nothing. Two writers that take the same version can't
both rename to it: the second fails and leaves the state as it is.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COLLECTIONS, CREATE, MUTATION_KINDS, MUTATIONS, PAYLOAD, POINTS, UPSERT
from ..operators.mutations import fold, fold_collections
from .store import Store


@dataclass(frozen=True)
class State:
    collections: DataFrame
    points: DataFrame
    version: int


class MutationLog:
    def __init__(self, spark: SparkSession, root: str, compact_after: int = 64):
        self.spark, self.store, self.compact_after = spark, Store(spark, root), compact_after

    def snapshot_version(self) -> int:
        return int(self.store.read_text("CURRENT")) if self.store.exists("CURRENT") else 0

    def versions(self) -> list[int]:
        return [int(n) for n in self.store.names("log") if n.isdigit()]

    def version(self) -> int:
        return max([self.snapshot_version(), *self.versions()])

    def append(self, batch: DataFrame, expected: int | None = None) -> int:
        """Writes a batch of mutations (without version; ord orders it) and returns its version. expected: the version the caller has read."""
        version = (self.version() if expected is None else expected) + 1
        temp = f"tmp/{uuid.uuid4().hex}"
        batch.withColumn("version", F.lit(version).cast("bigint")).select(*MUTATION_KINDS).write.parquet(self.store.path(temp))
        self.store.make("log")
        try:
            self.store.move_new(temp, f"log/{version:012d}")
        finally:
            self.store.delete(temp)
        return version

    def mutations(self, after: int = 0) -> DataFrame:
        """The log's batches over a version."""
        paths = [self.store.path(f"log/{v:012d}") for v in self.versions() if v > after]
        return self.spark.read.schema(MUTATIONS).parquet(*paths) if paths else self.spark.createDataFrame([], MUTATIONS)

    def load(self) -> State:
        base = self.snapshot_version()
        newer = [v for v in self.versions() if v > base]
        log = self.mutations(base)
        if base:
            log = as_mutations(*self.read_snapshot(base)).unionByName(log)
        return State(fold_collections(log), fold(log).select("collection", "id", "values", "payload"), max([base, *newer]))

    def read_snapshot(self, version: int) -> tuple[DataFrame, DataFrame]:
        at = self.store.path(f"snapshot/{version:012d}")
        return self.spark.read.schema(COLLECTIONS).parquet(f"{at}/collections"), self.spark.read.schema(POINTS).parquet(f"{at}/points")

    def compact(self) -> int:
        """Writes the state as a snapshot, then points CURRENT to it, then drops the batches it holds."""
        state = self.load()
        name = f"snapshot/{state.version:012d}"
        if state.version == self.snapshot_version():
            return state.version
        self.store.delete(name)
        state.collections.write.parquet(f"{self.store.path(name)}/collections")
        # points of a collection lie together, in id order: its scans and id look-ups skip row groups
        state.points.repartitionByRange("collection", "id").sortWithinPartitions("collection", "id").write.parquet(f"{self.store.path(name)}/points")
        self.store.write_text("CURRENT", str(state.version))
        for v in self.versions():
            if v <= state.version:
                self.store.delete(f"log/{v:012d}")
        for old in self.store.names("snapshot"):
            if int(old) < state.version:
                self.store.delete(f"snapshot/{old}")
        return state.version

    def compact_if_due(self) -> bool:
        if len([v for v in self.versions() if v > self.snapshot_version()]) < self.compact_after:
            return False
        self.compact()
        return True

    def backlog(self) -> dict[str, int]:
        """Batches and bytes that aren't in the snapshot."""
        newer = [v for v in self.versions() if v > self.snapshot_version()]
        return {"segments": len(newer), "bytes": sum(self.store.size(f"log/{v:012d}") for v in newer), "snapshot_version": self.snapshot_version()}


def as_mutations(collections: DataFrame, points: DataFrame) -> DataFrame:
    """A snapshot as creates and upserts of version 0."""
    zero = [F.lit(0).cast("bigint").alias("version")]
    creates = collections.select(*zero, F.lit(0).cast("bigint").alias("ord"), F.lit(CREATE).alias("op"), F.col("name").alias("collection"), F.lit(None).cast("bigint").alias("id"), "dimension", "strict_finite", F.lit(None).cast("array<float>").alias("values"), F.lit(None).cast(PAYLOAD).alias("payload"))
    upserts = points.select(*zero, F.lit(1).cast("bigint").alias("ord"), F.lit(UPSERT).alias("op"), "collection", "id", F.lit(None).cast("int").alias("dimension"), F.lit(None).cast("boolean").alias("strict_finite"), "values", "payload")
    return creates.unionByName(upserts)
