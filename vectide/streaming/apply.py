"""The mutation log as a stream: each micro-batch is merged into a table of the last mutation of every point.

Tombstones stay in the table with their place in the log, so late and repeated records change nothing: a record counts only if
it is newer than what is known of its point. A batch writes a new version of the buckets it touches, under a name of its own for
each attempt, and then one file, PLACES, with the epoch and where each bucket is: an epoch counts with that file or not at all. One
that runs again after a failure reads what the last whole epoch has left, and what a lost attempt has written is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import DELETE, MUTATION_KINDS, MUTATIONS, REMOVE, UPSERT
from ..sources.store import Store

COLUMNS = ("version", "ord", "op", "collection", "id", "values", "payload")
#: Buckets of the table, by hash of (collection, id): a merge rewrites only those that a batch touches.
BUCKETS = 32


def bucket():
    return F.pmod(F.xxhash64("collection", "id"), F.lit(BUCKETS)).cast("int")


class AppliedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def _state(self) -> tuple[int, dict[int, str]]:
        """The last epoch, and where each bucket's newest version is."""
        if not self.store.exists("PLACES"):
            return -1, {}
        first, *rest = self.store.read_text("PLACES").splitlines()
        return int(first), {int(b): p for b, _, p in (line.partition(" ") for line in rest)}

    def epoch(self) -> int:
        return self._state()[0]

    def _places(self) -> dict[int, str]:
        return self._state()[1]

    def table(self, buckets: list[int] | None = None) -> DataFrame:
        places = [p for b, p in self._places().items() if buckets is None or b in buckets]
        schema = ", ".join(f"{n} {MUTATION_KINDS[n]}" for n in COLUMNS)
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.store.path(p) for p in sorted(places)])

    def deletions(self) -> DataFrame:
        return self.table([-1])

    def points(self) -> DataFrame:
        """Live points, as a fold of the whole log would give them."""
        every = list(self._places())
        own = self.table([b for b in every if b >= 0]).where(F.col("op") == UPSERT)
        gone = self.deletions().groupBy("collection").agg(F.max(F.struct("version", "ord")).alias("gone"))
        own = own.join(gone, "collection", "left").where(F.col("gone").isNull() | (F.struct("version", "ord") > F.col("gone")))
        return own.select("collection", "id", "values", "payload")

    def merge(self, batch: DataFrame, epoch: int) -> None:
        """foreachBatch: idempotent for an epoch."""
        if epoch <= self.epoch():
            return
        own = batch.where(F.col("op").isin(UPSERT, REMOVE, DELETE)).select(*COLUMNS).withColumn("bucket", F.when(F.col("op") == DELETE, F.lit(-1)).otherwise(bucket()))
        own = own.persist()
        try:
            touched = sorted(r["bucket"] for r in own.select("bucket").distinct().collect())  # at most BUCKETS + 1
            places = self._places()
            if touched:
                old = self.table(touched).withColumn("bucket", F.when(F.col("op") == DELETE, F.lit(-1)).otherwise(bucket()))
                last = F.row_number().over(Window.partitionBy("bucket", "collection", "id").orderBy(F.col("version").desc(), F.col("ord").desc()))
                merged = old.unionByName(own).withColumn("turn", last).where("turn = 1").drop("turn")
                name = f"epoch-{epoch:012d}-{uuid.uuid4().hex}"
                merged.write.partitionBy("bucket").parquet(self.store.path(name))
                places |= {b: f"{name}/bucket={b}" for b in touched}
            self.store.write_text("PLACES", "".join([f"{epoch}\n", *(f"{b} {p}\n" for b, p in sorted(places.items()))]))
            for old_name in self.store.names():
                if old_name.startswith("epoch-") and not any(p.startswith(f"{old_name}/") for p in places.values()):
                    self.store.delete(old_name)
        finally:
            own.unpersist()


def follow(spark: SparkSession, log_path: str, table: AppliedTable, checkpoint: str, available_now: bool = False, interval: str = "1 second") -> StreamingQuery:
    """Follows a folder of mutation batches (Parquet of MUTATIONS)."""
    stream = spark.readStream.schema(MUTATIONS).option("recursiveFileLookup", "true").parquet(log_path)
    writer = stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
