"""Mutations over DataFrames: which upserts create, the state after a log, and payload patches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions.vector import all_finite
from ..model import CREATE, DELETE, REMOVE, UPSERT
from ..plans.sizes import broadcast_if_small


def fold(log: DataFrame) -> DataFrame:
    """Live points (collection, id, values, payload, version, ord) of a log: the last mutation of each point counts, if it is an
    upsert and its collection hasn't been deleted since. One exchange by (collection, id), to which a task sends the last row of each."""
    deleted = log.where(F.col("op") == DELETE).groupBy("collection").agg(F.max(F.struct("version", "ord")).alias("gone"))
    own = log.where(F.col("op").isin(UPSERT, REMOVE)).join(broadcast_if_small(deleted), "collection", "left")  # a row a deleted collection
    own = own.where(F.col("gone").isNull() | (F.struct("version", "ord") > F.col("gone")))
    last = F.row_number().over(Window.partitionBy("collection", "id").orderBy(F.col("version").desc(), F.col("ord").desc()))
    return own.withColumn("turn", last).where((F.col("turn") == 1) & (F.col("op") == UPSERT)).select("collection", "id", "values", "payload", "version", "ord")


def fold_collections(log: DataFrame) -> DataFrame:
    """Live collections (name, dimension, strict_finite): the last create or delete of each name; creates without a dimension are passed over."""
    own = log.where((F.col("op") == DELETE) | ((F.col("op") == CREATE) & (F.col("dimension") > 0)))
    # repeated creates change nothing: the first after the last delete has the configuration
    last = own.groupBy("collection").agg(F.max(F.when(F.col("op") == DELETE, F.struct("version", "ord"))).alias("gone"))
    kept = own.where(F.col("op") == CREATE).join(last, "collection").where(F.col("gone").isNull() | (F.struct("version", "ord") > F.col("gone")))
    first = kept.groupBy("collection").agg(F.min(F.struct("version", "ord", "dimension", "strict_finite")).alias("c"))
    return first.select(F.col("collection").alias("name"), "c.dimension", "c.strict_finite")


def faults(log: DataFrame) -> DataFrame:
    """(version, ord, reason) of records that a replay in order would stop at: points in a collection that doesn't exist then,
    wrong dimensions, and creates that contradict a live collection. Each record is joined to the life of its collection at that time."""
    turns = log.where(F.col("op").isin(CREATE, DELETE)).where((F.col("op") == DELETE) | (F.col("dimension") > 0))
    by_name = Window.partitionBy("collection").orderBy("version", "ord")
    lives = turns.withColumn("life", F.sum(F.when(F.col("op") == DELETE, 1).otherwise(0)).over(by_name))
    starts = lives.where(F.col("op") == CREATE).groupBy("collection", "life").agg(F.min(F.struct("version", "ord", "dimension", "strict_finite")).alias("start"))
    ends = turns.where(F.col("op") == DELETE).select("collection", F.struct("version", "ord").alias("end"), F.row_number().over(by_name).alias("life")).withColumn("life", F.col("life") - 1)
    alive = starts.join(ends, ["collection", "life"], "left").select(F.col("collection").alias("name"), "start", "end")
    at = F.struct(log["version"], log["ord"])
    own = log.join(broadcast_if_small(alive), (log["collection"] == F.col("name")) & (at >= F.struct("start.version", "start.ord")) & (F.col("end").isNull() | (at < F.col("end"))), "left")
    reason = (
        F.when(F.col("op").isin(UPSERT, REMOVE) & F.col("name").isNull(), "collection does not exist")
        .when((F.col("op") == UPSERT) & (F.size("values") != F.col("start.dimension")), "wrong dimension")
        .when((F.col("op") == UPSERT) & F.col("start.strict_finite") & ~all_finite(F.col("values")), "value is not finite")
        .when((F.col("op") == CREATE) & (log["dimension"] > 0) & ((log["dimension"] != F.col("start.dimension")) | (log["strict_finite"] != F.col("start.strict_finite"))), "collection exists with another configuration")
    )
    return own.select("version", "ord", reason.alias("reason")).where(F.col("reason").isNotNull())


def created_flags(current: DataFrame, batch: DataFrame) -> DataFrame:
    """batch (id, ord) with created: the id isn't in current, and this is its first row in the batch."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("ord")) == 1
    known = current.select("id", F.lit(True).alias("known")).join(batch.select("id").distinct(), "id", "left_semi")
    return batch.withColumn("first", first).join(known, "id", "left").withColumn("created", F.col("first") & F.col("known").isNull()).drop("first", "known")


def set_payload(points: DataFrame, ids: DataFrame, patch: Mapping[str, object]) -> DataFrame:
    """The points of ids (id) that a patch changes, with their new payloads."""
    own = points.join(broadcast_if_small(ids.distinct()), "id", "left_semi")
    return changed(own, P.patched(F.col("payload"), patch))


def delete_payload_keys(points: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    own = points.join(broadcast_if_small(ids.distinct()), "id", "left_semi")
    return changed(own, P.without(F.col("payload"), P.unique_keys(keys)))


def changed(points: DataFrame, payload: Column) -> DataFrame:
    key = lambda p: F.array_sort(F.map_entries(F.coalesce(p, F.create_map().cast(points.schema["payload"].dataType))))
    return points.withColumn("new", payload).where(key(F.col("payload")) != key(F.col("new"))).withColumn("payload", F.col("new")).drop("new")
