"""Usage, quotas, caps and rate windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of one vector element.
ELEMENT = 4


def tenant_of(name: Column) -> Column:
    """The tenant in `tenant::name`, null without one."""
    return F.when(F.instr(name, "::") > 0, F.split(name, "::", 2)[0])


def usage(collections: DataFrame, counts: DataFrame) -> DataFrame:
    """tenant, collections, points from collections (name) and counts (collection, points); tenants without points count 0."""
    own = collections.select(F.col("name").alias("collection")).join(counts, "collection", "left")
    return own.groupBy(tenant_of(F.col("collection")).alias("tenant")).agg(F.count(F.lit(1)).alias("collections"), F.sum(F.coalesce("points", F.lit(0))).alias("points"))


def memory_used(collections: DataFrame, counts: DataFrame) -> DataFrame:
    """bytes: of all vectors; payloads and indexes don't count."""
    own = counts.join(collections.select(F.col("name").alias("collection"), "dimension"), "collection")
    return own.agg(F.coalesce(F.sum(F.col("points") * F.col("dimension") * ELEMENT), F.lit(0)).alias("bytes"))


def admit_first(requests: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """requests with admitted: the first `limit` of each group in their order; 0 admits all."""
    if not limit:
        return requests.withColumn("admitted", F.lit(True))
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return requests.withColumn("admitted", turn <= limit)


def minute(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / 60)


def rate_limited(requests: DataFrame, limit: int, tenant: str = "tenant", ts: str = "ts", order: str = "seq") -> DataFrame:
    """requests with admitted: up to `limit` of a tenant in a calendar minute. Rejected ones don't count, so these are the first."""
    own = requests.withColumn("minute", minute(F.col(ts)))
    return admit_first(own, [tenant, "minute"], [ts, order], limit).drop("minute")


def rate_windows(requests: DataFrame, limit: int, tenant: str = "tenant", ts: str = "ts") -> DataFrame:
    """tenant, minute, admitted and rejected; a partial aggregation, so a busy tenant is a row a task."""
    own = requests.groupBy(F.col(tenant).alias("tenant"), minute(F.col(ts)).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    admitted = F.least("n", F.lit(limit)) if limit else F.col("n")
    return own.select("tenant", "minute", admitted.cast("bigint").alias("admitted"), (F.col("n") - admitted).cast("bigint").alias("rejected"))
