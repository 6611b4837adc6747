"""Rate windows of tenants and rolling rates, over streams or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windows(requests: DataFrame, limit: int, retention: str = "60 minutes", tenant: str = "tenant", ts: str = "ts") -> DataFrame:
    """tenant, minute (its start), admitted, rejected in calendar minutes. On a stream, a window's state goes once it is `retention` behind the newest event."""
    own = requests.withWatermark(ts, retention) if requests.isStreaming else requests
    own = own.groupBy(F.col(tenant).alias("tenant"), F.window(ts, "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    admitted = F.least("n", F.lit(limit)) if limit else F.col("n")
    return own.select("tenant", F.col("w.start").alias("minute"), admitted.cast("bigint").alias("admitted"), (F.col("n") - admitted).cast("bigint").alias("rejected"))


def follow(windows_: DataFrame, path: str, checkpoint: str, available_now: bool = False, interval: str = "1 second") -> StreamingQuery:
    """Writes the windows that each micro-batch changes to a folder of its own; a batch that runs again overwrites its own. In update mode
    the state of windows behind the watermark is dropped, so it is bounded by the retention."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = windows_.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def newest(spark: SparkSession, path: str) -> DataFrame:
    """tenant, minute, admitted and rejected of each window, as the last batch that changed it left it."""
    last = F.max_by(F.struct("admitted", "rejected"), "batch").alias("last")
    return spark.read.parquet(path).groupBy("tenant", "minute").agg(last).select("tenant", "minute", "last.admitted", "last.rejected")


def rolling(events: DataFrame, by: str, window: str = "5 minutes", slide: str = "1 minute", retention: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """by, start and events of sliding windows."""
    own = events.withWatermark(ts, retention) if events.isStreaming else events
    return own.groupBy(by, F.window(ts, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(by, F.col("w.start").alias("start"), "events")
