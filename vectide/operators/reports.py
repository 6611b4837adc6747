"""Reports: recall, percentiles, histograms, regressions between two runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizes import broadcast_if_small

# The upper bounds of the latency histogram's buckets, in microseconds.
BOUNDS_US = (50, 100, 250, 500, 1_000, 2_000, 5_000, 10_000, 20_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_000_000, 5_000_000, 10_000_000)


def recall_at_k(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """qid, recall from (qid, id) rows: the share of the true hits that were found; 1 for a query without true hits."""
    size = truth.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    both = hits.select("qid", "id").join(truth.select("qid", "id"), ["qid", "id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("found"))
    return size.join(both, "qid", "left").select("qid", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"))


def mean_recall(hits: DataFrame, truth: DataFrame) -> DataFrame:
    return recall_at_k(hits, truth).agg(F.avg("recall").alias("recall"))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """For each group and q the value at position round((n - 1) * q) of the ascending values (halves up), as columns p<100q>.

    Values are counted first, so a group's window runs over its distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    counted = counted.withColumns({"upto": F.sum("n").over(w.orderBy(value)), "all": F.sum("n").over(w)})
    picks = [F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * F.lit(float(q)) + 0.5), F.col(value))).alias(f"p{round(q * 100)}") for q in qs]
    return counted.groupBy(*by).agg(*picks)


def histogram(df: DataFrame, by: Sequence[str], value: str, bounds: Sequence[int] = BOUNDS_US) -> DataFrame:
    """by, bucket (the place of the first bound not below the value; beyond the last one more), n."""
    place = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        place = F.when(F.col(value) <= bounds[i], F.lit(i)).otherwise(place)
    return df.where(F.col(value).isNotNull()).groupBy(*by, place.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_percentile(df: DataFrame, by: Sequence[str], value: str, q: float, bounds: Sequence[int] = BOUNDS_US) -> DataFrame:
    """by, percentile: the bound of the bucket in which the share q is reached (the last bound beyond it)."""
    own = histogram(df, by, value, bounds)
    w = Window.partitionBy(*by)
    own = own.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "all": F.sum("n").over(w)})
    target = F.greatest(F.lit(1.0), F.rint(F.col("all") * F.lit(float(q))))
    first = F.min(F.when(F.col("upto") >= target, F.col("bucket")))
    return own.groupBy(*by).agg(F.element_at(F.array(*[F.lit(b) for b in (*bounds, bounds[-1])]), first + 1).alias("percentile"))


def roll_up(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, n, mean, median, least and most. Values are counted first, so the median of a group looks at its distinct values."""
    x = F.col(value)
    counted = df.groupBy(*by, x.alias("x")).agg(F.count(x).alias("c"))
    w = Window.partitionBy(*by)
    counted = counted.withColumns({"upto": F.sum("c").over(w.orderBy("x")), "all": F.sum("c").over(w)})
    low, high = (F.min(F.when(F.col("upto") > place, F.col("x"))) for place in (F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)))
    middles = counted.groupBy(*by).agg(((low + high) / 2).alias("median"))
    whole = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"))
    same = F.lit(True)
    renamed = middles.withColumnsRenamed({c: f"of_{c}" for c in by})
    for c in by:
        same = same & whole[c].eqNullSafe(renamed[f"of_{c}"])
    return whole.join(renamed, same).select(*by, "n", "mean", "median", "least", "most")


#: Gates of a comparison: column, kind (least ratio, most ratio, most difference) and bound.
SOAK_GATES = (("throughput", "min_ratio", 0.95), ("p95", "max_ratio", 1.10), ("p99", "max_ratio", 1.10), ("error_rate", "max_delta", 0.001))


def compare(baseline: DataFrame, current: DataFrame, key: str, gates: Sequence[tuple[str, str, float]] = SOAK_GATES) -> DataFrame:
    """A row per baseline key and gate: baseline, current, ratio or delta, and failed. A missing key fails; a ratio to 0 doesn't."""
    names = [g[0] for g in gates]
    old = baseline.select(key, *[F.col(n).cast("double").alias(f"b_{n}") for n in names])
    new = current.select(key, *[F.col(n).cast("double").alias(f"c_{n}") for n in names], F.lit(True).alias("there"))
    parts = []
    for name, kind, bound in gates:
        b, c = F.col(f"b_{name}"), F.coalesce(F.col(f"c_{name}"), F.lit(0.0))
        measure = c - b if kind == "max_delta" else F.when(b > 0, c / b)
        bad = measure < bound if kind == "min_ratio" else measure > bound
        missing = F.col("there").isNull()
        parts.append(F.struct(F.lit(name).alias("measure"), b.alias("baseline"), F.when(~missing, c).alias("current"), F.when(~missing, measure).alias("change"), (missing | F.coalesce(bad, F.lit(False))).alias("failed")))
    return old.join(new, key, "left").select(key, F.explode(F.array(*parts)).alias("g")).select(key, "g.*")


def max_per_minute(df: DataFrame, ts: str, value: str) -> DataFrame:
    return df.groupBy(F.window(ts, "1 minute").alias("w")).agg(F.max(value).alias("most")).select(F.col("w.start").alias("minute"), "most")


def rates(samples: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """metric, window start and end, and increase per second of counters (metric, ts, value) in sliding windows."""
    own = samples.groupBy("metric", F.window("ts", window, slide).alias("w")).agg(F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return own.select("metric", F.col("w.start").alias("start"), F.col("w.end").alias("end"), ((F.col("last") - F.col("first")) / seconds).alias("rate"))


def alerts(values: DataFrame, rules: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """rule, metric, value of the rules that fire; values: (metric, value), rules: name -> (metric, '>' or '<', bound)."""
    spark = values.sparkSession
    table = spark.createDataFrame([(n, *r) for n, r in rules.items()], "rule string, metric string, side string, bound double")
    fires = ((F.col("side") == ">") & (F.col("value") > F.col("bound"))) | ((F.col("side") == "<") & (F.col("value") < F.col("bound")))
    return values.join(broadcast_if_small(table), "metric").where(fires).select("rule", "metric", "value")
