"""Mixing sources to target weights, by DataFrame operations only.

Sizes are words; a null text has none. Sources stand in code point order, null as the last source, and take the weights
in turn. The mix has `share` of all words. A source's target is its part by weight, at most `most` times its words; what
is cut off goes to the others by weight, until none is above: the targets are min(most * size, level * weight) for the one
level at which they sum up. The level comes from running sums over the sources in the order in which they fill up.

A source's rate is target / size. Each document is taken floor(rate) times, and once more if the first 52 bits of
md5(seed:doc_id), as a fraction, are below rate's own fraction. So reruns and repeated rows agree, whatever the partitions.
A source without words has the target 0 and rate 0. An empty table gives an empty mix. Other columns aren't read, or passed on by
`mix` whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "mix"
#: Sources up to which their rates are broadcast; with more, a shuffle join (AQE splits a hot source).
SOURCES = 100_000


def n_words(text: str = "text") -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text."""
    return F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target, rate from (source, size) rows. The windows run over one row a source."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * most
    first = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({
        "filled": F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "left": F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "whole": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)),
    })
    # the level if exactly the sources before this one were full; the first that doesn't fill at it sets it
    level = (F.col("whole") - F.col("filled")) / F.col("left")
    own = own.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct(cap / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())["level"])
    target = F.coalesce(F.least(cap.cast("double"), F.col("level") * F.col("weight")), cap.cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return own.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A fraction in [0, 1) that depends on the key and the seed alone; a null key counts as the text `null`."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_copies(sized: DataFrame, seed: str = SEED, **plan) -> DataFrame:
    """sized (doc_id, source, size and more) with source_size, target and copies; rows keep their number."""
    rates = small(targets(sized.select("source", "size"), **plan), SOURCES).withColumnRenamed("source", "own_source")
    joined = sized.join(rates, sized["source"].eqNullSafe(rates["own_source"]), "left").drop("own_source")
    extra = (draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", F.floor("rate") + extra).drop("rate")


def mix_counts(docs: DataFrame, seed: str = SEED, **plan) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words taken, repeats counted) of every document."""
    sized = materialize(docs.select("doc_id", "source", n_words().alias("size")), "mix-sizes")
    mixed = with_copies(sized, seed, **plan)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, seed: str = SEED, **plan) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # whatever the columns are called
    sized = materialize(docs.select("source", n_words().alias("size")), "mix-sizes")
    rates = small(targets(sized, **plan), SOURCES).select("source", "rate")
    joined = own.join(rates, F.col("row.source").eqNullSafe(F.col("source")), "left")
    copies = F.floor("rate") + (draw(F.col("row.doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("copy")).select("row.*")
