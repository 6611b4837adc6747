"""Vector functions as Columns: FLOAT storage, DOUBLE arithmetic, summed from the left.

All are Catalyst expressions, so a score is computed in the scan's own stage and unused columns are pruned.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import invalid
from ..model import Metric

#: Squared norms up to this (the machine epsilon of FLOAT) count as zero.
ZERO_NORM = 1.1920928955078125e-07
#: Queries up to this length are unrolled into one generated expression; longer ones would make methods too large to compile.
UNROLL = 16


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def squared_norm(a: Column) -> Column:
    return _fold(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where either squared norm counts as zero."""
    aa, bb = squared_norm(a), squared_norm(b)
    return F.when((aa > ZERO_NORM) & (bb > ZERO_NORM), dot(a, b) / (F.sqrt(aa) * F.sqrt(bb)))


def _unrolled(values: Column, query: Sequence[float], term) -> Column:
    total = F.lit(0.0)
    for i, q in enumerate(query):
        total = total + term(values[i].cast("double"), F.lit(float(q)))
    return total


def rank_score(values: Column, query: Sequence[float] | Column, metric: Metric) -> Column:
    """What hits are ranked by: the squared distance for L2, else the metric itself.

    A query of plain numbers becomes literals: generated code without array objects, and its norm is a constant.
    """
    if isinstance(query, Column) or len(query) > UNROLL:
        q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query]).cast("array<float>")
        return {Metric.DOT: dot, Metric.L2: l2_squared, Metric.COSINE: cosine}[metric](values, q)
    if metric == Metric.L2:
        return _unrolled(values, query, lambda x, q: (x - q) * (x - q))
    product = _unrolled(values, query, lambda x, q: x * q)
    if metric == Metric.DOT:
        return product
    norm, own = 0.0, squared_norm(values) if len(query) == 0 else _unrolled(values, query, lambda x, q: x * x)
    for q in query:
        norm += float(q) * float(q)
    if norm <= ZERO_NORM:
        return F.lit(None).cast("double")
    return F.when(own > ZERO_NORM, product / (F.sqrt(own) * F.lit(math.sqrt(norm))))


def response_value(score: Column, metric: Metric) -> Column:
    """The value a hit shows: L2 is ranked by its square."""
    return F.sqrt(score) if metric == Metric.L2 else score


def all_finite(values: Column) -> Column:
    return ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def or_null(score: Column, metric: Metric, strict_finite: bool) -> Column:
    """The score, or null if it can't be ranked: only finite scores can, and in strict collections an L2 that has overflowed.

    NaN is over every bound here. The score stands in the expression once: a filter on it would compute it again for each test.
    """
    most = math.inf if metric == Metric.L2 and strict_finite else sys.float_info.max
    return F.get(F.filter(F.array(score), lambda x: F.abs(x) <= F.lit(most)), F.lit(0))


def check_vector(values: Sequence[float], dimension: int | None = None, finite: bool = True, what: str = "vector") -> list[float]:
    """A query or point as the FLOAT values it is compared with."""
    import numpy as np

    values = list(values)
    if not values:
        raise invalid(f"{what} must not be empty")
    if dimension is not None and len(values) != dimension:
        raise invalid(f"{what} has dimension {len(values)}, expected {dimension}")
    with np.errstate(over="ignore"):
        own = [float(np.float32(x)) for x in values]
    if finite:
        for i, x in enumerate(own):
            if not math.isfinite(x):
                raise invalid(f"{what} has a value at index {i} that is not finite")
    return own


def distance(left: Sequence[float], right: Sequence[float], metric: Metric = Metric.DOT, max_dimension: int = 4096, strict_finite: bool = True) -> float:
    """The metric of two vectors, on the driver, with the same arithmetic as the Columns."""
    if len(left) > max_dimension:
        raise invalid(f"vector has dimension {len(left)}, over {max_dimension}")
    a, b = check_vector(left, None, strict_finite, "left"), check_vector(right, None, strict_finite, "right")
    if len(a) != len(b):
        raise invalid(f"dimensions differ: {len(a)} and {len(b)}")
    if metric == Metric.L2:
        return math.sqrt(_left_fold((x - y) * (x - y) for x, y in zip(a, b, strict=True)))
    product = _left_fold(x * y for x, y in zip(a, b, strict=True))
    if metric == Metric.DOT:
        return product
    aa, bb = _left_fold(x * x for x in a), _left_fold(y * y for y in b)
    if aa <= ZERO_NORM or bb <= ZERO_NORM:
        raise invalid("cosine of a zero vector is undefined")
    return product / (math.sqrt(aa) * math.sqrt(bb))


def _left_fold(terms) -> float:
    """sum() compensates since Python 3.12; this doesn't, as the Columns don't."""
    total = 0.0
    for x in terms:
        total += x
    return total
