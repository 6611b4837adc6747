"""Pages of point ids in ascending order, counts and lookups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import invalid
from ..model import Limits


@dataclass(frozen=True)
class Page:
    ids: list[int]
    total: int
    next_offset: int | None
    next_after_id: int | None


def by_offset(points: DataFrame, offset: int, limit: int) -> DataFrame:
    """Ids at [offset, offset + limit): a partial top (offset + limit), so large offsets cost; keyset paging doesn't."""
    return points.select("id").orderBy("id").offset(offset).limit(limit)


def after(points: DataFrame, after_id: int | None, limit: int) -> DataFrame:
    """The `limit` smallest ids over after_id; the comparison reaches the scan."""
    own = points.select("id")
    return (own if after_id is None else own.where(F.col("id") > after_id)).orderBy("id").limit(limit)


def page(points: DataFrame, limit: int | None = None, offset: int = 0, after_id: int | None = None, limits: Limits = Limits()) -> Page:
    limit = limits.default_page if limit is None else limit
    if not 0 < limit <= limits.max_page_limit:
        raise invalid(f"limit must be from 1 to {limits.max_page_limit}")
    if after_id is not None and offset:
        raise invalid("offset must be 0 with after_id")
    if after_id is None and not 0 <= offset <= limits.max_offset:
        raise invalid(f"offset must be from 0 to {limits.max_offset}; use after_id beyond")
    found = after(points, after_id, limit + 1) if after_id is not None else by_offset(points, offset, limit + 1)
    ids = [r["id"] for r in found.collect()]
    more, ids = len(ids) > limit, ids[:limit]
    next_offset = offset + limit if more and after_id is None else None
    return Page(ids, points.count(), next_offset, ids[-1] if more else None)


def count(points: DataFrame, where: Column | None = None) -> int:
    return (points if where is None else points.where(where)).count()


def lookup(points: DataFrame, point_id: int) -> DataFrame:
    return points.where(F.col("id") == point_id)
