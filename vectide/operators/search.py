"""Exact top-1, top-k and batched top-k.

One plan: filter, score, drop what can't be ranked, keep the best k in the total order (score, then id), and only then fetch
payloads of the k hits by id, so the scan reads ids and vectors alone (and what the filter needs).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import invalid
from ..functions.vector import or_null, rank_score, response_value
from ..model import Metric
from ..plans.sizes import broadcast_if_small
from ..shipping import ship

#: Queries of a batch from which each partition's hits are found by matrix products.
KERNEL_QUERIES = 16
#: Points that the kernel multiplies in one go; queries of a batch at most; hits up to which their ids go to the points' scan.
KERNEL_POINTS, MAX_QUERIES, PUSHED = 2048, 4096, 1000


def order(score: Column, metric: Metric) -> list[Column]:
    """Best first: L2 ascending, others descending, then id ascending; what can't be ranked comes last."""
    return [score.asc_nulls_last() if metric == Metric.L2 else score.desc_nulls_last(), F.col("id").asc()]


def scored(points: DataFrame, query: Sequence[float] | Column, metric: Metric, where: Column | None = None, strict_finite: bool = True) -> DataFrame:
    """id (and qid) and score of the points that the filter lets through, null if they can't be ranked; points: id, values and what
    the filter reads. Null scores are dropped after the cut to k, where they are the last: a filter here would compute scores twice."""
    own = points if where is None else points.where(where)
    return own.select("id", *(["qid"] if "qid" in own.columns else []), or_null(rank_score(F.col("values"), query, metric), metric, strict_finite).alias("score"))


def ranked(best: DataFrame, metric: Metric) -> DataFrame:
    """rank, id and value of at most a few thousand rows (id, score)."""
    rank = F.row_number().over(Window.orderBy(*order(F.col("score"), metric)))
    return best.select(rank.alias("rank"), "id", response_value(F.col("score"), metric).alias("value"))


def with_payload(hits: DataFrame, points: DataFrame, *columns: str, rows: int | None = None) -> DataFrame:
    """hits with columns of their points. rows: how many hits there are at most, if that is known. Up to PUSHED hits are found first, and
    their ids go to the scan of points as a filter, which skips files and row groups; more are joined, broadcast if they are few enough."""
    if rows is None or rows > PUSHED:
        return points.select("id", *columns).join(broadcast_if_small(hits), "id").select(*hits.columns, *columns)
    found = hits.collect()
    own = hits.sparkSession.createDataFrame(found, hits.schema)
    return points.where(F.col("id").isin(sorted({r["id"] for r in found}))).select("id", *columns).join(F.broadcast(own), "id").select(*hits.columns, *columns)


def top_k(points: DataFrame, query: Sequence[float], metric: Metric, k: int, where: Column | None = None, *, strict_finite: bool = True, payload: Sequence[str] = ()) -> DataFrame:
    """rank, id, value and the columns `payload` of the k best points."""
    best = scored(points, query, metric, where, strict_finite).orderBy(*order(F.col("score"), metric)).limit(k).where(F.col("score").isNotNull())
    hits = ranked(best, metric)
    return with_payload(hits, points, *payload, rows=k) if payload else hits


def among(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The points whose id is in ids (id)."""
    return points.join(broadcast_if_small(ids.select("id").distinct()), "id", "left_semi")


def top_1(points: DataFrame, query: Sequence[float], metric: Metric, where: Column | None = None, **options) -> DataFrame:
    return top_k(points, query, metric, 1, where, **options)


def best_of_each(found: DataFrame, metric: Metric, k: int) -> DataFrame:
    """qid, rank, id and value of the k best rows (qid, id, score) of each query; Spark cuts to k before and after the exchange."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*order(F.col("score"), metric)))
    return found.withColumn("rank", rank).where((F.col("rank") <= k) & F.col("score").isNotNull()).select("qid", "rank", "id", response_value(F.col("score"), metric).alias("value"))


def top_k_batch(points: DataFrame, queries: DataFrame, metric: Metric, k: int, where: Column | None = None, *, strict_finite: bool = True, payload: Sequence[str] = (), n_queries: int | None = None) -> DataFrame:
    """qid, rank, id, value and the columns `payload` of the k best points of each query (qid, q).

    A batch is small by contract (its size is checked by the caller), so it is broadcast. Few queries are joined to every
    point and scored by expressions. From KERNEL_QUERIES on, a partition first finds its own candidates with matrix products
    (k and whatever is too close to tell apart), and only those are scored; so points x queries rows are never made.
    """
    n = queries.count() if n_queries is None else n_queries
    if n >= KERNEL_QUERIES:
        rows = queries.select("qid", "q").limit(MAX_QUERIES + 1).collect()
        if len(rows) > MAX_QUERIES:
            raise invalid(f"a batch may have {MAX_QUERIES} queries")
        pairs = candidates(points if where is None else points.where(where), [(r["qid"], r["q"]) for r in rows], metric, k)
        found = scored(pairs, F.col("q"), metric, None, strict_finite)
    else:
        found = scored(points.crossJoin(F.broadcast(queries.limit(KERNEL_QUERIES))), F.col("q"), metric, where, strict_finite)
    hits = best_of_each(found, metric, k)
    return with_payload(hits, points, *payload, rows=n * k) if payload else hits


def candidates(points: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], metric: Metric, k: int, lists: Mapping[int, Sequence[int]] | None = None) -> DataFrame:
    """(qid, q, id, values): for each query and partition all points that may be among its k best, by matrix products.

    A product differs from the exact sum by rounding only; points within SLACK of the kth are all kept. lists: of each list_id of
    the points the places of the queries that look at it; other points aren't multiplied.
    """
    ship(points.sparkSession)
    if not queries:
        return points.select(F.lit(0).cast("bigint").alias("qid"), F.array().cast("array<float>").alias("q"), "id", "values").limit(0)
    qids = np.array([i for i, _ in queries], np.int64)
    q_lists = [list(q) for _, q in queries]
    q = np.array(q_lists, np.float64).reshape(len(q_lists), -1)
    norms = (q * q).sum(1)
    probing = None if lists is None else {i: np.array(places) for i, places in lists.items()}

    def groups(part: pa.RecordBatch) -> Iterator[tuple[slice | np.ndarray, np.ndarray]]:
        """Places of points, and of the queries they are for."""
        if probing is None:
            yield slice(None), np.arange(len(qids))
            return
        of = part.column(2).to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        found, starts = np.unique(of[order], return_index=True)
        for i, places in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
            if i in probing:
                yield places, probing[i]

    def products(q: np.ndarray, norms: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, the least being the best, and how far they may be off; queries x points."""
        with np.errstate(all="ignore"):
            product, sizes = q @ x.T, (x * x).sum(1)
            if metric == Metric.L2:
                score = norms[:, None] + sizes[None, :] - 2 * product
                slack = 1e-9 * (norms[:, None] + sizes[None, :])
            elif metric == Metric.DOT:
                score = -product
                slack = 1e-9 * np.sqrt(norms[:, None] * sizes[None, :])
            else:
                score = -product / np.sqrt(norms[:, None] * sizes[None, :])
                slack = np.full_like(score, 1e-9)
        return np.where(np.isnan(score), np.inf, score), np.where(np.isfinite(slack), slack, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each query: least and greatest possible scores, ids and vectors of its candidates
        empty = (np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, q.shape[1]), np.float32))
        own = [empty] * len(qids)
        for batch in batches:
            for at in range(0, batch.num_rows, KERNEL_POINTS):
                part = batch.slice(at, KERNEL_POINTS)
                all_ids = part.column(0).to_numpy(zero_copy_only=False)
                all_values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(all_ids), -1)
                for places, asked in groups(part):
                    ids, values = all_ids[places], all_values[places]
                    score, slack = products(q[asked], norms[asked], values.astype(np.float64))
                    for row, i in enumerate(asked.tolist()):
                        new = (score[row] - slack[row], score[row] + slack[row], ids, values)
                        low, high = (np.concatenate([own[i][c], new[c]]) for c in (0, 1))
                        keep = low <= (np.partition(high, k - 1)[k - 1] if len(high) > k else np.inf)
                        n_old = len(own[i][0])
                        own[i] = (low[keep], high[keep], *(np.concatenate([own[i][c][keep[:n_old]], new[c][keep[n_old:]]]) for c in (2, 3)))
        for i, (_, _, ids, values) in enumerate(own):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), qids[i])), pa.array([q_lists[i]] * len(ids), pa.list_(pa.float32())), pa.array(ids), pa.array(list(values), pa.list_(pa.float32()))],
                    names=["qid", "q", "id", "values"],
                )

    more = [] if lists is None else ["list_id"]
    return points.select(F.col("id").cast("bigint").alias("id"), "values", *more).mapInArrow(run, "qid bigint, q array<float>, id bigint, values array<float>")
