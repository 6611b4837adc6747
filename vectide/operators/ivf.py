"""Inverted-file index: centroids from a bounded sample, every point in the list of its nearest centroid, and search over the
nearest lists only. Lists are stored partitioned by list_id, so probing them reads only those folders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import invalid
from ..model import Metric
from ..shipping import ship
from . import blocks
from .search import best_of_each, candidates, scored


#: Rows of a list's file, about.
FILE_ROWS = 100_000


@dataclass(frozen=True)
class IvfConfig:
    min_points: int = 2048
    min_lists: int = 8
    max_lists: int = 256
    iterations: int = 4
    training_points: int = 8192
    nprobe: int = 8


@dataclass(frozen=True)
class IvfIndex:
    """centroids: lists x dimension. lists: list_id, id, values and the columns that filters read. version: the data's, when it was built."""

    centroids: np.ndarray
    lists: DataFrame
    n: int
    version: int
    config: IvfConfig = IvfConfig()

    @property
    def nlist(self) -> int:
        return len(self.centroids)

    def fits(self, dimension: int, n: int, version: int) -> bool:
        return (self.centroids.shape[1], self.n, self.version) == (dimension, n, version)


def list_count(n: int, config: IvfConfig = IvfConfig()) -> int:
    return min(n, max(config.min_lists, min(config.max_lists, int(np.floor(np.sqrt(n) + 0.5)))))


def training_sample(points: DataFrame, config: IvfConfig) -> np.ndarray:
    """At most training_points vectors: those with the smallest hashes of id, in that order. A partial top-k, not a sort of all."""
    rows = points.select("id", "values").orderBy(F.xxhash64("id"), "id").limit(config.training_points).select("values").collect()
    return np.array([r["values"] for r in rows], np.float64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, points x centroids."""
    return np.maximum((x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T, 0)


def exact_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The same, each summed from the left over the differences."""
    out = np.zeros((len(x), len(centroids)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - centroids[None, :, j]) ** 2
    return out


def nearest_list(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point, ties to the lowest; by products, and exactly where those are too close to tell."""
    near = distances(x, centroids)
    best = near.argmin(1)
    slack = 1e-9 * ((x * x).sum(1) + (centroids * centroids).sum(1).max())
    close = np.flatnonzero((near <= (near[np.arange(len(x)), best] + slack)[:, None]).sum(1) > 1)
    for at in range(0, len(close), 1024):
        some = close[at : at + 1024]
        best[some] = exact_distances(x[some], centroids).argmin(1)
    return best


def train(sample: np.ndarray, nlist: int, iterations: int) -> np.ndarray:
    """Farthest-point seeds from the sample's first row, then a few rounds of k-means. An empty list keeps its centroid."""
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < nlist:
        far = nearest.copy()
        far[chosen] = -1
        chosen.append(int(far.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centroids = sample[chosen].copy()
    for _ in range(iterations):
        of = distances(sample, centroids).argmin(1)
        count = np.bincount(of, minlength=nlist)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, sample)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """points with list_id: the nearest centroid, ties to the lowest."""
    ship(points.sparkSession)
    shared = points.sparkSession.sparkContext.broadcast(centroids)
    schema = points.schema.simpleString()[len("struct<") : -1]
    at = points.columns.index("values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(0, batch.num_rows, 4096):
                part = batch.column(at).slice(i, 4096)
                found.append(nearest_list(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1), shared.value))
            lists = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists)], names=[*batch.schema.names, "list_id"])

    return points.mapInArrow(run, f"{schema}, list_id int")


def mean_vectors(points: DataFrame, by: str) -> DataFrame:
    """by, position, mean: the mean vector of each group, element by element; partial sums, so a group's size doesn't matter."""
    return points.select(by, F.posexplode("values").alias("position", "x")).groupBy(by, "position").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def nearest(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, list_id, distance (squared): the nearest of a few centroids (list_id, centroid) of each point, ties to the lowest list."""
    from ..functions.vector import l2_squared

    if centroids.limit(IvfConfig().max_lists + 1).count() > IvfConfig().max_lists:
        raise invalid(f"there are over {IvfConfig().max_lists} centroids")
    pairs = points.select("id", "values").crossJoin(F.broadcast(centroids))
    best = F.min(F.struct(l2_squared(F.col("values"), F.col("centroid")).alias("distance"), "list_id")).alias("best")
    return pairs.groupBy("id").agg(best).select("id", "best.list_id", "best.distance")


def build(points: DataFrame, n: int, version: int = 0, config: IvfConfig = IvfConfig(), path: str | None = None, centroids: np.ndarray | None = None) -> IvfIndex:
    """points: id, values and what filters read. path: where the lists are stored, partitioned by list; else they are assigned when read.
    centroids: given ones, at most max_lists; else they are trained."""
    if n < config.min_points:
        raise invalid(f"an ivf index needs {config.min_points} points, there are {n}")
    if centroids is None:
        centroids = train(training_sample(points, config), list_count(n, config), config.iterations)
    elif not 0 < len(centroids) <= config.max_lists:
        raise invalid(f"an ivf index has 1 to {config.max_lists} lists")
    lists = assign(points, centroids)
    if path:
        # a list's rows meet in one file, or in one for about FILE_ROWS rows of the average list, split by id
        splits = max(1, n // (len(centroids) * FILE_ROWS))
        lists.repartition("list_id", F.pmod(F.xxhash64("id"), F.lit(splits))).write.partitionBy("list_id").mode("overwrite").parquet(path)
        lists = points.sparkSession.read.parquet(path)
    return IvfIndex(centroids, lists, n, version, config)


def probes_of(nlist: int, n: int, limit: int, target_recall: float | None = None, config: IvfConfig = IvfConfig()) -> int:
    """How many of nlist lists of n points are probed; target_recall is a floor on their fraction."""
    needed = -(-limit * nlist // max(1, n))
    probe = max(1, min(nlist, max(config.nprobe, needed)))
    if target_recall is not None:
        share = np.float32(nlist) * np.float32(min(1.0, max(0.0, target_recall)))
        probe = min(nlist, max(probe, int(np.ceil(share)), 1))
    return probe


def probe_count(index: IvfIndex, limit: int, target_recall: float | None = None) -> int:
    return probes_of(index.nlist, index.n, limit, target_recall, index.config)


def probes(index: IvfIndex, queries: Sequence[Sequence[float]], probe: int) -> list[list[int]]:
    """The nearest lists of each query; ties to the lowest list."""
    q = np.array(queries, np.float64).reshape(len(queries), index.centroids.shape[1])
    return nearest_lists(q, index.centroids, probe).tolist()


def nearest_lists(q: np.ndarray, centroids: np.ndarray, probe: int) -> np.ndarray:
    return np.argsort(exact_distances(q, centroids), axis=1, kind="stable")[:, :probe]


def search_batch(index: IvfIndex, queries: Sequence[tuple[int, Sequence[float]]], metric: Metric, k: int, target_recall: float | None = None, where: Column | None = None, *, strict_finite: bool = True) -> DataFrame:
    """qid, rank, id and value of the best of the probed lists. Each list's points are multiplied with the queries that probe it, so
    (query, point) rows are made for each partition's candidates only."""
    probe = probe_count(index, k, target_recall)
    if probe == index.nlist:  # every query looks at every list
        pairs = candidates(index.lists if where is None else index.lists.where(where), queries, metric, k)
        return best_of_each(scored(pairs, F.col("q"), metric, None, strict_finite), metric, k)
    asked: dict[int, list[int]] = {}
    for place, lists in enumerate(probes(index, [q for _, q in queries], probe)):
        for i in lists:
            asked.setdefault(i, []).append(place)
    own = index.lists.where(F.col("list_id").isin(sorted(asked)))
    pairs = candidates(own if where is None else own.where(where), queries, metric, k, asked)
    return best_of_each(scored(pairs, F.col("q"), metric, None, strict_finite), metric, k)


def search_all(index: IvfIndex, queries: DataFrame, metric: Metric, k: int, target_recall: float | None = None, where: Column | None = None, *, strict_finite: bool = True) -> DataFrame:
    """qid, rank, id and value of the best of the probed lists, for any number of queries (qid, q). Within the lists only blocks are read
    whose boxes may hold one of the k best, so the result is that of search_batch."""
    ship(queries.sparkSession)
    probe = probe_count(index, k, target_recall)
    restricted = probe < index.nlist
    centroids, d = index.centroids, index.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = blocks.vectors(batch.column(1), d).astype(np.float64)
            lists = nearest_lists(q, centroids, probe if restricted else 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(lists), pa.list_(pa.int32()))], names=["qid", "q", "lists"])

    own = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("q").cast("array<float>").alias("q")).where(F.size("q") == d)
    asked = own.mapInArrow(run, "qid bigint, q array<float>, lists array<int>")
    points = index.lists if where is None else index.lists.where(where)
    return blocks.search_all(points, asked, metric, k, n_lists=index.nlist, restricted=restricted, strict_finite=strict_finite)
