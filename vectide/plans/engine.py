"""The engine: collections and points under one root folder, with every operation a caller has.

State is the mutation log's; an operation checks on the driver, then appends a batch or runs one plan. Only metadata
(collections and their point counts), k hits, a page of ids or a request's own rows reach the driver.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, conflict, exhausted, invalid, not_found
from ..functions import filters as filters_
from ..functions import payload as P
from ..functions.vector import ZERO_NORM, all_finite, check_vector, distance, squared_norm
from ..model import CREATE, DELETE, MUTATIONS, PAYLOAD, REMOVE, UPSERT, Limits, Metric, Mode, collection_name, enum_of, scoped
from ..operators import ivf, mutations, paging, quotas
from ..operators.blocks import search_all
from ..operators.search import top_k, top_k_batch, with_payload
from ..sources import ndjson
from ..sources.log import MutationLog, State
from . import planner
from .sizes import broadcast_if_small

logger = logging.getLogger(__name__)

NO_POINTS = "there is no point to find"


@dataclass
class Counters:
    """What has happened since the engine was made."""

    searches: dict[str, int] = field(default_factory=lambda: {"exact": 0, "ivf": 0})
    ivf_fallbacks: int = 0
    index_lookups: int = 0
    index_hits: int = 0
    index_builds: int = 0
    writes: int = 0
    rejected: int = 0
    snapshots: int = 0
    snapshot_failures: int = 0

    def hit_ratio(self) -> float:
        return self.index_hits / self.index_lookups if self.index_lookups else 0.0


class Engine:
    def __init__(self, spark: SparkSession, root: str, limits: Limits = Limits(), ivf_config: ivf.IvfConfig = ivf.IvfConfig(), build_cooldown_s: float = 1.0):
        self.spark, self.limits, self.ivf_config, self.cooldown = spark, limits, ivf_config, build_cooldown_s
        self.log = MutationLog(spark, root, limits.compact_after)
        self.counters = Counters()
        self._state: tuple[int, State, dict[str, tuple[int, bool]], dict[str, int]] | None = None
        self._indexes: dict[str, ivf.IvfIndex] = {}
        self._built: dict[str, float] = {}
        #: False from a snapshot that failed to the next that doesn't. Batches are stored by then, so nothing is lost, but the log grows.
        self.ready = True

    # state

    def _load(self) -> tuple[int, State, dict[str, tuple[int, bool]], dict[str, int]]:
        version = self.log.version()
        if self._state is None or self._state[0] != version:
            state = self.log.load()
            collections = {r["name"]: (r["dimension"], r["strict_finite"]) for r in state.collections.collect()}
            counts = {r["collection"]: r["n"] for r in state.points.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).collect()}
            self._state = (state.version, state, collections, {n: counts.get(n, 0) for n in collections})
        return self._state

    def _config(self, name: str, tenant: str | None) -> tuple[str, int, bool]:
        stored = scoped(collection_name(name), tenant)
        known = self._load()[2].get(stored)
        if known is None:
            raise not_found(f"collection '{stored}' not found")
        return stored, *known

    def points(self, name: str, tenant: str | None = None) -> DataFrame:
        """id, values and payload of a collection's points."""
        stored, _, _ = self._config(name, tenant)
        return self._load()[1].points.where(F.col("collection") == stored).select("id", "values", "payload")

    def _append(self, rows: list[tuple] | DataFrame, *touched: str, more: int = 0, collection: tuple[int, bool] | None = None) -> int:
        """Appends a batch. more: by how many points it changes the count of the first touched collection; collection: its dimension and
        strictness if the batch creates it, (0, False) if it deletes it. So the counts are known without folding the log."""
        _, _, known, counts = self._load()
        batch = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, MUTATIONS)
        try:
            self.log.append(batch, self._load()[0])
        except EngineError:
            self.counters.rejected += 1
            raise
        self.counters.writes += 1
        for name in touched:
            self._indexes.pop(name, None)
        self._snapshot_if_due()
        state = self.log.load()
        if touched and state.version == self._state[0] + 1:  # nobody else has written
            name = touched[0]
            if collection is None:
                counts = counts | {name: counts[name] + more}
            else:
                known, counts = ({k: v for k, v in x.items() if k != name} for x in (known, counts))
                if collection[0]:
                    known, counts = known | {name: collection}, counts | {name: 0}
            self._state = (state.version, state, known, counts)
        return state.version

    def _snapshot_if_due(self) -> None:
        """A snapshot that fails leaves the write as it is, since the log holds it; the next write tries again."""
        try:
            done = self.log.compact_if_due()
        except Exception:  # noqa: BLE001  whatever the storage or Spark raises
            logger.exception("the snapshot has failed; the state is that of the log")
            self.counters.snapshot_failures += 1
            self.ready = False
            return
        if done:
            self.counters.snapshots += 1
            self.ready = True

    @staticmethod
    def _row(ord_: int, op: str, name: str, id_: int | None = None, dimension: int | None = None, strict: bool | None = None, values=None, payload=None) -> tuple:
        return (0, ord_, op, name, id_, dimension, strict, values, payload)

    # collections

    def create_collection(self, name: str, dimension: int, strict_finite: bool = True, tenant: str | None = None) -> dict:
        stored = scoped(collection_name(name), tenant)
        if not isinstance(dimension, int) or isinstance(dimension, bool) or dimension <= 0:
            raise invalid("dimension must be positive")
        if dimension > self.limits.max_dimension:
            raise invalid(f"dimension {dimension} is over {self.limits.max_dimension}")
        known = self._load()[2]
        if stored in known:
            raise conflict(f"collection '{stored}' already exists")
        own = [n for n in known if n.startswith(f"{tenant}::")] if tenant else list(known)
        if self.limits.max_collections and len(own) >= self.limits.max_collections:
            raise exhausted("collection quota is used up")
        self._append([self._row(0, CREATE, stored, dimension=dimension, strict=strict_finite)], stored, collection=(dimension, strict_finite))
        return {"name": name.strip(), "dimension": dimension, "strict_finite": strict_finite, "point_count": 0}

    def list_collections(self, tenant: str | None = None) -> list[dict]:
        _, _, known, counts = self._load()
        prefix = f"{tenant}::" if tenant else ""
        return [{"name": n.removeprefix(prefix), "dimension": d, "strict_finite": s, "point_count": counts[n]} for n, (d, s) in sorted(known.items()) if n.startswith(prefix)]

    def get_collection(self, name: str, tenant: str | None = None) -> dict:
        stored, dimension, strict = self._config(name, tenant)
        return {"name": name.strip(), "dimension": dimension, "strict_finite": strict, "point_count": self._load()[3][stored]}

    def delete_collection(self, name: str, tenant: str | None = None) -> None:
        stored, _, _ = self._config(name, tenant)
        self._append([self._row(0, DELETE, stored)], stored, collection=(0, False))

    # points

    def _admit(self, stored: str, dimension: int, new: int, tenant: str | None) -> None:
        """Caps, quota and memory for new points; all of a batch or none."""
        _, _, known, counts = self._load()
        if counts[stored] + new > self.limits.max_points_per_collection:
            raise exhausted(f"collection '{stored}' may have {self.limits.max_points_per_collection} points")
        if self.limits.max_points:
            used = sum(n for c, n in counts.items() if not tenant or c.startswith(f"{tenant}::"))
            if used + new > self.limits.max_points:
                raise exhausted("point quota is used up")
        if self.limits.memory_budget_bytes:
            used = sum(counts[c] * d * quotas.ELEMENT for c, (d, _) in known.items())
            if used + new * dimension * quotas.ELEMENT > self.limits.memory_budget_bytes:
                raise exhausted("memory budget is used up")

    def upsert_points(self, name: str, points: Sequence[tuple[int, Sequence[float], Mapping | None]], tenant: str | None = None) -> dict:
        """points: (id, values, payload); a repeated id is created once and then updated, the last wins."""
        if not points:
            raise invalid("a batch needs points")
        if len(points) > self.limits.max_batch:
            raise invalid(f"a batch may have {self.limits.max_batch} points")
        stored, dimension, strict = self._config(name, tenant)
        rows, ids = [], []
        for i, (id_, values, payload) in enumerate(points):
            if not isinstance(id_, int) or isinstance(id_, bool) or not 0 <= id_ < 1 << 63:
                raise invalid(f"id {id_!r} must be a whole number from 0 to 2^63 - 1")
            own = check_vector(values, dimension, strict, f"point {id_}")
            rows.append(self._row(i, UPSERT, stored, id_, values=own, payload=P.of_dict(payload)))
            ids.append(id_)
        known = {r["id"] for r in self.points(name, tenant).where(F.col("id").isin(sorted(set(ids)))).select("id").collect()}
        flags, seen = [], set(known)
        for id_ in ids:
            flags.append(id_ not in seen)
            seen.add(id_)
        self._admit(stored, dimension, sum(flags), tenant)
        self._append(rows, stored, more=sum(flags))
        results = [{"id": i, "created": c} for i, c in zip(ids, flags, strict=True)]
        return {"created": sum(flags), "updated": len(flags) - sum(flags), "results": results}

    def upsert_point(self, name: str, id_: int, values: Sequence[float], payload: Mapping | None = None, tenant: str | None = None) -> dict:
        return self.upsert_points(name, [(id_, values, payload)], tenant)["results"][0]

    def upsert_frame(self, name: str, df: DataFrame, tenant: str | None = None, order: str | None = None) -> int:
        """Upserts a DataFrame (id, values and perhaps payload) of any size as one batch; order: the column that tells which of
        repeated ids is the last. Checked by one aggregation; a bad row refuses the batch."""
        stored, dimension, strict = self._config(name, tenant)
        payload = F.col("payload").cast(PAYLOAD) if "payload" in df.columns else F.create_map().cast(PAYLOAD)
        own = df.select(F.col("id").cast("bigint").alias("id"), F.col("values").cast("array<float>").alias("values"), payload.alias("payload"), (F.col(order) if order else F.monotonically_increasing_id()).cast("bigint").alias("ord"))
        bad = F.col("id").isNull() | (F.col("id") < 0) | F.col("values").isNull() | (F.size("values") != dimension) | F.exists(F.map_keys(F.col("payload")), lambda k: F.trim(k) == "")
        if strict:
            bad = bad | ~all_finite(F.col("values"))
        if n := own.where(F.coalesce(bad, F.lit(True))).count():
            raise invalid(f"{n} rows have a wrong id, dimension, value or payload key")
        known = self.points(name, tenant).select("id")
        new = own.select("id").distinct().join(known, "id", "left_anti").count()
        self._admit(stored, dimension, new, tenant)
        rows = own.select("ord", F.lit(UPSERT).alias("op"), F.lit(stored).alias("collection"), "id", F.lit(None).cast("int").alias("dimension"), F.lit(None).cast("boolean").alias("strict_finite"), "values", "payload")
        return self._append(rows, stored, more=new)

    def get_point(self, name: str, id_: int, tenant: str | None = None) -> dict:
        row = paging.lookup(self.points(name, tenant), id_).first()
        if row is None:
            raise not_found(f"point {id_} not found")
        return {"id": id_, "values": row["values"], "payload": P.to_dict(row["payload"])}

    def delete_point(self, name: str, id_: int, tenant: str | None = None) -> None:
        stored, _, _ = self._config(name, tenant)
        self.get_point(name, id_, tenant)
        self._append([self._row(0, REMOVE, stored, id_)], stored, more=-1)

    def list_points(self, name: str, limit: int | None = None, offset: int = 0, after_id: int | None = None, tenant: str | None = None) -> dict:
        found = paging.page(self.points(name, tenant), limit, offset, after_id, self.limits)
        return {"points": found.ids, "total": found.total, "next_offset": found.next_offset, "next_after_id": found.next_after_id}

    def count_points(self, name: str, filter: Mapping | None = None, tenant: str | None = None) -> int:
        if not self.limits.points_count:
            raise not_found("count is not enabled")
        return paging.count(self.points(name, tenant), self._where(filter))

    def _patch(self, name: str, ids: Iterable[int], change, tenant: str | None) -> int:
        """Whole-point upserts of the points that a patch changes; an unknown id refuses all."""
        if not self.limits.payload_mutations:
            raise not_found("payload mutations are not enabled")
        stored, _, _ = self._config(name, tenant)
        wanted = list(dict.fromkeys(ids))
        if not wanted:
            raise invalid("ids of points are needed")
        points = self.points(name, tenant)
        own = self.spark.createDataFrame([(i,) for i in wanted], "id bigint")
        there = {r["id"] for r in points.select("id").join(broadcast_if_small(own), "id", "left_semi").collect()}
        for i in wanted:
            if i not in there:
                raise not_found(f"point {i} not found")
        rows = [self._row(n, UPSERT, stored, r["id"], values=r["values"], payload=r["payload"]) for n, r in enumerate(change(points, own).orderBy("id").collect())]
        if rows:
            self._append(rows, stored)
        return len(rows)

    def set_payload(self, name: str, ids: Iterable[int], payload: Mapping, tenant: str | None = None) -> int:
        P.of_dict(payload)
        if not payload:
            raise invalid("a payload needs keys")
        return self._patch(name, ids, lambda points, own: mutations.set_payload(points, own, payload), tenant)

    def delete_payload_keys(self, name: str, ids: Iterable[int], keys: Sequence[str], tenant: str | None = None) -> int:
        own_keys = P.unique_keys(keys)
        return self._patch(name, ids, lambda points, own: mutations.delete_payload_keys(points, own, own_keys), tenant)

    # search

    def _where(self, raw: Mapping | None) -> Column | None:
        return filters_.compile_filter(filters_.parse(raw, self.limits.must_not), filters_.in_payload(F.col("payload")))

    def distance(self, left: Sequence[float], right: Sequence[float], metric: str = "dot") -> float:
        return distance(left, right, enum_of(Metric, metric), self.limits.max_dimension)

    def build_index(self, name: str, tenant: str | None = None, path: str | None = None) -> ivf.IvfIndex:
        """Builds and keeps the index of the current version."""
        stored, _, _ = self._config(name, tenant)
        version, _, _, counts = self._load()
        index = ivf.build(self.points(name, tenant), counts[stored], version, self.ivf_config, path)
        self._indexes[stored], self._built[stored] = index, time.monotonic()
        self.counters.index_builds += 1
        return index

    def index_due(self, name: str, tenant: str | None = None) -> bool:
        """Whether an index may be built now: none fits, and the last was built long enough ago."""
        stored, dimension, _ = self._config(name, tenant)
        version, _, _, counts = self._load()
        index = self._indexes.get(stored)
        fits = index is not None and index.fits(dimension, counts[stored], version)
        return not fits and counts[stored] >= self.ivf_config.min_points and time.monotonic() - self._built.get(stored, -1e9) >= self.cooldown

    def _search(self, name, queries, metric, limit, mode, target_recall, raw_filter, tenant, batch) -> tuple[planner.Choice, DataFrame, Metric, DataFrame]:
        metric, mode = enum_of(Metric, metric), enum_of(Mode, mode)
        k = planner.limit_of(limit, self.limits)
        stored, dimension, strict = self._config(name, tenant)
        version, _, _, counts = self._load()
        n = counts[stored]
        if not n:
            raise invalid(NO_POINTS)
        own = [check_vector(q, dimension, False, "query") for q in queries]
        where = self._where(raw_filter)
        index = self._indexes.get(stored)
        fits = index is not None and index.fits(dimension, n, version)
        choice = planner.choose(mode, metric, n, fits, target_recall, self.ivf_config, n_queries=len(own), k=k, filtered=where is not None, batch=batch)
        for q in own:
            check_vector(q, dimension, True, "query")
            if metric == Metric.COSINE and sum(x * x for x in q) <= ZERO_NORM:
                raise invalid("cosine of a zero query is undefined")
        if mode != Mode.EXACT and n >= self.ivf_config.min_points and metric == Metric.L2:
            self.counters.index_lookups += 1
            self.counters.index_hits += choice.mode == Mode.IVF
        self.counters.ivf_fallbacks += choice.fallback
        self.counters.searches[choice.mode.value] += len(own)
        points, k = self.points(name, tenant), min(k, n)
        if choice.mode == Mode.IVF:
            hits = ivf.search_batch(index, list(enumerate(own)), metric, k, target_recall, where, strict_finite=strict)
        elif batch:
            frame = self.spark.createDataFrame(list(enumerate(own)), "qid bigint, q array<float>")
            hits = top_k_batch(points, frame, metric, k, where, strict_finite=strict, n_queries=len(own))
        else:
            hits = top_k(points, own[0], metric, k, where, strict_finite=strict).withColumn("qid", F.lit(0).cast("bigint"))
        return choice, hits, metric, points

    def _answers(self, found, include_payload: bool, n: int) -> list[dict]:
        choice, hits, metric, points = found
        rows = hits.collect()  # k a query
        payloads = {}
        if include_payload and rows:
            wanted = points.where(F.col("id").isin(sorted({r["id"] for r in rows})))
            payloads = {r["id"]: P.to_dict(r["payload"]) for r in wanted.select("id", "payload").collect()}
        by: list[list[dict]] = [[] for _ in range(n)]
        for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
            hit = {"id": r["id"], "value": r["value"]}
            by[r["qid"]].append(hit | {"payload": payloads[r["id"]]} if payloads.get(r["id"]) else hit)
        common = {"mode": choice.mode.value} | ({} if choice.recall_at_k is None else {"recall_at_k": choice.recall_at_k})
        return [common | {"metric": metric.value, "hits": hits} for hits in by]

    def search_topk(self, name: str, query: Sequence[float], metric: str = "dot", limit: int | None = None, mode: str = "auto", target_recall: float | None = None, filter: Mapping | None = None, include_payload: bool = True, tenant: str | None = None) -> dict:
        return self._answers(self._search(name, [query], metric, limit, mode, target_recall, filter, tenant, False), include_payload, 1)[0]

    def search(self, name: str, query: Sequence[float], metric: str = "dot", mode: str = "auto", target_recall: float | None = None, filter: Mapping | None = None, include_payload: bool = True, tenant: str | None = None) -> dict:
        found = self.search_topk(name, query, metric, 1, mode, target_recall, filter, include_payload, tenant)
        hits = found.pop("hits")
        if not hits:
            raise invalid(NO_POINTS)
        return found | hits[0]

    def search_topk_batch(self, name: str, queries: Sequence[Sequence[float]], metric: str = "dot", limit: int | None = None, mode: str = "auto", target_recall: float | None = None, filter: Mapping | None = None, include_payload: bool = True, tenant: str | None = None) -> list[dict]:
        if not 0 < len(queries) <= self.limits.max_queries:
            raise invalid(f"a batch has 1 to {self.limits.max_queries} queries")
        return self._answers(self._search(name, queries, metric, limit, mode, target_recall, filter, tenant, True), include_payload, len(queries))

    def search_frame(self, name: str, queries: DataFrame, metric: str = "dot", limit: int | None = None, filter: Mapping | None = None, tenant: str | None = None) -> DataFrame:
        """qid, rank, id, value and payload of the exact best points of each query (qid, q), of any number: one search in a fixed number of jobs.
        Queries are checked by one aggregation; a bad one refuses all."""
        metric = enum_of(Metric, metric)
        k = planner.limit_of(limit, self.limits)
        stored, dimension, strict = self._config(name, tenant)
        if not self._load()[3][stored]:
            raise invalid(NO_POINTS)
        own = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("q").cast("array<float>").alias("q"))
        bad = F.col("qid").isNull() | F.col("q").isNull() | (F.size("q") != dimension) | ~all_finite(F.col("q"))
        if metric == Metric.COSINE:
            bad = bad | (squared_norm(F.col("q")) <= ZERO_NORM)
        n, wrong = own.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("bigint")), F.lit(0))).first()
        if wrong:
            raise invalid(f"{wrong} queries have a wrong dimension or value")
        self.counters.searches[Mode.EXACT.value] += n
        points, where = self.points(name, tenant), self._where(filter)
        hits = search_all(points if where is None else points.where(where), own, metric, k, strict_finite=strict)
        return with_payload(hits, points, "payload")

    # operations

    def metrics(self) -> DataFrame:
        """(metric, value): the engine's state and counters."""
        version, _, known, counts = self._load()
        backlog = self.log.backlog()
        c = self.counters
        rows = {
            "collections": len(known), "points": sum(counts.values()), "memory_used_bytes": sum(counts[n] * d * quotas.ELEMENT for n, (d, _) in known.items()),
            "version": version, "log_segments": backlog["segments"], "log_bytes": backlog["bytes"], "snapshot_version": backlog["snapshot_version"],
            "searches_exact": c.searches["exact"], "searches_ivf": c.searches["ivf"], "ivf_fallbacks": c.ivf_fallbacks, "index_lookups": c.index_lookups,
            "index_hits": c.index_hits, "index_hit_ratio": c.hit_ratio(), "index_builds": c.index_builds, "writes": c.writes, "rejected": c.rejected,
            "snapshots": c.snapshots, "snapshot_failures": c.snapshot_failures, "ready": self.ready, "tenants": len({n.split("::")[0] for n in known if "::" in n}), "indexes": len(self._indexes),
        }
        return self.spark.createDataFrame([(k, float(v)) for k, v in rows.items()], "metric string, value double")

    def export(self, name: str, path: str, tenant: str | None = None) -> None:
        stored, dimension, strict = self._config(name, tenant)
        ndjson.export(self.points(name, tenant), path, name.strip(), dimension, strict)

    def import_(self, path: str, name: str | None = None, if_exists: str = "fail", tenant: str | None = None) -> int:
        """if_exists: fail, append (the configuration must match) or replace. Returns the points read."""
        if if_exists not in ("fail", "append", "replace"):
            raise invalid("if_exists is fail, append or replace")
        head = ndjson.read_header(self.spark, path)
        target = name or head["name"]
        there = scoped(collection_name(target), tenant) in self._load()[2]
        points = ndjson.read_points(self.spark, path)
        if there and if_exists == "fail":
            raise conflict(f"collection '{target}' already exists")
        if there and if_exists == "append":
            _, dimension, strict = self._config(target, tenant)
            if (dimension, strict) != (head["dimension"], head["strict_finite"]):
                raise conflict(f"collection '{target}' has another configuration")
        if there and if_exists == "replace":
            self.delete_collection(target, tenant)
        if not there or if_exists == "replace":
            self.create_collection(target, head["dimension"], head["strict_finite"], tenant)
        n = points.count()
        if n:
            # files in name order, blocks in file order, rows in block order
            turn = F.row_number().over(_file_order()) if points.select("id").distinct().count() < n else None
            frame = points.withColumn("turn", turn) if turn is not None else points
            self.upsert_frame(target, frame.drop("ord"), tenant, "turn" if turn is not None else None)
        return n


def _file_order():
    from pyspark.sql import Window

    return Window.partitionBy("id").orderBy("ord")
