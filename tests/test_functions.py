"""Vector functions, payloads, filters and planning, against plain Python."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.errors import EngineError
from vectide.functions import filters, vector
from vectide.functions import payload as P
from vectide.model import Limits, Metric, Mode
from vectide.operators import ivf, search
from vectide.plans import planner


def lcg(n, seed=7):
    out, x = [], seed
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % (1 << 32)
        out.append(float(np.float32(x / (1 << 31) - 1)))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 127, 128, 129])
def test_distances(spark, n):
    a, b = lcg(n), lcg(n, 99)
    row = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    dot = math.fsum(x * y for x, y in zip(a, b))
    l2 = math.sqrt(math.fsum((x - y) ** 2 for x, y in zip(a, b)))
    cos = dot / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))
    got = row.select(vector.dot(F.col("a"), F.col("b")), vector.l2(F.col("a"), F.col("b")), vector.cosine(F.col("a"), F.col("b"))).first()
    assert list(got) == pytest.approx([dot, l2, cos], rel=1e-12, abs=1e-12)
    for metric in Metric:
        unrolled = row.select(vector.response_value(vector.rank_score(F.col("a"), b, metric), metric)).first()[0]
        assert unrolled == vector.distance(a, b, metric) == row.select(vector.response_value(vector.rank_score(F.col("a"), F.col("b"), metric), metric)).first()[0]


def test_zero_norm_and_finite(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 1.0]), (5, [3e38, 3e38])], "id long, values array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, q array<float>")
    for metric, strict, expected in ((Metric.COSINE, True, {2, 5}), (Metric.DOT, True, {1, 2, 5}), (Metric.L2, True, {1, 2, 4, 5}), (Metric.L2, False, {1, 2, 5})):
        assert {r.id for r in search.top_k(rows, [1.0, 0.0], metric, 10, strict_finite=strict).collect()} == expected
        assert {r.id for r in search.top_k_batch(rows, queries, metric, 10, strict_finite=strict).collect()} == expected
    assert {r.id for r in rows.where(vector.all_finite(F.col("values"))).collect()} == {1, 2, 5}
    for bad in ([], [1.0], [1.0, float("nan")]):
        with pytest.raises(EngineError):
            vector.check_vector(bad, 2)
    with pytest.raises(EngineError):
        vector.distance([1, 2], [1], Metric.DOT)
    with pytest.raises(EngineError):
        vector.distance([0, 0], [1, 1], Metric.COSINE)


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("n_queries", [3, 17])
def test_batch_is_single(spark, metric, n_queries):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(400)]
    points = spark.createDataFrame(rows, "id long, values array<float>").repartition(7)
    queries = [(100 + i, [float(x) for x in rng.integers(1, 5, 5)]) for i in range(n_queries)]
    got = search.top_k_batch(points, spark.createDataFrame(queries, "qid long, q array<float>"), metric, 9).collect()
    for qid, q in queries:
        expected = [tuple(r) for r in search.top_k(points, q, metric, 9).orderBy("rank").collect()]
        assert sorted((r.rank, r.id, r.value) for r in got if r.qid == qid) == expected


values = st.one_of(st.text("ab1", max_size=2), st.integers(-3, 3), st.floats(-3, 3).map(lambda x: round(x, 1)), st.booleans())
clauses = st.one_of(
    st.fixed_dictionaries({"field": st.sampled_from("xyz"), "value": values}),
    st.builds(lambda f, a, b, k: {"field": f, k[0]: min(a, b), k[1]: max(a, b)}, st.sampled_from("xyz"), st.integers(-3, 3), st.integers(-3, 3), st.sampled_from([("gt", "lt"), ("gte", "lte"), ("gt", "lte")])),
)


def test_filters_agree_with_the_evaluator(spark):
    payloads = [{}, {"x": 1}, {"x": 1.0, "y": "a"}, {"x": "1", "y": True}, {"x": True, "z": -2}, {"x": 0.1 + 0.2, "y": 0}, {"x": 3, "y": "b", "z": 2.5}, {"z": False}]
    rows = spark.createDataFrame([(i, P.of_dict(p)) for i, p in enumerate(payloads)], "id long, payload map<string,struct<s:string,i:bigint,f:double,b:boolean>>").cache()

    @settings(max_examples=25, deadline=None)
    @given(st.lists(clauses, max_size=2), st.lists(clauses, max_size=3), st.lists(clauses, max_size=2), st.integers(0, 3))
    def check(must, should, must_not, least):
        own = filters.parse({"must": must, "should": should, "must_not": must_not, "minimum_should_match": min(least, len(should)) if should else None})
        where = filters.compile_filter(own, filters.in_payload(F.col("payload")))
        got = {r.id for r in (rows if where is None else rows.where(where)).select("id").collect()}
        assert got == {i for i, p in enumerate(payloads) if filters.evaluate(own, p)}

    check()
    tolerant = filters.compile_filter(filters.parse({"must": [{"field": "x", "value": 0.3}]}), filters.in_payload(F.col("payload")))
    assert [r.id for r in rows.where(tolerant).collect()] == [5]


@pytest.mark.parametrize(
    "raw",
    [
        {"must": [{"field": " ", "value": 1}]}, {"must": [{"field": "x"}]}, {"must": [{"field": "x", "value": None}]}, {"must": [{"field": "x", "value": [1]}]},
        {"must": [{"field": "x", "gt": 3, "lt": 1}]}, {"must": [{"field": "x", "gt": "3"}]}, {"must": [{"field": "x", "gt": True}]}, {"must": [{"field": "x", "value": 1, "lt": 1}]},
        {"should": [], "minimum_should_match": 1}, {"should": [{"field": "x", "value": 1}], "minimum_should_match": -1}, {"shall": []}, {"must": [{"field": "x", "gt": float("nan")}]}, {"must": ["x"]},
    ],
)
def test_bad_filters(raw):
    with pytest.raises(EngineError):
        filters.parse(raw)


def test_must_not_can_be_off():
    with pytest.raises(EngineError):
        filters.parse({"must_not": [{"field": "x", "value": 1}]}, must_not=False)


def test_payload_json(spark):
    text = '{"i":1,"f":1.0,"e":1e3,"big":18446744073709551615,"s":"12","q":"a\\"b\\n","t":true}'
    row = spark.createDataFrame([(text,)], "t string").select(P.from_json(F.col("t")).alias("p"))
    got = P.to_dict(row.first().p)
    assert got == {"i": 1, "f": 1.0, "e": 1000.0, "big": 18446744073709551615.0, "s": "12", "q": 'a"b\n', "t": True}
    assert {k: type(v) for k, v in got.items() if k in "if"} == {"i": int, "f": float}
    back = row.select(P.from_json(P.to_json(F.col("p"))).alias("p")).first().p
    assert P.to_dict(back) == got
    for bad in ('{"a":null}', '{"a":[1]}', '{"a":{"b":1}}'):
        with pytest.raises(Exception, match="must be a string"):
            spark.createDataFrame([(bad,)], "t string").select(P.from_json(F.col("t"))).collect()


def test_planner_table():
    c = ivf.IvfConfig()
    choose = lambda mode, metric, n, fits, **more: planner.choose(mode, metric, n, fits, None, c, **more)
    assert choose(Mode.EXACT, Metric.L2, 9999, True).mode == Mode.EXACT
    assert choose(Mode.AUTO, Metric.DOT, 9999, True).mode == Mode.EXACT
    assert choose(Mode.IVF, Metric.DOT, 9999, True).mode == Mode.IVF
    assert choose(Mode.AUTO, Metric.L2, 2047, True) == planner.EXACT
    with pytest.raises(EngineError):
        choose(Mode.IVF, Metric.L2, 2047, True)
    missing = choose(Mode.IVF, Metric.L2, 2048, False)
    assert (missing.mode, missing.recall_at_k, missing.wants_index, missing.fallback) == (Mode.EXACT, 1.0, True, True)
    assert not choose(Mode.AUTO, Metric.L2, 2048, False).fallback
    assert choose(Mode.AUTO, Metric.L2, 2048, True, n_queries=16, k=64, batch=True).mode == Mode.EXACT
    assert choose(Mode.AUTO, Metric.L2, 2048, True, n_queries=16, k=65, batch=True).mode == Mode.IVF
    assert planner.choose(Mode.AUTO, Metric.L2, 2048, True, 9.0, n_queries=16, k=5, batch=True) == planner.EXACT
    for bad in (0, -1, 1.1, float("nan")):
        with pytest.raises(EngineError):
            planner.check_target(bad)
    assert planner.limit_of(None, Limits(max_topk_limit=5)) == 5


def test_ivf_counts():
    assert [ivf.list_count(n) for n in (2048, 10_000, 10, 5, 1_000_000)] == [45, 100, 8, 5, 256]
    index = ivf.IvfIndex(np.zeros((100, 2)), None, 10_000, 1)
    assert [ivf.probe_count(index, 10), ivf.probe_count(index, 1000), ivf.probe_count(index, 10, 0.5), ivf.probe_count(index, 10, 1.0)] == [8, 10, 50, 100]


def test_ivf_lists_partition_the_points(spark, tmp_path):
    points = spark.range(2048).selectExpr("id", "array(cast(id % 10 + if(id >= 1024, 1000, 0) as float), 0f) as `values`")
    index = ivf.build(points, 2048, 3, path=f"{tmp_path}/lists")
    assert index.lists.count() == 2048 and index.fits(2, 2048, 3) and not index.fits(2, 2048, 4)
    probed = ivf.probes(index, [[1005.0, 0.0]], 8)[0]
    n = index.lists.where(F.col("list_id").isin(probed)).count()
    assert 0 < n < 2048
    with pytest.raises(EngineError):
        ivf.build(points, 100)
