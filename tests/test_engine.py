"""The engine end to end: collections, points, payloads, search, quotas, files, persistence."""

import pytest

from vectide.errors import EngineError
from vectide.model import Limits
from vectide.operators.ivf import IvfConfig
from vectide.plans import engine as engine_module
from vectide.plans.engine import Engine
from vectide.sources import backup


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/root", ivf_config=IvfConfig(min_points=64))


def fails(code, f, *args, **kwargs):
    with pytest.raises(EngineError) as e:
        f(*args, **kwargs)
    assert e.value.code == code, e.value
    return e.value


def test_collections_and_points(engine):
    assert engine.create_collection(" docs ", 3) == {"name": "docs", "dimension": 3, "strict_finite": True, "point_count": 0}
    fails("conflict", engine.create_collection, "docs", 3)
    for name in ("", "a/b", "a..b", "x" * 129):
        fails("invalid_argument", engine.create_collection, name, 3)
    fails("invalid_argument", engine.create_collection, "big", 5000)
    fails("not_found", engine.get_collection, "nothing")
    first = engine.upsert_points("docs", [(11, [0.5, -1, 2], {"shelf": "north"}), (70, [3, 3, 3], None)])
    assert first == {"created": 2, "updated": 0, "results": [{"id": 11, "created": True}, {"id": 70, "created": True}]}
    # a repeated id is created once, and its last row stays
    out = engine.upsert_points("docs", [(70, [-2, 0, 0.25], None), (8, [1, 1, 1], {"shelf": "south"}), (8, [6, 5, 4], {"copies": 2, "weight": 2.0, "lent": False})])
    assert (out["created"], out["updated"]) == (1, 2) and [r["created"] for r in out["results"]] == [False, True, False]
    assert engine.get_point("docs", 8) == {"id": 8, "values": [6, 5, 4], "payload": {"copies": 2, "weight": 2.0, "lent": False}}
    assert [type(engine.get_point("docs", 8)["payload"][k]) for k in ("copies", "weight", "lent")] == [int, float, bool]
    assert engine.get_point("docs", 70)["values"] == [-2, 0, 0.25]
    assert engine.upsert_point("docs", 1, [9, 9, 9])["created"] is True and engine.get_point("docs", 1)["payload"] == {}
    engine.delete_point("docs", 11)
    assert [c["point_count"] for c in engine.list_collections()] == [3]
    for bad in ([(1, [1, 2], None)], [(1, [1, 2, float("nan")], None)], [(1, [1, 2, 1e39], None)], [(-1, [1, 2, 3], None)], [(1, [1, 2, 3], {" ": 1})], [(1, [1, 2, 3], {"a": None})], [(1, [1, 2, 3], {"a": [1]})], []):
        fails("invalid_argument", engine.upsert_points, "docs", bad)
    engine.delete_point("docs", 1)
    fails("not_found", engine.get_point, "docs", 1)
    fails("not_found", engine.delete_point, "docs", 1)
    engine.delete_collection("docs")
    fails("not_found", engine.delete_collection, "docs")
    engine.create_collection("docs", 2)
    assert engine.get_collection("docs")["point_count"] == 0


def test_topk_order_ties_and_batch(engine):
    engine.create_collection("c", 2, strict_finite=False)
    engine.upsert_points("c", [(2, [1, 0], None), (1, [1, 0], None), (3, [0, 0], None), (4, [0.5, 0.5], None)])
    assert [h["id"] for h in engine.search_topk("c", [1, 0], "dot", 2)["hits"]] == [1, 2]
    found = engine.search_topk("c", [1, 0], "cosine", 10)
    assert [h["id"] for h in found["hits"]] == [1, 2, 4] and found["mode"] == "exact" and found["recall_at_k"] == 1.0
    l2 = engine.search_topk("c", [0, 0], "l2", 10)["hits"]
    assert [h["id"] for h in l2] == [3, 4, 1, 2] and l2[1]["value"] == pytest.approx(0.5**0.5)
    batch = engine.search_topk_batch("c", [[1, 0], [0, 1]], "dot", 2)
    assert [[h["id"] for h in b["hits"]] for b in batch] == [[1, 2], [4, 1]]
    many = engine.search_topk_batch("c", [[1, i] for i in range(20)], "l2", 3)
    single = [engine.search_topk("c", [1, i], "l2", 3) for i in (0, 7)]
    assert [many[0]["hits"], many[7]["hits"]] == [s["hits"] for s in single]
    assert engine.search("c", [1, 0], "l2")["id"] == 1
    fails("invalid_argument", engine.search_topk, "c", [0, 0], "cosine")
    fails("invalid_argument", engine.search_topk, "c", [1, 0, 0])
    fails("invalid_argument", engine.search_topk, "c", [1, float("inf")])
    fails("invalid_argument", engine.search_topk, "c", [1, 0], limit=0)
    fails("invalid_argument", engine.search_topk, "c", [1, 0], limit=1001)
    fails("invalid_argument", engine.search_topk, "c", [1, 0], metric="cos")
    fails("invalid_argument", engine.search_topk, "c", [1, 0], "l2", mode="ivf")
    fails("invalid_argument", engine.search_topk_batch, "c", [])
    engine.create_collection("empty", 2)
    assert engine_module.NO_POINTS == fails("invalid_argument", engine.search_topk, "empty", [1, 0], filter={"must": [{}]}).message


def test_filters_and_payload(engine):
    engine.create_collection("f", 2)
    engine.upsert_points("f", [(1, [1, 0], {"category": "a", "score": 0.7, "active": False}), (2, [0.9, 0], {"category": "a", "score": 0.2, "active": True}), (3, [0.8, 0], {"category": "a", "score": 0.1, "active": False}), (4, [0.95, 0], {"category": "b", "score": 0.9, "active": True})])
    raw = {"must": [{"field": "category", "value": "a"}], "should": [{"field": "score", "gte": 0.6}, {"field": "active", "value": True}], "minimum_should_match": 1}
    found = engine.search_topk("f", [1, 0], filter=raw)
    assert [h["id"] for h in found["hits"]] == [1, 2] and found["hits"][0]["payload"]["score"] == 0.7
    assert "payload" not in engine.search_topk("f", [1, 0], filter=raw, include_payload=False)["hits"][0]
    assert engine.count_points("f", raw) == 2 and engine.count_points("f") == 4
    assert engine.search_topk("f", [1, 0], filter={"must": [{"field": "category", "value": "z"}]})["hits"] == []
    assert engine_module.NO_POINTS == fails("invalid_argument", engine.search, "f", [1, 0], filter={"must": [{"field": "category", "value": "z"}]}).message
    fails("invalid_argument", engine.search, "f", [1, 0], filter={"must": [{"field": "x", "value": 1, "gt": 2}]})
    assert engine.set_payload("f", [1, 2, 2], {"tier": "pro", "score": 5}) == 2
    assert engine.get_point("f", 1)["payload"] == {"category": "a", "score": 5, "active": False, "tier": "pro"}
    assert engine.set_payload("f", [1, 2], {"tier": "pro"}) == 0
    fails("not_found", engine.set_payload, "f", [1, 99], {"tier": "x"})
    assert engine.delete_payload_keys("f", [1, 4], ["tier", " tier ", "score"]) == 2
    assert engine.get_point("f", 1)["payload"] == {"category": "a", "active": False}
    fails("invalid_argument", engine.delete_payload_keys, "f", [1], [" "])


def test_ivf_modes(engine, spark):
    engine.create_collection("i", 2)
    frame = spark.range(300).selectExpr("id", "array(cast(id % 32 as float), cast(id % 7 as float)) as `values`")
    engine.upsert_frame("i", frame)
    exact = engine.search_topk("i", [3, 1], "l2", 5, "exact")
    first = engine.search_topk("i", [3, 1], "l2", 5, "ivf")
    assert first["mode"] == "exact" and first["recall_at_k"] == 1.0 and engine.counters.ivf_fallbacks == 1 and engine.index_due("i")
    engine.build_index("i")
    assert not engine.index_due("i")
    full = engine.search_topk("i", [3, 1], "l2", 5, "ivf", target_recall=1.0)
    assert full["mode"] == "ivf" and "recall_at_k" not in full and full["hits"] == exact["hits"]
    assert engine.search_topk("i", [3, 1], "l2", 5)["mode"] == "ivf"
    assert engine.search_topk("i", [3, 1], "dot", 5)["mode"] == "exact"
    assert engine.search_topk("i", [3, 1], "dot", 5, "ivf", target_recall=1.0)["hits"] == engine.search_topk("i", [3, 1], "dot", 5, "exact")["hits"]
    assert engine.search_topk_batch("i", [[3, 1]] * 20, "l2", 5)[0]["mode"] == "exact"
    assert engine.search_topk_batch("i", [[3, 1]] * 2, "l2", 5)[0]["mode"] == "ivf"
    fails("invalid_argument", engine.search_topk, "i", [3, 1], "l2", 5, "ivf", target_recall=1.5)
    engine.upsert_point("i", 1000, [3, 1])
    assert engine.search_topk("i", [3, 1], "l2", 5)["mode"] == "exact"
    values = {r["metric"]: r["value"] for r in engine.metrics().collect()}
    assert values["points"] == 301 and values["index_builds"] == 1 and values["searches_ivf"] >= 4


def test_frames_are_checked(engine, spark):
    engine.create_collection("d", 2)
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, values array<float>")
    fails("invalid_argument", engine.upsert_frame, "d", bad)
    fails("invalid_argument", engine.upsert_frame, "d", spark.createDataFrame([(1, [1.0, float("inf")])], "id long, values array<float>"))
    assert engine.get_collection("d")["point_count"] == 0
    rows = spark.createDataFrame([(1, [1.0, 2.0], 5), (1, [3.0, 4.0], 9), (1, [5.0, 6.0], 7)], "id long, values array<float>, at long")
    engine.upsert_frame("d", rows, order="at")
    assert engine.get_point("d", 1)["values"] == [3, 4]


def test_paging(engine):
    engine.create_collection("p", 1)
    engine.upsert_points("p", [(i, [1], None) for i in (50, 10, 30, 20, 40)])
    assert engine.list_points("p", 2, after_id=20) == {"points": [30, 40], "total": 5, "next_offset": None, "next_after_id": 40}
    assert engine.list_points("p", 2, after_id=40)["next_after_id"] is None
    assert engine.list_points("p", 2, 1) == {"points": [20, 30], "total": 5, "next_offset": 3, "next_after_id": 30}
    assert engine.list_points("p", 2, 3)["next_offset"] is None
    for args in ((0,), (1001,), (2, 1, 5), (2, 100_001)):
        fails("invalid_argument", engine.list_points, "p", *args)


def test_tenants_and_quotas(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/root", Limits(max_collections=1, max_points=3, memory_budget_bytes=4 * 2 * 5, max_points_per_collection=4))
    engine.create_collection("c", 2, tenant="a")
    fails("resource_exhausted", engine.create_collection, "d", 2, tenant="a")
    engine.create_collection("c", 2, tenant="b")
    assert [c["name"] for c in engine.list_collections("a")] == ["c"]
    fails("not_found", engine.get_collection, "c", tenant="x")
    engine.upsert_points("c", [(i, [1, 1], None) for i in range(3)], tenant="a")
    fails("resource_exhausted", engine.upsert_point, "c", 9, [1, 1], tenant="a")
    engine.upsert_point("c", 1, [2, 2], tenant="a")
    fails("resource_exhausted", engine.upsert_points, "c", [(i, [1, 1], None) for i in range(3)], tenant="b")
    engine.upsert_points("c", [(i, [1, 1], None) for i in range(2)], tenant="b")
    assert engine.get_collection("c", tenant="b")["point_count"] == 2


def test_persistence_and_compaction(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    engine = Engine(spark, root, Limits(compact_after=3))
    engine.create_collection("c", 1)
    engine.upsert_point("c", 1, [1], {"a": 1})
    assert engine.log.backlog()["segments"] == 2
    engine.upsert_point("c", 2, [2])
    assert engine.log.backlog()["segments"] == 0 and engine.log.snapshot_version() == 3
    engine.delete_point("c", 1)
    again = Engine(spark, root)
    assert again.list_points("c")["points"] == [2] and again.log.version() == 4
    other = Engine(spark, root)
    other._load()
    again.upsert_point("c", 7, [7])
    with pytest.raises(EngineError) as e:
        other.log.append(spark.createDataFrame([Engine._row(0, "upsert_point", "c", 8, values=[1.0], payload={})], "version long, ord long, op string, collection string, id long, dimension int, strict_finite boolean, values array<float>, payload map<string,struct<s:string,i:bigint,f:double,b:boolean>>"), 4)
    assert e.value.code == "conflict" and Engine(spark, root).list_points("c")["points"] == [2, 7]
    manifest = backup.backup(spark, root, f"file://{tmp_path}/backup")
    assert manifest["total_size"] > 0
    again.delete_collection("c")
    fails("conflict", backup.restore, spark, f"file://{tmp_path}/backup", root)
    backup.restore(spark, f"file://{tmp_path}/backup", f"file://{tmp_path}/other")
    assert Engine(spark, f"file://{tmp_path}/other").list_points("c")["points"] == [2, 7]
    victim = next(p for p in (tmp_path / "backup").rglob("*.parquet"))
    victim.write_bytes(victim.read_bytes() + b"x")
    fails("invalid_argument", backup.verify, spark, f"file://{tmp_path}/backup")


def test_export_and_import(engine, tmp_path):
    engine.create_collection("src", 2)
    engine.upsert_points("src", [(i, [i / 3, -i], {"k": i, "s": 'q"uo\\te\n', "f": 2.0, "b": i > 1}) for i in range(4)])
    path = f"file://{tmp_path}/dump"
    engine.export("src", path)
    assert engine.import_(path, "copy") == 4
    for i in range(4):
        assert engine.get_point("copy", i) == engine.get_point("src", i)
    fails("conflict", engine.import_, path, "copy")
    engine.upsert_point("copy", 99, [1, 1])
    engine.import_(path, "copy", "append")
    assert engine.get_collection("copy")["point_count"] == 5
    engine.import_(path, "copy", "replace")
    assert engine.get_collection("copy")["point_count"] == 4
    engine.create_collection("other", 3)
    fails("conflict", engine.import_, path, "other", "append")
    fails("invalid_argument", engine.import_, path, "x", "maybe")


def test_sessions(engine):
    from vectide.plans.session import RateWindows, Session

    clock = [0.0]
    rates = RateWindows(3, 1, lambda: clock[0])
    own = Session(engine, "t", ["write"], rates)
    own.create_collection("c", 2)
    own.upsert_point("c", 1, [1, 0])
    assert own.search_topk("c", [1, 0])["hits"][0]["id"] == 1
    fails("resource_exhausted", own.list_points, "c")
    clock[0] = 61
    assert own.list_points("c")["points"] == [1] and own.distance([1, 2], [3, 4]) == 11
    reader = Session(engine, "t", ["read"])
    assert reader.get_point("c", 1)["values"] == [1, 0]
    fails("permission_denied", reader.delete_collection, "c")
    fails("permission_denied", Session(engine, "t", []).get_point, "c", 1)
    fails("not_found", Session(engine, "other").get_point, "c", 1)
    clock[0] = 400
    Session(engine, "u", ["read"], rates).list_collections()
    assert set(rates.windows) == {"u"}


def test_counts_are_known_without_folding_the_log(engine, monkeypatch):
    """Counts that an engine carries along are those of a fold, after every kind of write and by every writer."""
    engine.create_collection("a", 2)
    engine.create_collection("b", 2)
    engine.upsert_points("a", [(i, [i, 1], None) for i in (1, 2, 3, 3)])
    engine.upsert_frame("b", engine.spark.createDataFrame([(5, [1.0, 2.0]), (5, [1.0, 3.0]), (6, [0.0, 0.0])], "id long, values array<float>"))
    engine.upsert_point("b", 6, [4, 4])
    engine.delete_point("a", 2)
    engine.set_payload("a", [1], {"k": 1})
    other = engine_module.Engine(engine.spark, engine.log.store.root)
    assert engine.list_collections() == other.list_collections()
    assert [c["point_count"] for c in engine.list_collections()] == [2, 2]
    other.upsert_point("a", 9, [1, 1])
    other.delete_collection("b")
    assert engine.list_collections() == other.list_collections() and engine.count_points("a") == 3
    assert other.get_collection("a")["point_count"] == 3


def test_a_failed_snapshot_keeps_the_write_and_tells(spark, tmp_path, monkeypatch):
    engine = Engine(spark, f"{tmp_path}/e", Limits(compact_after=2))
    engine.create_collection("c", 2)
    fails = lambda: (_ for _ in ()).throw(OSError("no space"))
    with monkeypatch.context() as m:
        m.setattr(engine.log, "compact", fails)
        engine.upsert_point("c", 1, [1.0, 2.0])
    values = lambda: {r.metric: r.value for r in engine.metrics().collect()}
    assert not engine.ready
    assert (values()["ready"], values()["snapshot_failures"], values()["snapshots"]) == (0, 1, 0)
    assert Engine(spark, f"{tmp_path}/e").get_point("c", 1)["values"] == [1.0, 2.0]
    engine.upsert_point("c", 2, [3.0, 4.0])
    assert engine.ready
    assert (values()["ready"], values()["snapshots"], values()["snapshot_version"], values()["points"]) == (1, 1, 3, 2)
