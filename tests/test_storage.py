"""Logs, foreign formats, streaming, reports and the driver's entry."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vectide.errors import EngineError
from vectide.functions import payload as P
from vectide.model import MUTATIONS
from vectide.operators import mutations, quotas, reports
from vectide.sources import records
from vectide.sources.log import MutationLog
from vectide.streaming.apply import AppliedTable, follow


def row(version, ord_, op, name, id_=None, dimension=None, strict=None, values=None, payload=None):
    return (version, ord_, op, name, id_, dimension, strict, values, None if payload is None else P.of_dict(payload))


def random_log(n=300, seed=1):
    rng, out, live = random.Random(seed), [], {}
    for i in range(n):
        name = rng.choice("abc")
        kind = rng.random()
        if name not in live or kind < 0.03:
            if name in live:
                out.append(row(1, i, "delete_collection", name))
                del live[name]
            else:
                out.append(row(1, i, "create_collection", name, dimension=2, strict=True))
                live[name] = {}
        elif kind < 0.2:
            out.append(row(1, i, "delete_point", name, rng.randrange(20)))
            live[name].pop(out[-1][4], None)
        else:
            out.append(row(1, i, "upsert_point", name, rng.randrange(20), values=[float(i), 1.0], payload={"n": i}))
            live[name][out[-1][4]] = float(i)
    return out, live


def test_fold_is_a_replay_in_order(spark):
    rows, live = random_log()
    log = spark.createDataFrame(rows, MUTATIONS).repartition(5)
    assert {(r.collection, r.id): r["values"][0] for r in mutations.fold(log).collect()} == {(c, i): v for c, p in live.items() for i, v in p.items()}
    assert {r.name for r in mutations.fold_collections(log).collect()} == set(live)
    assert mutations.faults(log).count() == 0


def test_log_faults(spark):
    rows = [
        row(1, 1, "upsert_point", "a", 1, values=[1.0]), row(1, 2, "create_collection", "a", dimension=2, strict=True), row(1, 3, "upsert_point", "a", 1, values=[1.0]),
        row(1, 4, "create_collection", "a", dimension=2, strict=True), row(1, 5, "create_collection", "a", dimension=3, strict=True), row(1, 6, "delete_point", "a", 77),
        row(1, 7, "delete_collection", "a"), row(1, 8, "delete_point", "a", 1), row(1, 9, "delete_collection", "b"), row(1, 10, "create_collection", "z", dimension=0, strict=True),
        row(1, 11, "upsert_point", "z", 1, values=[]), row(2, 0, "create_collection", "a", dimension=1, strict=True), row(2, 1, "upsert_point", "a", 1, values=[float("inf")]), row(2, 2, "upsert_point", "a", 1, values=[2.0]),
    ]
    got = {(r.version, r.ord): r.reason for r in mutations.faults(spark.createDataFrame(rows, MUTATIONS)).collect()}
    assert got == {(1, 1): "collection does not exist", (1, 3): "wrong dimension", (1, 5): "collection exists with another configuration", (1, 8): "collection does not exist", (1, 11): "collection does not exist", (2, 1): "value is not finite"}


def test_snapshot_and_log(spark, tmp_path):
    rows, live = random_log(200, 3)
    log = MutationLog(spark, f"file://{tmp_path}/log", compact_after=2)
    for i in range(0, 200, 50):
        log.append(spark.createDataFrame(rows[i : i + 50], MUTATIONS))
        log.compact_if_due()
    state = log.load()
    assert {(r.collection, r.id): r["values"][0] for r in state.points.collect()} == {(c, i): v for c, p in live.items() for i, v in p.items()}
    assert state.version == 4 and log.snapshot_version() == 4 and log.backlog()["segments"] == 0


LINES = [
    {"type": "create_collection", "name": "c", "dimension": 2, "strict_finite": True},
    {"type": "upsert_point", "collection": "c", "id": 1, "values": [1.0, 2.0], "payload": {"a": 1, "f": 2.0, "s": "x"}},
    {"type": "upsert_point", "collection": "c", "id": 2, "values": [3.0, 4.0]},
    {"type": "upsert_point", "collection": "c", "id": 1, "values": [5.0, 6.0], "payload": {"b": True}},
    {"type": "delete_point", "collection": "c", "id": 2},
]


def state_of(log):
    return {r.id: (r["values"], P.to_dict(r.payload)) for r in mutations.fold(log).collect()}


def test_json_log(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    whole = "".join(json.dumps(x) + "\n" for x in LINES)
    path.write_text(whole + "\n")
    assert state_of(records.read_json_log(spark, f"file://{path}")) == {1: ([5.0, 6.0], {"b": True})}
    path.write_text(whole + '{"type":"upsert_point","coll')
    assert set(state_of(records.read_json_log(spark, f"file://{path}"))) == {1}
    path.write_text(whole + json.dumps({"type": "delete_point", "collection": "c", "id": 1}))
    assert state_of(records.read_json_log(spark, f"file://{path}")) == {}
    path.write_text('{"type":"upsert_po\n' + whole)
    with pytest.raises(Exception, match="invalid log record"):
        records.read_json_log(spark, f"file://{path}").collect()


def test_json_log_is_written_and_read(spark, tmp_path):
    rows, live = random_log(80, 5)
    records.write_json_log(spark.createDataFrame(rows, MUTATIONS).repartition(4), f"{tmp_path}/out")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [json.loads(x)["type"] for x in text.splitlines()] == [r[2] for r in rows]
    (tmp_path / "one.jsonl").write_text(text)
    got = mutations.fold(records.read_json_log(spark, f"file://{tmp_path}/one.jsonl"))
    assert {(r.collection, r.id): r["values"][0] for r in got.collect()} == {(c, i): v for c, p in live.items() for i, v in p.items()}


def test_binary_log(spark, tmp_path):
    payloads = [json.dumps(x).encode() for x in LINES]
    data = records.framed(payloads, b"TESTLOG1")
    path = tmp_path / "log.bin"
    path.write_bytes(data)
    assert state_of(records.read_binary_log(spark, f"file://{path}", b"TESTLOG1")) == {1: ([5.0, 6.0], {"b": True})}
    path.write_bytes(data[:-3])
    assert set(state_of(records.read_binary_log(spark, f"file://{path}"))) == {1, 2}
    broken = bytearray(data)
    broken[-2] ^= 1
    for bad in (bytes(broken), b"OTHERLOG" + data[8:], data[:8] + b"\0" * 8):
        with pytest.raises(EngineError):
            list(records.frames(bad, b"TESTLOG1"))
    assert list(records.frames(b"")) == []


def test_binary_log_in_segments(spark, tmp_path):
    rows, live = random_log(80, 5)
    records.write_binary_log(spark.createDataFrame(rows, MUTATIONS).repartition(4), f"file://{tmp_path}/out", b"TESTLOG1", segment=700)
    files = sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.endswith(".log"))
    assert len(files) > 4 and not (tmp_path / "out" / "_attempts").exists()
    own = records.read_binary_log(spark, f"file://{tmp_path}/out", b"TESTLOG1")
    assert [(r.ord, r.op) for r in own.orderBy("ord").collect()] == [(i, r[2]) for i, r in enumerate(rows)]
    assert {(r.collection, r.id): r["values"][0] for r in mutations.fold(own).collect()} == {(c, i): v for c, p in live.items() for i, v in p.items()}


def test_snapshot_is_written_and_read(spark, tmp_path):
    rows, live = random_log(80, 6)
    log = spark.createDataFrame(rows, MUTATIONS).repartition(4)
    records.write_snapshot(mutations.fold_collections(log), mutations.fold(log), f"file://{tmp_path}/out")
    collections, points = records.read_snapshot(spark, f"file://{tmp_path}/out")
    assert {r.name for r in collections.collect()} == set(live)
    assert {(r.collection, r.id): r["values"][0] for r in points.collect()} == {(c, i): v for c, p in live.items() for i, v in p.items()}


def test_foreign_snapshots(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text("".join(json.dumps(x) + "\n" for x in [{"type": "snapshot_header", "version": 2}, *LINES[:3]]))
    collections, points = records.read_snapshot(spark, f"file://{path}")
    assert [tuple(r) for r in collections.collect()] == [("c", 2, True)]
    assert {r.id: P.to_dict(r.payload) for r in points.collect()} == {1: {"a": 1, "f": 2.0, "s": "x"}, 2: {}}
    path.write_text(json.dumps({"version": 1, "collections": [{"name": "c", "dimension": 1, "strict_finite": False, "points": [{"id": 4, "values": [1.5], "payload": {"k": 3}}]}]}, indent=1))
    collections, points = records.read_snapshot(spark, f"file://{path}")
    assert [tuple(r) for r in collections.collect()] == [("c", 1, False)] and [(r.id, P.to_dict(r.payload)) for r in points.collect()] == [(4, {"k": 3})]
    for bad in ({"type": "snapshot_header", "version": 3}, LINES[0]):
        path.write_text(json.dumps(bad))
        with pytest.raises(EngineError):
            records.read_snapshot(spark, f"file://{path}")
    path.write_text("")
    assert records.read_snapshot(spark, f"file://{path}")[1].count() == 0


def test_stream_ignores_late_and_repeated_records(spark, tmp_path):
    rows, live = random_log(240, 9)
    log = spark.createDataFrame(rows, MUTATIONS)
    table = AppliedTable(spark, f"file://{tmp_path}/table")
    for part in ("ord % 3 = 2", "ord % 3 = 0", "ord % 3 = 1", "ord % 5 = 0"):
        log.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        follow(spark, f"{tmp_path}/log", table, f"{tmp_path}/cp", available_now=True).awaitTermination()
    expected = {(c, i): v for c, p in live.items() for i, v in p.items()}
    assert {(r.collection, r.id): r["values"][0] for r in table.points().collect()} == expected
    before = table.epoch()
    table.merge(log.where("ord < 100"), before)
    assert table.epoch() == before and table.points().count() == len(expected)


def test_reports(spark):
    values = [5, 1, 9, 9, 3, 7, 2]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 4)], "g string, v long")
    got = {r.g: (r.p0, r.p50, r.p95, r.p100) for r in reports.nearest_rank(df, ["g"], "v", [0, 0.5, 0.95, 1]).collect()}
    pick = lambda q: sorted(values)[int((len(values) - 1) * q + 0.5)]
    assert got == {"g": (pick(0), pick(0.5), pick(0.95), pick(1)), "h": (4, 4, 4, 4)}
    us = spark.createDataFrame([("g", v) for v in (10, 60, 60, 200, 30_000_000)], "g string, us long")
    assert [reports.histogram_percentile(us, ["g"], "us", q).first().percentile for q in (0.0, 0.5, 0.8, 1.0)] == [50, 100, 250, 10_000_000]
    hits = spark.createDataFrame([(1, 1), (1, 2), (2, 9)], "qid long, id long")
    truth = spark.createDataFrame([(1, 1), (1, 3), (2, 9)], "qid long, id long")
    assert {r.qid: r.recall for r in reports.recall_at_k(hits, truth).collect()} == {1: 0.5, 2: 1.0} and reports.mean_recall(hits, truth).first().recall == 0.75
    base = spark.createDataFrame([("a", 100.0, 10.0, 20.0, 0.0), ("b", 100.0, 10.0, 20.0, 0.0), ("c", 0.0, 0.0, 0.0, 0.0)], "k string, throughput double, p95 double, p99 double, error_rate double")
    new = spark.createDataFrame([("a", 94.0, 11.5, 20.0, 0.01), ("c", 1.0, 1.0, 1.0, 0.0)], base.schema)
    failed = {(r.k, r.measure) for r in reports.compare(base, new, "k").where("failed").collect()}
    assert failed == {("a", "throughput"), ("a", "p95"), ("a", "error_rate"), *(("b", m) for m in ("throughput", "p95", "p99", "error_rate"))}
    samples = spark.createDataFrame([("m", f"2024-01-01 00:0{i}:00", float(i * 60)) for i in range(5)], "metric string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert max(r.rate for r in reports.rates(samples).collect()) == pytest.approx(240 / 300)
    fired = reports.alerts(spark.createDataFrame([("m", 5.0), ("n", 5.0)], "metric string, value double"), {"high": ("m", ">", 4.0), "low": ("n", "<", 4.0)})
    assert [r.rule for r in fired.collect()] == ["high"]


def test_rate_limits(spark):
    rows = [("t", f"2024-01-01 00:00:{s:02d}", s) for s in range(5)] + [("t", "2024-01-01 00:01:00", 9), ("u", "2024-01-01 00:00:01", 10)]
    df = spark.createDataFrame(rows, "tenant string, ts string, seq long").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.seq for r in quotas.rate_limited(df, 2).where("admitted").collect()) == [0, 1, 9, 10]
    assert quotas.rate_limited(df, 0).where("admitted").count() == len(rows)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and sorted(r["rank"] for r in rows) == list(range(1, 11))
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lines_are_numbered_over_files_of_any_size(spark):
    """Blocks that begin beyond 2 GiB, in several files; row is what tells a block's rows apart."""
    from vectide.sources import records

    rows = [("b", 0, 5), ("a", 9 << 31, (3 << 33) + 1), ("a", 9 << 31, 3 << 33), ("a", 128 << 20, 0), ("a", 0, 1 << 33), ("b", 0, 6), ("b", 1 << 40, 2 << 33)]
    own = spark.createDataFrame(rows, "file string, at long, row long")
    found = [tuple(r) for r in records.numbered(own).orderBy("ord").select("file", "at", "row", "ord").collect()]
    assert found == [(*r, i) for i, r in enumerate(sorted(rows))]


def test_a_json_log_in_segments(spark, tmp_path):
    """Segments count in the order of their names; only the last one may end in a line that was cut off."""
    import pytest

    from vectide.errors import EngineError
    from vectide.sources import records

    line = lambda id_, x: f'{{"type":"upsert_point","collection":"c","id":{id_},"values":[{x}]}}\n'
    (tmp_path / "log").mkdir()
    for name, text in (("2", line(1, 3) + line(2, 9) + '{"type":"upse'), ("10", line(1, 1) + line(3, 4)), ("_ignored", "x")):
        (tmp_path / "log" / name).write_text(text)
    found = records.read_json_log(spark, f"file://{tmp_path}/log")
    assert [(r.ord, r.id, r["values"]) for r in found.orderBy("ord").collect()] == [(0, 1, [1.0]), (1, 3, [4.0]), (2, 1, [3.0]), (3, 2, [9.0])]
    records.write_json_log(found, f"file://{tmp_path}/again")
    again = records.read_json_log(spark, f"file://{tmp_path}/again").orderBy("ord").collect()
    assert [(r.ord, r.id, r["values"]) for r in again] == [(0, 1, [1.0]), (1, 3, [4.0]), (2, 1, [3.0]), (3, 2, [9.0])]
    (tmp_path / "log" / "1").write_text('{"type":"upse')
    with pytest.raises(Exception, match="invalid log record") as e:
        records.read_json_log(spark, f"file://{tmp_path}/log").collect()
    assert not isinstance(e.value, EngineError)


def test_an_epoch_that_was_lost_on_its_way_runs_again(spark, tmp_path, monkeypatch):
    from vectide.model import MUTATIONS
    from vectide.streaming.apply import AppliedTable

    row = lambda ord_, id_, x: (1, ord_, "upsert_point", "c", id_, None, None, [x], None)
    table = AppliedTable(spark, f"file://{tmp_path}/t")
    table.merge(spark.createDataFrame([row(0, 1, 1.0), row(1, 2, 2.0)], MUTATIONS), 0)
    batch = spark.createDataFrame([row(2, 1, 5.0), row(3, 3, 3.0)], MUTATIONS)
    points = lambda: sorted((r.id, r["values"][0]) for r in AppliedTable(spark, f"file://{tmp_path}/t").points().collect())
    with monkeypatch.context() as m:
        m.setattr(type(table.store), "write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        try:
            table.merge(batch, 1)
        except OSError:
            pass
    # the buckets were written, the pointer wasn't: nothing of the epoch counts, and it runs again
    assert points() == [(1, 1.0), (2, 2.0)] and table.epoch() == 0
    for _ in range(2):
        table.merge(batch, 1)
        assert points() == [(1, 5.0), (2, 2.0), (3, 3.0)] and table.epoch() == 1


def test_rate_windows_behind_the_watermark_are_dropped(spark, tmp_path):
    import datetime as dt

    from vectide.streaming import rates

    source, start = f"file://{tmp_path}/in", dt.datetime(2024, 1, 1)
    schema = "tenant string, ts timestamp"
    (tmp_path / "in").mkdir()
    windows = rates.windows(spark.readStream.schema(schema).parquet(source), 2, "10 minutes")
    held = []
    for hour in range(4):
        spark.createDataFrame([("a", start + dt.timedelta(hours=hour, minutes=m, seconds=s)) for m in range(5) for s in range(3)], schema).write.mode("append").parquet(source)
        query = rates.follow(windows, f"file://{tmp_path}/out", f"file://{tmp_path}/c", available_now=True)
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(held) <= 10 and held[-1] < 10  # 20 windows have been seen
    rows = rates.newest(spark, f"file://{tmp_path}/out").collect()
    assert len(rows) == 20 and {(r.admitted, r.rejected) for r in rows} == {(2, 1)}
