"""Memory of what is read whole."""

import tracemalloc

from vectide.sources import records


def test_a_segment_is_read_without_copies_of_its_frames(spark, tmp_path, monkeypatch):
    """The function that runs in a task, over one segment: it holds a batch of frames, not all of them."""
    import pyarrow as pa

    n, text = 100_000, b'{"type":"delete_point","collection":"a","id":1,"more":"' + b"x" * 200 + b'"}'
    segment = pa.scalar(records.framed([text] * n, b"FRAMES01"), pa.binary())
    tasks = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: (tasks.append(run), self.sparkSession.createDataFrame([], schema))[1])
    (tmp_path / "a.log").write_bytes(b"")
    records.read_binary_log(spark, str(tmp_path), b"FRAMES01")
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([segment])], names=["path", "content"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in tasks[0](iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n
    assert most < segment.as_buffer().size / 2


def test_segments_are_small_enough_for_every_core_of_an_executor():
    assert records.SEGMENT <= 64 << 20
