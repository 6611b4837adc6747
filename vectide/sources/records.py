"""Foreign logs and snapshots: JSON lines, framed binary, and both snapshot versions, read as mutations; and written.

A record is {"type": "create_collection" | "delete_collection" | "upsert_point" | "delete_point", ...}.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import invalid
from ..functions import payload as P
from ..model import CREATE, DELETE, REMOVE, UPSERT
from ..operators.mutations import fold, fold_collections
from ..plans.sizes import broadcast_if_small
from ..shipping import ship
from .backup import open_fs
from .log import as_mutations
from .store import Store

RECORD = "type string, version int, name string, dimension int, strict_finite boolean, collection string, id bigint, values array<float>, payload variant, bad string"
#: Bytes of a frame's payload at most.
MAX_FRAME = 64 << 20
FRAME = struct.Struct("<II")
#: Frames of an Arrow batch; bytes of a segment that is written, as a segment is read by one task.
FRAMES, SEGMENT = 10_000, 32 << 20


def parsed(text: Column) -> Column:
    """A record; without a type if the text isn't one."""
    own = F.from_json(text, RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return F.when(own["bad"].isNull(), own)


def as_mutation(version: Column, ord_: Column, r: str = "r") -> list[Column]:
    kind = F.col(f"{r}.type")
    name = F.when(kind.isin(CREATE, DELETE), F.col(f"{r}.name")).otherwise(F.col(f"{r}.collection"))
    payload = F.when(kind == UPSERT, P.from_variant(F.col(f"{r}.payload")))
    fields = [F.col(f"{r}.{c}").alias(c) for c in ("id", "dimension", "strict_finite", "values")]
    return [version.cast("bigint").alias("version"), ord_.cast("bigint").alias("ord"), kind.alias("op"), name.alias("collection"), *fields, payload.alias("payload")]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, at (block start) and row (in the block) of all lines that aren't blank: file, at and row order them as the files do."""
    own = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    return own.where(F.trim("value") != "")


def numbered(own: DataFrame) -> DataFrame:
    """lines with ord: their number over all files, in the order of file, block and row, whatever the files' sizes. A block's first row and
    size are found by one aggregation; only a row a block is put in order."""
    blocks = own.groupBy("file", "at").agg(F.min("row").alias("low"), (F.max("row") - F.min("row") + 1).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = broadcast_if_small(blocks.select("file", "at", "low", before.alias("before")))
    return own.join(places, ["file", "at"]).withColumn("ord", F.col("before") + F.col("row") - F.col("low")).drop("low", "before")


def checked(own: DataFrame, good: Column, passed_over: Column, what: str) -> DataFrame:
    """The rows with records; a row that is neither good, blank nor passed over raises. Spark may evaluate the raise before any filter
    that stands below it, so it has all exceptions in itself."""
    fault = F.raise_error(F.concat(F.lit(f"invalid {what} record: "), F.substring("value", 1, 100))).cast(own.schema["r"].dataType)
    fine = good | passed_over | (F.trim("value") == "")
    return own.withColumn("r", F.when(fine, F.col("r")).otherwise(fault)).where(F.col("r").isNotNull())


def read_json_log(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Mutations of a log in JSON lines: a file, or a folder of segments in the order of their names. A last line of the last segment that
    isn't ended and can't be parsed was cut off and is dropped; any other bad line raises. ord numbers the lines."""
    own = numbered(lines(spark, path)).withColumn("r", parsed(F.col("value")))
    good = F.coalesce(F.col("r.type").isin(CREATE, DELETE, UPSERT, REMOVE), F.lit(False))
    cut = F.lit(False)
    if not Store(spark, path).ends_with_newline():
        last = own.agg(F.max("ord")).first()[0]
        cut = F.col("ord") == last if last is not None else cut
    return checked(own, good, cut, "log").select(*as_mutation(F.lit(version), F.col("ord")))


def frames(data: bytes | memoryview, magic: bytes | None = None) -> Iterator[tuple[int, bytes | memoryview]]:
    """Number and payload of each frame: an 8-byte header, then length and CRC-32 (both 32-bit, little endian) before each
    payload. A last frame that is cut off ends the log; a wrong checksum or length raises."""
    if len(data) < 8:
        return
    if magic is not None and data[:8] != magic:
        raise invalid("invalid binary log header")
    at, n = 8, 0
    while at + FRAME.size <= len(data):
        size, crc = FRAME.unpack_from(data, at)
        n += 1
        if not 0 < size <= MAX_FRAME:
            if size > MAX_FRAME and size > len(data) - at - FRAME.size and data[at : at + 1] == b"{":
                return  # a JSON tail of an older writer
            raise invalid(f"invalid length {size} of frame {n}")
        payload = data[at + FRAME.size : at + FRAME.size + size]
        if len(payload) < size:
            return
        if zlib.crc32(payload) != crc:
            raise invalid(f"checksum of frame {n} is wrong")
        yield n, payload
        at += FRAME.size + size


def frame(payload: bytes) -> bytes:
    return FRAME.pack(len(payload), zlib.crc32(payload)) + payload


def framed(payloads: list[bytes], magic: bytes) -> bytes:
    return magic + b"".join(map(frame, payloads))


def read_binary_log(spark: SparkSession, path: str, magic: bytes | None = None, version: int = 1) -> DataFrame:
    """Mutations of a framed log: a file, or a folder of segments in the order of their names. One file is one task, as its frames can only
    be found from its start; its frames go on in batches, so a task holds the file and one batch. ord numbers the frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for some in batched(frames(memoryview(content.as_buffer()), magic), FRAMES):
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(some), pa.string()), pa.array([n for n, _ in some], pa.int64()), pa.array([str(p, "utf-8") for _, p in some], pa.string())], names=["file", "row", "value"])

    ship(spark)
    own = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row bigint, value string")
    own = numbered(own.withColumn("at", F.lit(0).cast("bigint")))
    return own.withColumn("r", parsed(F.col("value"))).select(*as_mutation(F.lit(version), F.col("ord")))


def write_binary_log(log: DataFrame, path: str, magic: bytes, segment: int = SEGMENT) -> None:
    """A framed log in (version, ord) order, as segments of about `segment` bytes that their names order. Tasks write under names of their
    attempts; those of the attempts that counted are then renamed, so a task that is run again leaves no second copy."""
    temp = f"{path.rstrip('/')}/_attempts"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, to = open_fs(temp)
        place.create_dir(to, recursive=True)
        task = TaskContext.get()
        names, out, size = [], None, 0
        for batch in batches:
            for value in batch.column(0):
                data = frame(value.as_py().encode())
                if out is None or size + len(data) > segment:
                    if out:
                        out.close()
                    names.append(f"{task.partitionId():06d}-{len(names):06d}.{task.taskAttemptId()}")
                    out, size = place.open_output_stream(f"{to}/{names[-1]}", compression=None), 0
                    out.write(magic)
                out.write(data)
                size += len(data)
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    ship(log.sparkSession)
    values = log.orderBy("version", "ord").select(record_json(F.col("op")).alias("value"))
    store = Store(log.sparkSession, path)
    for r in values.mapInArrow(run, "name string").collect():
        store.move_new(f"_attempts/{r['name']}", f"{r['name'].split('.')[0]}.log")
    store.delete("_attempts")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Collections and points of a snapshot: lines after a header of version 2, in a file or a folder's files by their names, or a file with
    one document of version 1."""
    head_file = Store(spark, path).first_file()
    first = spark.read.text(head_file).where(F.trim("value") != "").first() if head_file else None
    if first is None:
        log = spark.createDataFrame([], "value string").withColumn("r", parsed(F.col("value"))).select(*as_mutation(F.lit(0), F.lit(0)))
        return fold_collections(log), fold(log).drop("version", "ord")
    head = _header(first["value"])
    if head is None:
        return _read_document(spark, path)
    if head.get("type") != "snapshot_header":
        raise invalid("a snapshot begins with its header")
    if head.get("version") != 2:
        raise invalid(f"unsupported snapshot version {head.get('version')}")
    own = lines(spark, path).withColumn("r", parsed(F.col("value")))
    good = F.coalesce(F.col("r.type").isin(CREATE, UPSERT, "snapshot_header"), F.lit(False))
    own = checked(own, good, F.lit(False), "snapshot")
    own = own.where(F.col("r.type") != "snapshot_header")
    log = numbered(own).select(*as_mutation(F.lit(0), F.col("ord")))
    return fold_collections(log), fold(log).drop("version", "ord")


def write_snapshot(collections: DataFrame, points: DataFrame, path: str) -> None:
    """A snapshot of version 2: the header, collections, then points by collection and id, as part files that their names order."""
    own = as_mutations(collections, points).select("ord", "collection", "id", record_json(F.col("op")).alias("value"))
    head = own.sparkSession.createDataFrame([(-1, None, None, json.dumps({"type": "snapshot_header", "version": 2}))], own.schema)
    head.unionByName(own).orderBy("ord", "collection", "id").select("value").write.text(path)


def _header(line: str) -> dict | None:
    try:
        found = json.loads(line)
    except ValueError:
        return None
    return found if isinstance(found, dict) and "type" in found else None


def _read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    point = "struct<id:bigint,values:array<float>,payload:variant>"
    schema = f"version int, collections array<struct<name:string,dimension:int,strict_finite:boolean,points:array<{point}>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    version = doc.select("d.version").first()[0]
    if version != 1:
        raise invalid(f"unsupported snapshot version {version}")
    each = doc.select(F.explode("d.collections").alias("c"))
    if each.groupBy("c.name").count().where("count > 1").count():
        raise invalid("duplicate collection in snapshot")
    points = each.select(F.col("c.name").alias("collection"), F.explode("c.points").alias("p"))
    return each.select("c.name", "c.dimension", "c.strict_finite"), points.select("collection", "p.id", "p.values", P.from_variant(F.col("p.payload")).alias("payload"))


def number_json(x: Column) -> Column:
    """A FLOAT as JSON, in its own shortest digits."""
    return x.cast("string")


def record_json(op: Column) -> Column:
    """The JSON record of a mutation row; an empty payload is left out."""
    name = F.concat(F.lit('"collection":'), P.quoted(F.col("collection")))
    values = F.concat(F.lit('"values":['), F.array_join(F.transform("values", number_json), ","), F.lit("]"))
    payload = F.when(F.size(F.coalesce("payload", F.create_map().cast("map<string,struct<s:string,i:bigint,f:double,b:boolean>>"))) > 0, F.concat(F.lit(',"payload":'), P.to_json(F.col("payload")))).otherwise(F.lit(""))
    create = F.concat(F.lit('{"type":"create_collection","name":'), P.quoted(F.col("collection")), F.lit(',"dimension":'), F.col("dimension").cast("string"), F.lit(',"strict_finite":'), F.col("strict_finite").cast("string"), F.lit("}"))
    point = F.concat(F.lit('{"type":"'), op, F.lit('",'), name, F.lit(',"id":'), F.col("id").cast("string"))
    return (
        F.when(op == CREATE, create)
        .when(op == DELETE, F.concat(F.lit('{"type":"delete_collection","name":'), P.quoted(F.col("collection")), F.lit("}")))
        .when(op == REMOVE, F.concat(point, F.lit("}")))
        .when(op == UPSERT, F.concat(point, F.lit(","), values, payload, F.lit("}")))
    )


def write_json_log(log: DataFrame, path: str) -> None:
    """JSON lines in (version, ord) order, as part files that their names order."""
    log.orderBy("version", "ord").select(record_json(F.col("op")).alias("value")).write.text(path)
