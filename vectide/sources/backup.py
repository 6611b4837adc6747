"""Backup and restore of a root folder: files copied by the executors, with a manifest of sizes and SHA-256."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import conflict, invalid
from ..shipping import ship
from .store import Store

MANIFEST = "MANIFEST.json"


def files_under(store: Store) -> list[str]:
    """Names of all files, relative to the root; a listing, not their contents."""
    root = store.fs.getFileStatus(store._path(store.root)).getPath().toString().rstrip("/")
    found, it = [], store.fs.listFiles(store._path(store.root), True)
    while it.hasNext():
        name = it.next().getPath().toString().removeprefix(root).lstrip("/")
        if name != MANIFEST and not name.startswith("tmp/"):
            found.append(name)
    return sorted(found)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def copied(spark: SparkSession, names: list[str], source: str, target: str | None) -> DataFrame:
    """name, size and sha256 of files as they are copied (target None: as they are read)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, base = open_fs(source)
        dst, to = open_fs(target) if target else (None, "")
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                digest, size = hashlib.sha256(), 0
                if dst:
                    dst.create_dir(f"{to}/{name}".rpartition("/")[0], recursive=True)
                out = dst.open_output_stream(f"{to}/{name}", compression=None) if dst else None
                with src.open_input_stream(f"{base}/{name}", compression=None) as file:
                    while data := file.read(4 << 20):
                        digest.update(data)
                        size += len(data)
                        if out:
                            out.write(data)
                if out:
                    out.close()
                rows.append((name, size, digest.hexdigest()))
            n, s, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.string()), pa.array(s, pa.int64()), pa.array(d, pa.string())], names=["name", "size", "sha256"])

    ship(spark)
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    return frame.repartition(max(1, min(len(names), 1000))).mapInArrow(run, "name string, size bigint, sha256 string")


def backup(spark: SparkSession, root: str, target: str) -> dict:
    """Copies root to a new folder and writes its manifest last: a backup without one isn't whole."""
    out = Store(spark, target)
    if out.exists(MANIFEST):
        raise conflict(f"{target} has a backup already")
    rows = copied(spark, files_under(Store(spark, root)), root.rstrip("/"), target.rstrip("/")).orderBy("name").collect()
    manifest = {"files": [r.asDict() for r in rows], "total_size": sum(r["size"] for r in rows)}
    out.make("")
    out.write_text(MANIFEST, json.dumps(manifest))
    return manifest


def verify(spark: SparkSession, target: str) -> dict:
    out = Store(spark, target)
    if not out.exists(MANIFEST):
        raise invalid(f"{target} has no manifest")
    manifest = json.loads(out.read_text(MANIFEST))
    there = set(files_under(out))
    names = [f["name"] for f in manifest["files"]]
    if missing := sorted(set(names) - there):
        raise invalid(f"backup lacks {missing[:5]}")
    found = {r["name"]: (r["size"], r["sha256"]) for r in copied(spark, names, target.rstrip("/"), None).collect()} if names else {}
    for f in manifest["files"]:
        if found[f["name"]] != (f["size"], f["sha256"]):
            raise invalid(f"{f['name']} differs from the manifest")
    return manifest


def restore(spark: SparkSession, target: str, root: str, force: bool = False) -> dict:
    """Copies a verified backup to a root folder, which must be empty unless force is set."""
    manifest = verify(spark, target)
    out = Store(spark, root)
    if out.names():
        if not force:
            raise conflict(f"{root} is not empty")
        for name in out.names():
            out.delete(name)
    out.make("")
    names = [f["name"] for f in manifest["files"]]
    if names:
        copied(spark, names, target.rstrip("/"), root.rstrip("/")).agg(F.count(F.lit(1))).collect()
    return manifest
