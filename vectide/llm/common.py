"""What the operators of this subpackage share: tables, the shared folder, batches, joins of checked size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Bytes of one Arrow batch that goes to a Python worker.
BATCH_BYTES = 2 << 20
#: Rows that a side of a join may have at most to be broadcast; every use has narrow rows (below 64 bytes).
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Before any Python work: the workers get the code, and Arrow batches end at BATCH_BYTES as well as at the row limit, as texts can be very long."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and everything runs on one machine."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vectide-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clear
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; beyond, Spark joins by shuffle (AQE splits skewed keys)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def texts(column: pa.Array) -> pa.Array:
    """Null texts are empty."""
    return pc.fill_null(column, "")


def flat_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of a batch and the row of each."""
    lists = pc.ascii_split_whitespace(texts(column))
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), rows[full.to_numpy(zero_copy_only=False)]


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's place in the distinct values, and those."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, minlength=n).astype(np.int64)


def slices(column: pa.Array, chars: int):
    """(start, stop) of runs of rows with about `chars` bytes each, one row at least."""
    size = pc.binary_length(texts(column)).to_pylist()
    start, total = 0, 0
    for i, x in enumerate(size):
        if i > start and total + x > chars:
            yield start, i
            start, total = i, 0
        total += x
    if start < len(size):
        yield start, len(size)
