"""Line dedup: two Bloom filters find the lines that may repeat, and only those are shuffled.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. A key of at least `min_chars` code points
that at least `min_docs` documents hold loses all its lines but those of the largest doc_id that holds it. The other lines
stay, joined by \\n. Null or empty text is one empty line. Each row is a document; rows that repeat a doc_id are all the
largest if one is. A null doc_id is smaller than any other.

1. Each document's distinct keys, as 128-bit digests, go to a table in the shared folder (16 bytes a key). Equal digests
   are taken for equal keys.
2. The keys are looked at in shards, by the first bits of their digests: as many as make a filter of 10 bits a key have at
   most `max_bits`. For each shard in turn, each partition fills two filters: keys seen once, and keys seen again while in
   the first. Filters meet by twos: what both have seen once was seen twice. The union goes through a tree of `FAN` filters
   a task. So filters, and what is broadcast, have a fixed bound at any number of keys, and never get denser.
3. Only suspected keys, with their doc_id, are shuffled and counted; counts are partial first, so that a line in a third
   of all documents is a few rows. Those that are found in enough documents make the table of dropped keys.
4. Up to `max_broadcast` dropped keys are broadcast, and the texts aren't shuffled at all. With more, each document's
   dropped keys are joined to it.

Repeated rows are documents of their own; an empty table gives an empty result. Columns that aren't passed aren't read; one that
is passed under the name of a result gives way to it.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, codes, materialize, new_path, texts

MIN_CHARS, MIN_DOCS = 20, 3
BITS_A_KEY, PROBES, MIN_BITS, MAX_BITS, FAN = 10, 4, 1 << 16, 1 << 28, 16
MAX_BROADCAST = 500_000
RESULT = ("doc_id", "text", "n_lines", "n_dropped", "kept_sha256")


def line_keys(column: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """All lines of a batch, the row of each, and their keys."""
    lists = pc.split_pattern(texts(column), "\n")
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    lines = lists.flatten()
    return lines, rows, pc.ascii_lower(pc.ascii_trim_whitespace(lines))


def digests(keys: pa.Array) -> np.ndarray:
    """16 bytes for each key."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys.cast(pa.binary()).to_pylist()]), dtype="V16")


def key_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, and the digests of the document's distinct long keys, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows, keys = line_keys(batch.column(1))
            long = pc.greater_equal(pc.utf8_length(keys), min_chars)
            own, names = codes(keys.filter(long))
            pairs = np.unique(rows[long.to_numpy(zero_copy_only=False)] * max(1, len(names)) + own)
            row, own = np.divmod(pairs, max(1, len(names)))
            data = digests(names)[own].tobytes() if len(pairs) else b""
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]) * 16
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["doc_id", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, keys binary")


def halves(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, dtype="<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Filter:
    """A Bloom filter of 2^k bits."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.bytes = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8).copy()

    def places(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(PROBES):
            yield (a + np.uint64(i) * (b | np.uint64(1))) & np.uint64(self.bits - 1)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for at in self.places(a, b):
            np.bitwise_or.at(self.bytes, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.ones(len(a), bool)
        for at in self.places(a, b):
            found &= (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


class Seen:
    """The filters of keys seen once and of keys seen twice."""

    def __init__(self, bits: int):
        self.once, self.twice = Filter(bits), Filter(bits)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(a)))
        a, b = a[first], b[first]
        again = (count > 1) | self.once.has(a, b)
        self.twice.add(a[again], b[again])
        self.once.add(a, b)

    def merge(self, once: bytes, twice: bytes) -> None:
        more = np.frombuffer(once, np.uint8)
        self.twice.bytes |= np.frombuffer(twice, np.uint8) | (self.once.bytes & more)
        self.once.bytes |= more


def pack(filter_: Filter) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(filter_.bytes.tobytes())


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def filter_bits(n_keys: int) -> int:
    return max(MIN_BITS, 1 << (BITS_A_KEY * n_keys - 1).bit_length() if n_keys else 0)


def shard(a: np.ndarray, shards: int) -> np.ndarray:
    """Of keys, by the first bits of a digest's first half; filters use its last ones. shards: a power of 2."""
    return a >> np.uint64(65 - shards.bit_length()) if shards > 1 else np.zeros(len(a), np.uint64)


def seen_twice(keys: DataFrame, bits: int, own: int = 0, shards: int = 1) -> bytes:
    """The packed filter of a shard's keys that were seen twice."""

    def emit(seen: Seen) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pack(seen.once)], pa.binary()), pa.array([pack(seen.twice)], pa.binary())], names=["once", "twice"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, full = Seen(bits), False
        for batch in batches:
            if data := b"".join(batch.column(0).to_pylist()):
                a, b = halves(data)
                mine = shard(a, shards) == own
                full = full or bool(mine.any())
                seen.add(a[mine], b[mine])
        if full:
            yield emit(seen)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, full = Seen(bits), False
        for batch in batches:
            for once, twice in zip(batch.column(0), batch.column(1), strict=True):
                full = True
                seen.merge(unpack(once.as_py()), unpack(twice.as_py()))
        if full:
            yield emit(seen)

    schema = "once binary, twice binary"
    filters = keys.select("keys").mapInArrow(build, schema)
    parts = keys.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN)
        filters = filters.repartition(parts).mapInArrow(join, schema)
    found = filters.select("twice").collect()
    return found[0][0] if found else pack(Filter(bits))


def suspects(keys: DataFrame, bits: int, packed: bytes, own: int = 0, shards: int = 1) -> DataFrame:
    """(digest, doc_id) of a shard's keys that may be in several documents."""
    shared = keys.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Filter(bits, unpack(shared.value))
        for batch in batches:
            data = batch.column(1).to_pylist()
            rows = np.repeat(np.arange(len(data)), [len(x) // 16 for x in data])
            joined = b"".join(data)
            a, b = halves(joined)
            mine = np.flatnonzero(shard(a, shards) == own)
            found = mine[twice.has(a[mine], b[mine])]
            yield pa.RecordBatch.from_arrays([pa.array([joined[i : i + 16] for i in (found * 16).tolist()], pa.binary()), batch.column(0).take(pa.array(rows[found]))], names=["digest", "doc_id"])

    return keys.mapInArrow(run, f"digest binary, doc_id {keys.schema['doc_id'].dataType.simpleString()}")


def all_suspects(keys: DataFrame, max_bits: int) -> DataFrame:
    """(digest, doc_id) of all keys that may be in several documents, in the shared folder: one shard after the other."""
    spark = keys.sparkSession
    n_keys = keys.agg(F.coalesce(F.sum(F.length("keys")), F.lit(0))).first()[0] // 16
    whole = filter_bits(n_keys)
    bits = min(whole, 1 << (max_bits.bit_length() - 1))
    path, shards = new_path(spark, "line-suspects"), whole // bits
    for own in range(shards):
        suspects(keys, bits, seen_twice(keys, bits, own, shards), own, shards).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def dedup_lines(docs: DataFrame, *passed: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, the text without its dropped lines, n_lines (before), n_dropped, kept_sha256 (of that text), and the columns `passed` of docs. max_bits: of a filter."""
    bound_batches(docs.sparkSession)
    passed = tuple(c for c in passed if c not in RESULT)
    docs = docs.select("doc_id", "text", *passed)
    found = all_suspects(materialize(key_table(docs, min_chars), "line-keys"), max_bits)
    dropped = materialize(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs).select("digest", "last"), "dropped-lines")
    if dropped.count() <= max_broadcast:
        rows = dropped.toArrow()
        last = docs.sparkSession.sparkContext.broadcast(dict(zip(rows["digest"].to_pylist(), rows["last"].to_pylist(), strict=True)))
        return apply(docs, passed, min_chars, lambda digest, doc_id, _: digest in last.value and last.value[digest] != doc_id)
    # a digest that is in a third of all documents is one row of `dropped`: the join splits its large side (AQE)
    own = found.join(dropped, "digest").where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("doc_id").agg(F.collect_set("digest").alias("drop")).withColumnRenamed("doc_id", "own")
    whole = docs.select(F.struct(*docs.columns).alias("row")).join(own, F.col("row.doc_id").eqNullSafe(F.col("own")), "left")
    spare = next(x for i in itertools.count() if (x := f"drop{i}") not in passed)
    return apply(whole.select("row.*", F.col("drop").alias(spare)), passed, min_chars, lambda digest, _, drop: digest in drop)


def apply(docs: DataFrame, passed: tuple[str, ...], min_chars: int, gone) -> DataFrame:
    """docs: doc_id, text, the columns `passed`, and perhaps a set of digests. gone: tells of a digest, a doc_id and that set whether the document loses the line."""
    n = 2 + len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, rows, keys = line_keys(batch.column(1))
            long = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
            own, names = codes(keys.take(pa.array(long)))
            digest = [bytes(x) for x in digests(names)] if len(names) else []
            ids = batch.column(0).to_pylist()
            sets = [frozenset(x or ()) for x in batch.column(n).to_pylist()] if batch.num_columns > n else [None] * len(ids)
            lost = np.zeros(len(lines), bool)
            row = rows[long].tolist()
            lost[long] = np.fromiter((gone(digest[c], ids[r], sets[r]) for c, r in zip(own.tolist(), row, strict=True)), bool, len(long))
            n_lines, n_dropped = np.bincount(rows, minlength=len(ids)), np.bincount(rows[lost], minlength=len(ids))
            kept = texts(batch.column(1)).to_pylist()
            starts = np.concatenate([[0], np.cumsum(n_lines)])
            for r in np.flatnonzero(n_dropped).tolist():
                part = lines.slice(starts[r], n_lines[r]).filter(pa.array(~lost[starts[r] : starts[r + 1]]))
                kept[r] = "\n".join(part.to_pylist())
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string()), *batch.columns[2:n]], names=[*RESULT, *passed])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in passed)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_lines long, n_dropped long, kept_sha256 string{kinds}")
