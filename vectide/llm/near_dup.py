"""Near duplicates by SetSketch registers: sketch, band, estimate by likelihood, verify on full sets, connect.

A document's set: the distinct shingles of `words` words [^\\x20\\x09-\\x0D]+ of its A-Z lower-cased text; with fewer words,
the whole sequence as one shingle; without words (or null text) the empty set, linked with nothing. Shingles are compared
by 64-bit hashes. Two documents are linked if 100 * |A & B| >= 100 * threshold * |A | B|. A component's documents carry its
smallest doc_id; `kept` is true for that document. Rows that repeat a doc_id stay rows, and are told apart by their texts. A
document with null doc_id takes part; it is kept only if no document with a doc_id is in its component, and only one text of
such a component is; component_id is null then. An empty table gives an empty result.

1. Sketch. Register i is floor(1 - log_b x) of the smallest x = Exp(A)-distributed hash of the set's elements, cut to
   0..Q + 1: the registers of a union are the maxima of the parts', and the chance that two sets agree in a register is
   close to their similarity J (b is near 1).
2. Documents with equal sets are one class from here on (a partial aggregation; thousands of copies cost a row a task).
3. Bands of ROWS registers. Pairs at J = 0.8 share none of the BANDS bands with probability (1 - 0.8^6)^42 = 3e-6.
   A band value with one class is dropped, the others are buckets. Rows of a bucket of over SPREAD members are dealt to salts
   of about SPREAD, so no bucket meets in one task: what a bucket is joined to is one row, which is sent to each salt.
4. A round pairs each class of a bucket with one class of it, the hub: as many pairs as members, never all pairs of a bucket.
   The joint likelihood of the registers' comparisons, given both sets' sizes, estimates J; pairs more than MARGIN (six
   standard deviations) below the threshold go. The others are verified on their full sets, which are written once for
   all classes that are in a bucket. A hub's registers and set are sent once to each salt of its pairs, not once a member.
5. Links are contracted to components by min-label propagation with pointer jumping; each round's labels are written to the
   shared folder. The next round pairs only classes of one bucket that are in different components, and as long as
   such pairs are many, again against one class for each. The last round takes all pairs of different components that still
   share a bucket, so that no link is lost; it comes as soon as a round hasn't halved them. Its pairs come from a prefix join:
   elements in one order for all sets, the rarest first (by counts in SLOTS slots), two sets that are linked share one of the
   first fifth of the larger set and the first ninth of the smaller (at J = 0.8), with enough left after it; and the
   parities of their elements' counts in PARITIES slots differ in no more slots than they may differ in elements. Both
   bounds are exact. So what is sent grows with the elements, not with a bucket's square, and few pairs that aren't linked
   are made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, codes, flat_words, materialize, small

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
#: Base of the registers, rate of the exponential distribution, largest exponent.
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
MARGIN = 0.15
#: Rounds of one partner each at most, and pairs a class at which they end.
ROUNDS, FEW = 4, 1.0
#: Members of a salt, about; slots of element counts, and of their parities in a set (a multiple of 64).
SPREAD, SLOTS, PARITIES = 64, 1 << 20, 512

_seed = np.random.Generator(np.random.PCG64(20))
FACTORS = _seed.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text of a batch."""
    flat, rows = flat_words(column)
    own, names = codes(pc.ascii_lower(flat))
    names = names.cast(pa.binary()).to_pylist()
    of_word = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)
    h = of_word[own] if len(own) else np.zeros(0, np.uint64)
    n = max(0, len(h) - words + 1)
    code = np.zeros(n, np.uint64)
    for i in range(words):
        code = code * np.uint64(0x100000001B3) + h[i : i + n]
    code = mixed(code)
    whole = rows[:n] == rows[words - 1 : words - 1 + n]
    code, at = code[whole], rows[:n][whole]
    borders = np.searchsorted(at, np.arange(len(column) + 1))
    sets = [np.unique(code[a:b]) for a, b in zip(borders, borders[1:], strict=False)]
    counts = np.bincount(rows, minlength=len(column))
    first = np.concatenate([[0], np.cumsum(counts)])
    for r in np.flatnonzero((counts > 0) & (counts < words)).tolist():
        text = b" ".join(names[c] for c in own[first[r] : first[r + 1]].tolist())
        sets[r] = np.array([xxhash.xxh3_64_intdigest(text, seed=int(counts[r]))], np.uint64)
    return sets


def registers(elements: np.ndarray) -> np.ndarray:
    """The registers of a set that isn't empty."""
    a, b = (elements & np.uint64(0xFFFFFFFF)).astype(np.uint32), (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(a), 1024):
        least = np.minimum(least, np.min(a[i : i + 1024, None] * FACTORS + b[i : i + 1024, None], axis=0))
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def signature(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sketch(docs: DataFrame, words: int, *passed: str) -> DataFrame:
    """doc_id, key (of the text), passed (a struct), n_shingles, sig and registers of every row; sig and registers are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(0), words)
            sig = [signature(s) if len(s) else None for s in sets]
            own = [registers(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(map(len, sets), pa.int64(), size=len(sets)), pa.array(sig, pa.binary()), pa.array(own, pa.binary())], names=["doc_id", "key", "passed", "n_shingles", "sig", "registers"])

    more = F.struct(*[F.col(c) for c in passed]) if passed else F.lit(None).cast("string")
    sent = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), more.alias("passed"))
    kind = sent.schema["passed"].dataType.simpleString()
    return sent.mapInArrow(run, f"doc_id long, key long, passed {kind}, n_shingles long, sig binary, registers binary")


def classes_of(rows: DataFrame) -> DataFrame:
    """sig, class (a number), n, registers, least (the smallest doc_id) and the doc_id and text key of one row of each set that isn't empty."""
    own = rows.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.min("doc_id").alias("least"), F.min(F.struct("key", "doc_id")).alias("row"))
    return own.select("sig", F.monotonically_increasing_id().alias("class"), "n", "registers", "least", "row.key", "row.doc_id")


def bands(classes: DataFrame) -> DataFrame:
    """(class, band): a row for each of the BANDS bands of every class."""
    own = F.array(*[F.xxhash64(F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS), F.lit(i)) for i in range(BANDS)])
    return classes.select("class", F.explode(own).alias("band"))


def spread(rows: DataFrame, salts: str = "salts") -> DataFrame:
    """Each row once for each of its salts."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col(salts) - 1))).drop(salts)


def salt_of(column: str, salts: str = "salts") -> Column:
    return F.pmod(F.xxhash64(column), F.col(salts)).cast("int")


def buckets(classes: DataFrame) -> DataFrame:
    """(band, salt, class, salts) of the bands that several classes have."""
    found = bands(classes)
    salts = F.ceil(F.col("members") / SPREAD).cast("int")
    shared = materialize(found.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1).select("band", salts.alias("salts")), "bands")
    hot = small(shared.where(F.col("salts") > 1)).withColumnRenamed("salts", "parts")
    dealt = found.join(hot, "band", "left").select("band", "class", F.coalesce(salt_of("class", "parts"), F.lit(0)).alias("salt"))
    return dealt.join(spread(shared.withColumn("parts", F.col("salts"))).withColumnRenamed("parts", "salts"), ["band", "salt"]).select("band", "salt", "class", "salts")


def likelihood_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """J of pairs of sets, from their registers (pairs x registers) and sizes, by the maximum of the joint likelihood."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(x) + less * np.log(y) + equal * np.log(np.clip(1 - x - y, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood is concave
        third = (high - low) / 3
        up = value(low + third) < value(high - third)
        low, high = np.where(up, low + third, low), np.where(up, high, high - third)
    return (low + high) / 2


def sets_of(classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(class, set): the shingle sets of classes (class, sig and the doc_id and text key of a row), from the texts again; 8 bytes a shingle."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2), words)
            own = pa.array([signature(s) == sig for s, sig in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "set"]).filter(own)

    wanted = small(classes.select("class", "sig", F.col("key").alias("of_key"), F.col("doc_id").alias("of_id")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))
    found = rows.join(wanted, (rows["key"] == wanted["of_key"]) & rows["doc_id"].eqNullSafe(wanted["of_id"])).select("class", "sig", "text")
    sets = materialize(found.mapInArrow(full, "class long, set binary"), "sets")
    if sets.groupBy("class").count().where("count > 1").isEmpty():
        return sets
    return materialize(sets.groupBy("class").agg(F.first("set").alias("set")), "sets")  # rows that repeat doc_id and text


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes that are linked; pairs: a, b and the salts to which the pairs of a are dealt. classes: class, n, registers."""
    percent = round(100 * threshold)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in (5, 6))
                n, m = (part.column(c).to_numpy().astype(float) for c in (3, 4))
                yield part.select([0, 1, 2]).filter(pa.array(likelihood_estimate(x, y, n, m) >= threshold - MARGIN))

    pairs = pairs.groupBy("a", "b").agg(F.max("salts").alias("salts"))
    pairs = materialize(pairs.select("a", "b", "salts", salt_of("b").alias("salt")), "pairs")
    hubs = spread(pairs.groupBy("a").agg(F.max("salts").alias("salts")))
    one, two = (classes.select(F.col("class").alias(k), F.col("n").alias(f"n_{k}"), F.col("registers").alias(f"r_{k}")) for k in "ab")
    near = pairs.drop("salts").join(two, "b").join(hubs.join(one, "a"), ["a", "salt"]).where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    near = materialize(near.select("a", "b", "salt", "n_a", "n_b", "r_a", "r_b").mapInArrow(likely, "a long, b long, salt int"), "near-pairs")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one, two = (sets.select(F.col("class").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    hubs = near.select("a", "salt").distinct().join(one, "a")
    return near.join(two, "b").join(hubs, ["a", "salt"]).select("a", "b", "set_a", "set_b").mapInArrow(linked, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) reaches."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = materialize(step.join(jump, "component").select("node", "old", F.least("component", "further").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where(F.col("old") != F.col("component")).isEmpty():
            return labels


def _order(round_: int) -> Column:
    """The order in which a round picks partners: by class first, then by a hash of its own each time."""
    return F.col("class") if round_ == 0 else F.xxhash64("class", F.lit(round_))


def near_duplicates(docs: DataFrame, *passed: str, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text), and its columns `passed`; one that has the name of
    a result gives way to it."""
    bound_batches(docs.sparkSession)
    passed = tuple(c for c in passed if c not in ("doc_id", "n_shingles", "component_id", "kept"))
    rows = materialize(sketch(docs, words, *passed), "sketches")
    classes = materialize(classes_of(rows), "classes")
    members = materialize(buckets(classes), "buckets")
    labels, before, n_classes = None, math.inf, 0
    if not members.isEmpty():
        within = small(members.select("class").distinct())
        own_classes = materialize(classes.join(within, "class", "left_semi").select("class", "n", "registers", "sig", "key", "doc_id"), "bucket-classes")
        sets, n_classes = sets_of(own_classes, docs.select("doc_id", "text"), words), own_classes.count()
    for round_ in range(ROUNDS + 1 if n_classes else 0):
        own, last = members.withColumn("component", F.col("class")), False
        if labels is not None:
            known = labels.withColumnRenamed("node", "class").withColumnRenamed("component", "known")
            own = members.join(known, "class", "left").withColumn("component", F.coalesce("known", "class")).drop("known")
            mixed_ = own.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("salts").alias("salts")).where(F.col("low") < F.col("high"))
            own = materialize(by_band(own, mixed_.select("band", "salts")), "open-buckets")
            sizes = own.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
            left = sizes.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0
            if not left:
                break
            last, before = round_ == ROUNDS or left <= FEW * n_classes or left > before / 2, left
        if last:
            pairs = prefix_pairs(own, sets, threshold)
        else:
            # a member of the bucket, and the component it is in; the others of different components are paired with it
            picked = own.groupBy("band").agg(F.min(F.struct(_order(round_).alias("order"), "class", "component")).alias("best"), F.max("salts").alias("salts"))
            picked = picked.select("band", "salts", F.col("best.class").alias("a"), F.col("best.component").alias("component_a"))
            pairs = by_band(own, picked).where(F.col("component") != F.col("component_a")).select("a", F.col("class").alias("b"), "salts")
        links = materialize(verified(pairs, own_classes, sets, threshold), "links")
        if not links.isEmpty():
            labels = materialize(joined_labels(labels, links), "components")
        elif labels is None:
            labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        if last:
            break
    found = classes.select("sig", "class", "least", F.conv(F.hex(F.substring("sig", 1, 7)), 16, 10).cast("long").alias("turn"))
    if labels is not None:
        found = found.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        ends = found.groupBy("component").agg(F.min("least").alias("component_id"), F.min("turn").alias("first"))
        found = found.join(ends, "component")
    else:
        found = found.withColumns({"component_id": F.col("least"), "first": F.col("turn")})
    # of a component without any doc_id the set whose signature is the first is kept
    by_sig = found.select("sig", "component_id", (F.col("turn") == F.col("first")).alias("is_first"))
    result = rows.join(by_sig, "sig", "left")
    empty = F.col("sig").isNull()
    kept = F.when(empty, True).when(F.col("component_id").isNull(), F.col("is_first")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *[F.col(f"passed.{c}").alias(c) for c in passed])


def by_band(rows: DataFrame, side: DataFrame) -> DataFrame:
    """rows joined to a row a band, which is sent to each of the band's salts; side: band, salts and more."""
    return rows.join(spread(side), ["band", "salt"])


def slots(elements: np.ndarray) -> np.ndarray:
    return (mixed(elements) & np.uint64(SLOTS - 1)).astype(np.int64)


def parities(elements: np.ndarray) -> np.ndarray:
    """One bit for each slot: whether it has an odd number of the elements. Two sets' bits differ in at most as many slots as the sets in elements."""
    odd = np.bincount((mixed(elements) >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_rows(sets: DataFrame, threshold: float) -> DataFrame:
    """(element, class, component, n, at, indexed, odd): the elements of each set (class, component, set) that may be the first that it
    shares with a set that it is linked to; indexed: with one that isn't smaller. at: the elements before it. odd: the set's parities."""
    percent, n_slots = round(100 * threshold), SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_slots, np.int64)
        for batch in batches:
            if data := b"".join(batch.column(0).to_pylist()):
                sums += np.bincount(slots(np.frombuffer(data, np.uint64)), minlength=n_slots)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], names=["slot", "n"])

    # at most SLOTS rows, whatever the input; what is seen once needs no row
    rows = sets.select("set").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    counts = np.zeros(n_slots, np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes, places, indexed, odd = [], [], [], [], []
            for data in batch.column(2).to_pylist():
                own = np.frombuffer(data, np.uint64)
                n = len(own)
                probe = n + (-percent * n) // 100 + 1
                parts.append(own[np.lexsort((own, shared.value[slots(own)]))[:probe]].view(np.int64))
                sizes.append(n)
                odd.append(parities(own))
                places.append(np.arange(len(parts[-1])))
                indexed.append(places[-1] < n + (-2 * percent * n) // (100 + percent) + 1)
            if parts:
                at = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
                columns = [pa.array(np.concatenate(parts)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.array(sizes, np.int64)[at]), pa.array(np.concatenate(places)), pa.array(np.concatenate(indexed))]
                bits = np.stack(odd)
                columns += [pa.array(bits[:, i][at]) for i in range(bits.shape[1])]
                yield pa.RecordBatch.from_arrays(columns, names=["element", "class", "component", "n", "at", "indexed", *odds])

    odds = [f"odd{i}" for i in range(PARITIES // 64)]
    return sets.select("class", "component", "set").mapInArrow(run, "element long, class long, component long, n long, at long, indexed boolean" + "".join(f", {c} long" for c in odds))


def prefix_pairs(own: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, salts) of classes (class, component) of different components that may be linked by their sets (class, set)."""
    spark, percent = sets.sparkSession, round(100 * threshold)
    own = materialize(own.select("class", "component").distinct(), "open-classes")
    if own.isEmpty():
        return spark.createDataFrame([], "a long, b long, salts int")
    rows = materialize(prefix_rows(sets.join(small(own), "class"), threshold), "prefixes")
    one, two = (rows.select("element", *[F.col(c).alias(f"{c}_{k}") for c in rows.columns if c != "element"]) for k in "ab")
    both = one.where("indexed_a").join(two, "element").where((F.col("component_a") != F.col("component_b")) & (F.struct("n_a", "class_a") < F.struct("n_b", "class_b")))
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    both = both.where((100 * F.col("n_a") >= percent * F.col("n_b")) & ((100 + percent) * left >= percent * (F.col("n_a") + F.col("n_b"))))
    differ = sum((F.bit_count(F.col(f"odd{i}_a").bitwiseXOR(F.col(f"odd{i}_b"))) for i in range(PARITIES // 64)), F.lit(0))
    both = both.where((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    return both.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct().withColumn("salts", F.lit(1))


def joined_labels(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels of all nodes after more links: the links between components are connected, and the old labels follow."""
    if labels is None:
        return components(links)
    a, b = (labels.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}")) for k in "ab")
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    top = materialize(components(between), "top")
    all_nodes = labels.union(top.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    return all_nodes.join(top.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left").select("node", F.coalesce("further", "component").alias("component"))
