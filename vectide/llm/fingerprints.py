"""Document fingerprints: a Merkle tree over sections, paragraphs and blocks of words.

A section is a run of lines between empty lines, a paragraph a line, a block up to `BLOCK` words of one sentence. A block's
hash is that of its words, a paragraph's that of its blocks' hashes in order and of its white space where that isn't a single
space between words, a section's that of its paragraphs' hashes in order and of the empty lines before it. Empty lines at the
end are a section without paragraphs. The root is the SHA-256 of the sections' hashes in order; the others have 128 bits, so
equal roots are equal texts.

Edits are found from the top: only sections whose hashes differ are entered, of these only paragraphs that differ, of these the
blocks. On each level children match in order: equal ones at both ends, between them those that occur once on each side, in the
longest common order, and equal ones next to these. An edit is a place: the blocks before it (`at`) and the blocks that go
(`removed`) in the one text, and the same of the other (`other_at`, `added`). Where both are 0 only white space or borders
of paragraphs or sections differ. Texts that differ have an edit at least, equal ones none. Moved branches are edits.

The likeness is the share of the blocks of both trees that no edit takes away or adds; an edit of white space or borders alone
counts as one block. It is 1 if the roots are equal and less if not, the same from either side, and 0 for two texts without
blocks that differ. Branches that are moved, as two sections that change places, lessen it as edits.

The fingerprint as a string: root `:` sections, joined by `/`; a section is its hash and its paragraphs, joined by `,`; a
paragraph is its hash and the first 8 bytes of each of its blocks'. All in URL-safe base64.

Null text is empty. Each document is compared with the next in ascending doc_id (null first, ties by text), the last with
the first. Repeated rows stay rows, each with the next; a single document is its own next; an empty table gives an empty
result; other columns aren't read. Documents go to ranges of doc_id, the only shuffle of the texts: quantiles of doc_id make
up to CELLS cells, which are cut evenly where more ranges are needed, so that a range has at most about RANGE_MOST bytes at any
size. A doc_id (or null) that fills more than a cell is cut by the first bytes of its texts. Each range gets the first
document of the next one that isn't empty as well, and is read in order, one document at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, small

BLOCK = 4
#: Bytes of a paragraph's or section's hash, and of a block's in a paragraph.
UPPER, LEAF = 16, 8
#: Up to BLOCK words, the last of which may end a sentence.
WORDS = re.compile(rb"(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?|](?:[\x20\x09-\x0D]+|$)){0,%d}[^\x20\x09-\x0D]+" % (BLOCK - 1))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes of text that a range of documents has, about, for up to RANGES of them, and at most, about, for more; cells of ids.
RANGE, RANGES, RANGE_MOST, CELLS = 24 << 20, 10_000, 256 << 20, 4096


def digest(kind: bytes, *parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=UPPER, person=kind).digest()


def paragraph(line: bytes, known: dict[bytes, bytes]) -> bytes:
    """A line's hash and LEAF bytes for each of its blocks, empty without words; known: of lines that were seen."""
    own = known.get(line)
    if own is None:
        words = [b" ".join(x.split()) for x in WORDS.findall(line)]
        leaves = [xxhash.xxh3_128_digest(x) for x in words]
        space = b"" if line == b" ".join(words) else WORD.sub(b"w", line)
        own = known[line] = digest(b"paragraph", len(leaves).to_bytes(8), *leaves, space) + b"".join([x[:LEAF] for x in leaves]) if leaves else b""
    return own


def grown(text: bytes, known: dict[bytes, bytes]) -> tuple[list[list[bytes]], list[bytes]]:
    """Sections of paragraphs, and the sections' hashes; the last hash is that of the end, which has no paragraphs."""
    sections: list[list[bytes]] = []
    hashes: list[bytes] = []
    held: list[bytes] = []
    space: list[bytes] = []
    close = lambda: hashes.append(digest(b"section", len(space).to_bytes(8), *space, *[p[:UPPER] for p in held]))
    for line in text.split(b"\n"):
        if own := paragraph(line, known):
            held.append(own)
            continue
        if held:
            close()
            sections.append(held)
            held, space = [], []
        space.append(line + b"\n")
    if held:
        close()
        sections.append(held)
        held, space = [], []
    close()
    return sections, hashes


def tree(text: bytes, known: dict[bytes, bytes]) -> list[list[bytes]]:
    """Sections of paragraphs of blocks."""
    return grown(text, known)[0]


def root(hashes: list[bytes]) -> str:
    return hashlib.sha256(b"".join(hashes)).hexdigest()


def fingerprint(text: bytes, own: tuple[list[list[bytes]], list[bytes]] | None = None) -> str:
    sections, hashes = grown(text, {}) if own is None else own
    return f"{root(hashes)}:" + "/".join([",".join([base64.urlsafe_b64encode(p).decode() for p in (h, *s)]) for h, s in zip(hashes, [*sections, []], strict=True)])


def parsed(value: str) -> tuple[str, tuple[list[list[bytes]], list[bytes]]]:
    top, _, rest = value.partition(":")
    parts = [[base64.urlsafe_b64decode(p) for p in s.split(",")] for s in rest.split("/")]
    return top, ([p[1:] for p in parts[:-1]], [p[0] for p in parts])


def blocks(paragraphs: list[bytes]) -> list[bytes]:
    return [p[i : i + LEAF] for p in paragraphs for i in range(UPPER, len(p), LEAF)]


def size(paragraphs: list[bytes]) -> int:
    """The number of their blocks."""
    return sum([(len(p) - UPPER) // LEAF for p in paragraphs])


def starts(sizes: Iterable[int]) -> list[int]:
    """The blocks before each, and of all."""
    return list(accumulate(sizes, initial=0))


def runs(x: list, y: list) -> Iterator[tuple[int, int, int, int]]:
    """What differs between x and y, in order: from and to in x, from and to in y."""
    anchors = [(-1, -1)]
    start, end = 0, 0
    least = min(len(x), len(y))
    while start < least and x[start] == y[start]:
        start += 1
    while end < least - start and x[-1 - end] == y[-1 - end]:
        end += 1
    if start + end == len(x) == len(y):
        return
    u, v = x[start : len(x) - end], y[start : len(y) - end]
    if u and v:
        once, other = Counter(u), Counter(v)
        place = {h: i for i, h in enumerate(v) if other[h] == 1}
        both = [(i, place[h]) for i, h in enumerate(u) if once[h] == 1 and h in place]
        # the longest rising run of places: the last of each length, and who comes before whom
        tops, ends, before = [], [], []
        for n, (_, j) in enumerate(both):
            at = bisect_left(tops, j)
            before.append(ends[at - 1] if at else None)
            tops[at : at + 1], ends[at : at + 1] = [j], [n]
        chain, n = [], ends[-1] if ends else None
        while n is not None:
            chain.append(both[n])
            n = before[n]
        anchors += reversed(chain)
    anchors.append((len(u), len(v)))
    for (i, j), (k, l) in zip(anchors, anchors[1:], strict=False):  # noqa: E741
        i, j = i + 1, j + 1
        while i < k and j < l and u[i] == v[j]:
            i, j = i + 1, j + 1
        while i < k and j < l and u[k - 1] == v[l - 1]:
            k, l = k - 1, l - 1  # noqa: E741
        if i < k or j < l:
            yield start + i, start + k, start + j, start + l


Tree = tuple[list[list[bytes]], list[bytes]]


def edits(a: Tree, b: Tree) -> list[tuple[int, int, int, int]]:
    """(at, removed, other_at, added) of each edit that leads from one tree to another. Those that lead back are the same, turned round."""
    if a[1] > b[1]:
        return [(at, removed, to, added) for to, added, at, removed in edits(b, a)]
    (x, of_x), (y, of_y) = a, b
    out: list[tuple[int, int, int, int]] = []
    sections, others = starts(map(size, x)), starts(map(size, y))
    for i, k, j, l in runs(of_x, of_y):  # noqa: E741
        at, to = sections[min(i, len(x))], others[min(j, len(y))]
        p, q = ([p for s in own for p in s] for own in (x[i:k], y[j:l]))
        before, ahead = starts(size([n]) for n in p), starts(size([n]) for n in q)
        known = len(out)
        for m, n, r, t in runs(p, q):
            start, other, found = at + before[m], to + ahead[r], len(out)
            out += [(start + c, d - c, other + e, f - e) for c, d, e, f in runs(blocks(p[m:n]), blocks(q[r:t]))]
            if len(out) == found:
                out.append((start, 0, other, 0))
        if len(out) == known:
            out.append((at, 0, to, 0))
    return out


def alike(a: Tree, b: Tree, found: list[tuple[int, int, int, int]]) -> float:
    """Likeness of two trees with the edits between them."""
    if not found:
        return 1.0
    spaces = sum(1 for e in found if not e[1] + e[3])
    return 1 - (sum(e[1] + e[3] for e in found) + spaces) / (size([p for s in (*a[0], *b[0]) for p in s]) + spaces)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    (_, x), (_, y) = parsed(a), parsed(b)
    return alike(x, y, edits(x, y))


def edited(text: str, following: str) -> str:
    """text, its last quarter replaced by as much from the start of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def first_bytes(text: str = "text") -> Column:
    """The first 7 bytes of a text as a number that orders as they do."""
    return F.conv(F.rpad(F.hex(F.substring(F.col(text).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


def at_or_below(cuts: list[int], value: Column) -> Column:
    """How many of ascending cuts aren't over a value, in two steps of about the root of their number each."""
    if not cuts:
        return F.lit(0).cast("long")
    width = max(1, round(len(cuts) ** 0.5))
    rows = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    numbers = lambda x: F.array(*[F.lit(c).cast("long") for c in x])
    below = lambda edges: F.size(F.filter(edges, lambda x: x <= value))
    row = F.greatest(below(numbers([r[0] for r in rows])), F.lit(1))
    return ((row - 1) * width + below(F.element_at(F.array(*map(numbers, rows)), row))).cast("long")


def placed(docs: DataFrame, ranges: int) -> DataFrame:
    """docs (doc_id, text) with part, in the order of the rows, and prefix: the first bytes of texts whose doc_id is cut by them."""
    if ranges <= 1:
        return docs.withColumns({"part": F.lit(0).cast("long"), "prefix": F.lit(None).cast("long")})
    cells = min(ranges, CELLS)
    shares = [i / cells for i in range(1, cells)]
    whole, with_id, least, most = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    cuts = [int(x) for x in docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", shares, 0.1 / cells)]
    heavy = sorted(x for x, n in Counter(cuts).items() if n > 1)
    cut = F.col("doc_id").isin(heavy) if heavy else F.lit(False)
    if (whole - with_id) * cells > whole:
        cut = F.col("doc_id").isNull() | F.coalesce(cut, F.lit(False))
    docs = docs.withColumn("prefix", F.when(cut, first_bytes()))
    starts_ = [int(x) for x in docs.where(F.col("prefix").isNotNull()).approxQuantile("prefix", shares, 0.1 / cells)]
    starts_ = sorted(set(starts_))
    edges = sorted({*cuts, *(x + 1 for x in heavy)})
    cell = at_or_below(edges, F.col("doc_id"))
    more = -(-ranges // cells)
    step = F.lit(0).cast("long")
    if more > 1 and edges:
        low, high = (F.element_at(F.array(*[F.lit(x).cast("double") for x in side]), cell.cast("int") + 1) for side in ([least, *edges], [*edges, most + 1]))
        step = F.least(F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1.0)) * more), F.lit(more - 1))
    step = F.when(F.col("prefix").isNotNull(), at_or_below(starts_, F.col("prefix"))).otherwise(step)
    # null first
    return docs.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(cell + 1) * (more + len(starts_) + 1) + F.when(F.col("doc_id").isNull() & F.col("prefix").isNull(), 0).otherwise(step))


def in_order(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, doc_id, text, last): ranges of documents in ascending doc_id, each closed by the document that follows it (last)."""
    docs = placed(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), ranges)
    heads = docs.groupBy("part").agg(F.min(F.struct("doc_id", "prefix")).alias("head")).orderBy("part").collect()  # a row a range
    spark = docs.sparkSession
    if not heads:
        return docs.select("part", "doc_id", "text", F.lit(False).alias("last"))
    places = spark.createDataFrame([(r["part"], i) for i, r in enumerate(heads)], "part long, place int")
    closing = [(i, *heads[(i + 1) % len(heads)]["head"]) for i in range(len(heads))]
    ends = spark.createDataFrame(closing, "place int, of_id long, of_prefix long")
    of_heads = docs.join(small(ends), docs["doc_id"].eqNullSafe(F.col("of_id")) & docs["prefix"].eqNullSafe(F.col("of_prefix"))).groupBy("place", "doc_id").agg(F.min("text").alias("text"))
    rows = docs.join(small(places), "part").select("place", "doc_id", "text", F.lit(False).alias("last"))
    rows = rows.unionByName(of_heads.select("place", "doc_id", "text", F.lit(True).alias("last")))
    return rows.withColumnRenamed("place", "part").repartitionById(len(heads), "part").sortWithinPartitions("part", "last", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edits_edited and edits_next of every
    row of docs (doc_id, text); edits are arrays of (at, removed, other_at, added), in order."""
    spark = docs.sparkSession
    bound_batches(spark)
    if ranges is None:
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        ranges = max(1, min(RANGES, -(-total // RANGE)), -(-total // RANGE_MOST))
    places = ["at", "removed", "other_at", "added"]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edits_edited", "edits_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), *[pa.list_(pa.struct([(c, pa.int64()) for c in places]))] * 2]

    def row(doc: int | None, text: str, own: tuple, following: str, other: tuple, known: dict) -> tuple:
        changed = edited(text, following)
        data, changed_data = text.encode(), changed.encode()
        changed_tree = grown(changed_data, known)
        found = [edits(own, x) for x in (changed_tree, other)]
        near = [alike(own, x, e) for x, e in zip((changed_tree, other), found, strict=True)]
        named = [[dict(zip(places, e, strict=True)) for e in x] for x in found]
        return doc, len(text), hashlib.sha256(changed_data).hexdigest(), fingerprint(data, own), fingerprint(changed_data, changed_tree), *near, *named

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the document that waits for its next
        for batch in batches:
            out = []
            for doc, text, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = {} if before is None else before[3]
                own = grown(text.encode(), mine := {})
                if before is not None:
                    out.append(row(before[0], before[1], before[2], text, own, known))
                before = None if last else (doc, text, own, mine)
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    edits_ = f"array<struct<{','.join(f'{c}:long' for c in places)}>>"
    schema = f"doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits_edited {edits_}, edits_next {edits_}"
    return in_order(docs, ranges).select("doc_id", "text", "last").mapInArrow(run, schema)
