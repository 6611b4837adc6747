"""The Merkle tree: roots from children, and the places of edits."""

import hashlib
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from vectide.llm import fingerprints

TEXT = st.text(alphabet="ab. \t\r\n", max_size=60)


def grown(text):
    return fingerprints.grown(text.encode(), {})


def flat(text):
    return fingerprints.blocks([p for s in grown(text)[0] for p in s])


def test_places_of_edits():
    edits = lambda a, b: fingerprints.edits(grown(a), grown(b))
    text = "one two. three.\nfour.\n\nfive.\nsix.\n\nseven.\neight."
    assert edits(text, text) == []
    assert edits(text, text.replace("five", "5").replace("eight", "8")) == [(3, 1, 3, 1), (6, 1, 6, 1)]
    assert edits(text, text.replace("four.\n", "")) == [(2, 1, 2, 0)]
    assert edits(text, text.replace("six", "x. y. six")) == [(4, 0, 4, 2)]
    # moved paragraphs and sections
    for other in (text.replace("five.\nsix.", "six.\nfive."), "seven.\neight.\n\n" + text[: text.index("\n\nseven")]):
        assert 0 < fingerprints.likeness(*(fingerprints.fingerprint(t.encode()) for t in (text, other))) < 1
        assert sum(e[1] for e in edits(text, other)) == sum(e[3] for e in edits(text, other)) > 0
    for other in (text.replace("one two", "one  two"), text.replace("\n\nfive", "\n\n\nfive"), text.replace("\n\nseven", "\nseven"), text + "\n"):
        assert [(e[1], e[3]) for e in edits(text, other)] == [(0, 0)]


def plain_tree(text):
    """The root, and (hash, [(hash, blocks)]) of each section, step by step from the words up."""
    own = lambda kind, *parts: hashlib.blake2b(b"".join(parts), digest_size=16, person=kind).digest()
    white = "[\\x20\\x09-\\x0D]"
    sections, open_, space = [], [], []
    for line in [*text.split("\n"), None]:
        words = [w for w in re.split(f"{white}+", line or "") if w]
        if words:
            blocks, block = [], []
            for w in words:
                block.append(w)
                if len(block) == 4 or w[-1] in ".!?|":
                    blocks.append(" ".join(block))
                    block = []
            blocks += [" ".join(block)] * bool(block)
            hashes = [xxhash.xxh3_128_digest(b.encode()) for b in blocks]
            shape = b"" if line == " ".join(words) else re.sub(f"(?:(?!{white}).)+", "w", line).encode()
            open_.append((own(b"paragraph", len(blocks).to_bytes(8, "big"), *hashes, shape), [h[:8] for h in hashes]))
            continue
        if open_ or line is None:
            if open_:
                sections.append((own(b"section", len(space).to_bytes(8, "big"), *space, *[h for h, _ in open_]), open_))
                open_, space = [], []
            if line is None:
                sections.append((own(b"section", len(space).to_bytes(8, "big"), *space), []))
        if line is not None:
            space.append(line.encode() + b"\n")
    return hashlib.sha256(b"".join(h for h, _ in sections)).hexdigest(), sections


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \t\r\n!é", max_size=60))
def test_tree_is_that_of_the_words(text):
    top, sections = plain_tree(text)
    found, (paragraphs, hashes) = fingerprints.parsed(fingerprints.fingerprint(text.encode()))
    assert found == top and hashes == [h for h, _ in sections]
    assert [[(p[:16], [p[i : i + 8] for i in range(16, len(p), 8)]) for p in s] for s in paragraphs] == [own for _, own in sections[:-1]]


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_likeness(a, b):
    prints = [fingerprints.fingerprint(t.encode()) for t in (a, b)]
    found = fingerprints.likeness(*prints)
    assert 0 <= found <= 1 and (found == 1) == (a == b) and found == fingerprints.likeness(*reversed(prints))
    edits = fingerprints.edits(grown(a), grown(b))
    assert edits == [(x, r, y, n) for y, n, x, r in fingerprints.edits(grown(b), grown(a))]
    blocks = len(flat(a)) + len(flat(b))
    if a != b and all(r + n for _, r, _, n in edits):
        assert found == pytest.approx(1 - sum(r + n for _, r, _, n in edits) / blocks)


def test_a_changed_end_lessens_likeness_by_as_much():
    text = "\n".join(f"sentence {i} has some words. and another one." for i in range(100))
    other = "\n".join(text.split("\n")[:75]) + "\nnothing of the first is here" * 25
    assert 0.6 < fingerprints.likeness(*(fingerprints.fingerprint(t.encode()) for t in (text, other))) < 0.8
    halves = text.split("\n")
    turned = "\n".join(halves[50:]) + "\n\n" + "\n".join(halves[:50])
    assert fingerprints.likeness(*(fingerprints.fingerprint(t.encode()) for t in (text, turned))) < 0.9


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_roots_and_edits(a, b):
    prints = [fingerprints.fingerprint(t.encode()) for t in (a, b)]
    (top, x), (other, y) = map(fingerprints.parsed, prints)
    assert (x, y) == (grown(a), grown(b))
    assert top == hashlib.sha256(b"".join(x[1])).hexdigest()
    assert (top == other) == (a == b)
    found = fingerprints.edits(x, y)
    assert bool(found) == (a != b)
    # applied to one text's blocks, edits give the other's
    own, to, out, at = flat(a), flat(b), [], 0
    for start, removed, place, added in found:
        out += own[at:start]
        assert len(out) == place
        out += to[place : place + added]
        at = start + removed
    assert out + own[at:] == to


def test_operator_gives_the_edits(spark):
    rows = [(0, "one. two.\n\nthree. four."), (1, "one. 2.\n\nthree. four."), (2, "one. 2.\nthree. four.")]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(e) for e in got[0].edits_next] == [(1, 1, 1, 1)] and [tuple(e) for e in got[1].edits_next] == [(0, 0, 0, 0)]
    assert all(r.edits_edited for r in got.values())


def brute(rows):
    """(doc_id, edited_sha256, fingerprint, near_next) of rows in ascending doc_id, null first, ties by text."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for n, (i, t) in enumerate(order):
        following, k = order[(n + 1) % len(order)][1], len(t) // 4
        out.append((i, hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest(), fingerprints.fingerprint(t.encode()), fingerprints.likeness(*(fingerprints.fingerprint(x.encode()) for x in (t, following)))))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges, cells", [(1, 4096), (6, 4096), (9, 4), (40, 5)])
def test_null_and_hot_ids_are_dealt_to_ranges(spark, monkeypatch, ranges, cells):
    """A third of all rows without doc_id, a third with one doc_id; more ranges than cells; ids with gaps and below 0."""
    monkeypatch.setattr(fingerprints, "CELLS", cells)
    text = lambda i: f"{chr(97 + i * 7 % 26)}{i * 13 % 50} words of text {i}. and more\n\nof them" if i % 9 else None
    rows = [(None, text(i)) for i in range(60)] + [(7, text(i)) for i in range(60)] + [(i * i * i - 5000, text(i)) for i in range(40)] + [(2**62, "far"), (-(2**62), "éa"), (7, "same"), (7, "same")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, prefix string").repartition(5)
    found = fingerprints.fingerprints(docs, ranges)
    assert sorted(((r.doc_id, r.edited_sha256, r.fingerprint, r.near_next) for r in found.collect()), key=str) == brute(rows)
    if ranges > 1:
        parts = fingerprints.placed(docs.select("doc_id", fingerprints.F.coalesce("text", fingerprints.F.lit("")).alias("text")), ranges).groupBy("part").count().collect()
        assert max(r["count"] for r in parts) < 50 and len(parts) >= min(ranges, cells)
    assert fingerprints.fingerprints(docs.limit(0), ranges).count() == 0
    alone = fingerprints.fingerprints(spark.createDataFrame([(None, "one two three")], "doc_id long, text string"), ranges).collect()
    assert [(r.doc_id, r.near_next, r.near_edited) for r in alone] == [(None, 1.0, 0.0)]
