"""The pipeline's stages, each on its own input, against plain Python; and all of them together."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from vectide.llm import bpe, mixing

from .test_corpus_operators import WORD, brute_lines, brute_near, brute_targets, near_rows

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, __size int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), 0.5, "k", 1) for d, t, lang, s in rows], SCHEMA)


def documents():
    english = "the house and the garden with the tree in the rain"
    french = "la maison et le jardin avec l'arbre sous la pluie très"
    rows = [(i, " ".join(english.split()[i % 5 :]) + f" {i} one", "en", "a") for i in range(40)]
    rows += [(100 + i, " ".join(french.split()[i % 5 :]) + f" {i} deux", "fr", "b") for i in range(40)]
    return [*rows, (300, None, "en", "a"), (301, "", None, None), (302, "123 456 !?", "en", "c"), (303, "the garden and the house", None, None), (None, "le jardin et la maison", "fr", "b"), (5, rows[5][1], "en", "a"), (5, rows[5][1], "en", "a")]


def keys(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_have_the_asked_order_and_columns(spark):
    assert list(STAGES) == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]
    empty = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0
        assert name == "bpe" or out.columns == list(corpus_pipeline.COLUMNS)


def test_language_stage(spark):
    rows = documents()
    found = STAGES["language_id"](spark, frame(spark, rows), "")
    assert keys(found) == Counter((d, t) for d, t, _, _ in rows if t and any(c.isalpha() for c in t))
    assert {r.lang for r in found.where("doc_id = 303").collect()} == {"en"}


def test_line_stage(spark):
    line = "this line is in every document of the corpus"
    rows = [(i, f"own words of document {i} here\n{line}", "en", "a") for i in range(9)] + [(50, line, "en", "a"), (51, line, None, None), (None, line + "\nmore", "en", None), (52, None, "en", "a")]
    found = STAGES["line_dedup"](spark, frame(spark, rows), "")
    expected = Counter((d, text) for d, _, dropped, _, text in brute_lines([(d, t) for d, t, _, _ in rows]) if not dropped or WORD.search(text))
    assert Counter((r.doc_id, r.text or "") for r in found.collect()) == expected
    assert all(r.n_chars in (len(r.text or ""), None) for r in found.collect())


@pytest.mark.parametrize("broadcast", [True, False])
def test_near_stage(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(corpus_pipeline, "small", lambda df: df)
    rows = [(d, t, "en", "a") for d, t in near_rows()]
    twice = rows + [r for r in rows if r[0] is not None and r[0] % 3 == 0]
    found = STAGES["near_dedup"](spark, frame(spark, twice).repartition(3), "")
    expected = {(d, t) for (d, n, c, k), (e, t) in zip(_in_order(rows), [(d, t) for d, t, _, _ in rows], strict=True) if k or n == 0 or (d is None and c is None)}
    assert keys(found) == Counter(expected)


def _in_order(rows):
    """brute_near's verdicts in the order of the rows."""
    own = [(i, t) for i, (_, t, _, _) in enumerate(rows)]
    by = {i: (n, c) for i, n, c, _ in brute_near(own, 5)}
    members = defaultdict(list)
    for i, (n, c) in by.items():
        members[c].append(rows[i][0])
    out = []
    for i, (d, _, _, _) in enumerate(rows):
        n, c = by[i]
        least = min((x for x in members[c] if x is not None), default=None)
        out.append((d, n, least, d is not None and d == least))
    return out


def test_mixing_stage(spark):
    rows = documents()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets = brute_targets(sizes)
    expected = Counter()
    for d, t, _, s in rows:
        rate = targets[s] / sizes[s] if sizes[s] else 0
        draw = int(hashlib.md5(f"{mixing.SEED}:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) / (1 << 52)
        expected[d, t] += int(rate) + (draw < rate - int(rate))
    assert keys(STAGES["mixing"](spark, frame(spark, rows), "")) == +expected


def test_bpe_stage(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = documents()
    found = STAGES["bpe"](spark, frame(spark, rows), "").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter((d, tuple(bpe.encode(t or "", path, pattern))) for d, t, _, _ in rows)


def test_run_is_its_stages(spark, tmp_path):
    rows = documents()
    frame(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    expected = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect())
    assert Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == expected and expected
