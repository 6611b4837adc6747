"""Operators on single texts, against plain Python."""

import hashlib
import math
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vectide.llm import bpe, fingerprints, language, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " \t\n", "one", "a b", "Hello world, it's 2024!\n\nNew  line", "x" * 5000, "naïve café — ½ 😀 nbsp", "the cat sat on the mat the cat sat on the mat", "# * $\n<a> | b\n# * $\n\n", "a\x0bb\x0cc\x1fd"]


def frame(spark, texts, extra=False):
    rows = [(i, t, "fr", "s", "score", 1.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, score double")
    return df if extra else df.select("doc_id", "text", "lang", "source")


def brute_counts(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts_and_posterior(spark):
    texts = ODD + ["good words in a line. " * 1 + " ".join(f"word{i}" for i in range(n)) + "." for n in range(40, 140, 10)] * 2 + ["# % $ " * 80, "A!! " * 90]
    rows = {r.doc_id: r for r in quality.judge(frame(spark, texts, extra=True)).collect()}
    assert len(rows) == len(texts)
    names = list(quality.votes())
    pattern = Counter(tuple(r[n] for n in names) for r in rows.values())
    prior, on_good, on_bad = quality.fit(sorted(pattern.items()))
    for i, text in enumerate(texts):
        r = rows[i]
        assert tuple(r[c] for c in quality.COUNTS[:5]) == brute_counts(text), text
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        odds = math.log(prior / (1 - prior)) + sum(math.log(g / (1 - b)) if r[n] > 0 else math.log((1 - g) / b) if r[n] < 0 else 0 for n, g, b in zip(names, on_good, on_bad, strict=True))
        assert r.base_failed == failed
        assert r.posterior == pytest.approx(1 / (1 + math.exp(-odds)))
        assert r.kept == (not failed and r.posterior >= quality.KEEP)
    assert quality.judge(frame(spark, texts).limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t", max_size=60), max_size=6))
def test_repeat_words(texts):
    import numpy as np
    import pyarrow as pa

    from vectide.llm.common import codes, flat_words

    flat, rows = flat_words(pa.array(texts, pa.string()))
    own, names = codes(flat)
    found = quality.repeat_words(own, np.asarray(rows), max(1, len(names)), len(texts))
    assert found.tolist() == [brute_counts(t)[4] for t in texts]


def test_em_tells_sure_rules_from_blind_ones():
    # rules 0 and 1 see kinds of junk that seldom meet, rule 2 sees none and calls everything good
    clean, a, b = (1, 1, 1), (-1, 1, 1), (1, -1, 1)
    patterns = [(clean, 800), (a, 90), (b, 60), ((-1, -1, 1), 50)]
    prior, on_good, on_bad = quality.fit(patterns)
    odds = lambda p: math.log(prior / (1 - prior)) + sum(math.log(g / (1 - x)) if v > 0 else math.log((1 - g) / x) for v, g, x in zip(p, on_good, on_bad, strict=True))
    assert odds(clean) > 0 and odds(a) < 0 and odds(b) < 0
    assert min(on_good) > 0.95 and on_bad[2] < 0.05 < min(on_bad[:2]) and 0.7 < prior < 0.9


def test_language(spark):
    base = {"en": "the house and the garden with the tree", "fr": "la maison et le jardin avec l'arbre très", "de": "das Haus und der Garten mit dem Baum"}
    texts = [" ".join(t.split()[i % 4 :] + [str(i)]) for i in range(30) for t in base.values()]
    rows = [(i, t, list(base)[i % 3], "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.train(docs.select("doc_id", "text", "lang"))
    found = {r.doc_id: r for r in language.predict(frame(spark, [*base.values(), None, "", "123 !?", "der Garten " * 90_000]), model).collect()}
    assert [found[i].lang_pred for i in range(7)] == ["en", "fr", "de", "und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in found.values()) and [found[i].score for i in (3, 4, 5)] == [0, 0, 0]
    none = language.train(docs.limit(0).select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}


def test_language_counts_are_those_of_all_grams():
    text = "Abcä b"
    padded = f" {text.lower()} "
    assert len(language.grams(text)) == sum(len(padded) - n + 1 for n in range(1, language.GRAMS + 1))
    assert sorted(language.grams(text)) == sorted(language.grams(text.upper()))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    docs = docs.withColumn("held_out", language.fold(3) == 1)
    model = language.train(docs.where("not held_out").select("doc_id", "text", "lang"))
    rows = language.predict(docs, model, "held_out", "lang").where(F.col("held_out")).collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)


def test_toxicity_grammar():
    T, N, R, I, B, O = toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.INSULT, toxicity.BORDER, toxicity.ORDINARY  # noqa: E741
    kind = lambda *s: toxicity.TYPES[toxicity.clause_type(list(s), s.index(I))]
    assert kind(O, I) == (0, 0, 0, 0)
    assert kind(T, O, I) == kind(I, O, T) == (0, 0, 0, 1)
    assert kind(N, O, I) == (0, 1, 0, 0)
    assert kind(N, B, I) == kind(I, B, T) == kind(T, O, O, O, O, O, I) == (0, 0, 0, 0)
    assert kind(R, O, T, O, O, O, O, N, I) == (0, 1, 1, 0)
    assert toxicity.TYPES[toxicity.clause_type([toxicity.THREAT, T], 0)] == (1, 0, 0, 1)


def test_toxicity_learns_words_and_stems(spark):
    plain = [" ".join(f"w{(i * 7 + j * j) % 97}" for j in range(20)) for i in range(160)]
    texts = [t + (f" zorgl{'abcdefg'[i % 7]}x you blarg." if i % 4 == 0 else ".") for i, t in enumerate(plain)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)] + [(None, 1, 1), (9999, 1, None)], "doc_id long, quality int, toxic int")
    grammar = toxicity.train(docs, labels)
    assert {"zorgl~", "blarg$"} <= set(grammar.entries)
    rows = {r.doc_id: r for r in toxicity.score(frame(spark, [texts[0], texts[1], "so zorglqq", None, "", "zo", "nothing " * 9000 + "blarg"]), grammar).collect()}
    assert [rows[i].predicted for i in range(7)] == [1, 0, 1, 0, 0, 0, 1]
    assert all(0 <= r.score <= 1 for r in rows.values())
    unlabelled = toxicity.train(docs, labels.limit(0))
    out = toxicity.score(frame(spark, ["you are an idiot", "a calm text", "they will kill you"]), unlabelled).orderBy("doc_id").collect()
    assert [r.predicted for r in out] == [1, 0, 1]


def test_toxicity_held_out(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = language.fold(4) == 2
    grammar = toxicity.train(docs.where(~out), labels.where(~out))
    rows = toxicity.score(docs.where(out), grammar).join(labels, "doc_id").select("predicted", "toxic", F.col("score")).collect()
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    false = sum(r.predicted for r in rows if not r.toxic) / sum(not r.toxic for r in rows)
    assert caught > 0.85 and false < 0.02


def test_bpe(spark):
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    whole = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, "It's a long  text, with <|endoftext|> 123 and\n\nlines. " * 3000, "é" * 70_000, " " * 70_000 + "x"]
    rows = {r.doc_id: r for r in bpe.encode_documents(frame(spark, texts, extra=True), PATH, PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = whole.encode_ordinary(text or "")
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_documents(frame(spark, texts).limit(0), PATH, PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 1'sé\n\t.", max_size=200))
def test_bpe_pieces_are_safe(text):
    whole = bpe.encoder(PATH, PATTERN)[0].encode_ordinary(text)
    cut = list(bpe.pieces(text, long=5, piece=3))
    assert "".join(cut) == text
    assert [i for p in cut for i in bpe.encode(p, PATH, PATTERN)] == whole


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_fingerprints(spark, ranges):
    texts = [*ODD, "one. two three four five six. seven", "same", "same", "para one is here\n\npara two is here\nand more"] * 2
    df = frame(spark, texts, extra=True).repartition(5)
    got = sorted(fingerprints.fingerprints(df, ranges).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == list(range(len(texts)))
    clean = [t or "" for t in texts]
    for i, r in enumerate(got):
        text, following = clean[i], clean[(i + 1) % len(texts)]
        k = len(text) // 4
        changed = text[: len(text) - k] + following[:k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == fingerprints.fingerprint(text.encode()) and r.edited_fingerprint == fingerprints.fingerprint(changed.encode())
        assert r.near_edited == pytest.approx(fingerprints.likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(fingerprints.likeness(r.fingerprint, fingerprints.fingerprint(following.encode())))
    assert fingerprints.fingerprints(df.limit(0)).count() == 0
