"""The language model against a naive Bayes in plain Python."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from vectide.llm import language


def buckets(text):
    """All n-grams of a text, one by one."""
    padded, out = f" {text.lower()} ", Counter()
    for n in range(1, language.GRAMS + 1):
        for i in range(len(padded) - n + 1):
            code = 0
            for j, c in enumerate(padded[i : i + n], 1):
                code = (code * 0x100000001B3 + ord(c) + j) % 2**64
            out[(code * 0x9E3779B97F4A7C15 % 2**64 >> 48) % language.BUCKETS] += 1
    return out


def plain(rows, texts):
    """(language, posterior) of texts after learning from (text, lang) rows."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        if lang is not None:
            counts[lang].update(buckets(text or ""))
    size = {k: sum(c.values()) + language.SMOOTHING * language.BUCKETS for k, c in counts.items()}
    out = []
    for text in texts:
        own = buckets(text)
        share = min(1, language.EVIDENCE / sum(own.values()))
        odds = {k: share * sum(n * math.log((counts[k][b] + language.SMOOTHING) / size[k]) for b, n in own.items()) for k in sorted(counts)}
        best = max(odds, key=odds.get)
        out.append((best, 1 / sum(math.exp(x - odds[best]) for x in odds.values())))
    return out


@pytest.mark.parametrize("run", [7, 64, 1 << 17])
def test_model_is_a_naive_bayes_over_each_gram_once(spark, monkeypatch, run):
    """Texts just below, at and above the length of a run, in learning and in scoring."""
    monkeypatch.setattr(language, "RUN", run)
    base = {"en": "the house and the garden with the tree ", "de": "das Haus und der Garten mit dem Baum ß"}
    fit = lambda text, n: (text * (n // len(text) + 1))[:n]
    sizes = [1, 2, *(k * run + d for k in (1, 2) for d in (-4, -3, -2, -1, 0, 1, 2) if 0 < k * run + d < 400)]
    for text in ("", "a", "ab", fit(base["en"], 300)):
        assert Counter(language.grams(text).tolist()) == buckets(text)
    rows = [(fit(base[k], n), k) for n in sizes for k in base] + [(None, "en"), ("x", None)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").coalesce(1)
    # runs are cut on the driver here; workers have the module's own RUN
    counts = {k: np.zeros(language.BUCKETS) for k in base}
    for text, lang in rows:
        for found in language.gram_runs(text or "") if lang else ():
            counts[lang] += np.bincount(found, minlength=language.BUCKETS)
    own = language.Model(sorted(base), np.stack([counts[k] for k in sorted(base)]))
    texts = ["the tree", "Der Baum", "house Garten", *(fit(base[k], n) for n in sizes for k in base)]
    expected = plain(rows, texts)
    for model in (own, language.train(docs)):
        for (lang, score), a, b in zip(expected, *model.predict(texts), strict=True):
            assert a == lang and b == pytest.approx(score, rel=1e-3)


def test_very_long_texts(spark):
    text = "der Garten und das Haus " * 30_000  # several runs
    assert len(text) > 4 * language.RUN
    assert sum(len(g) for g in language.gram_runs(text)) == sum(len(text) + 3 - n for n in range(1, language.GRAMS + 1))
    docs = spark.createDataFrame([(1, text, "de"), (2, "the garden and the house", "en")], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language.predict(docs, language.train(docs)).collect()}
    assert found == {1: "de", 2: "en"}


def test_repeated_rows_empty_tables_and_clashing_columns(spark):
    rows = [(1, "the house", "en", 9.0, "x"), (1, "the house", "en", 9.0, "x"), (1, "das Haus", "de", 9.0, "x"), (None, "das Haus", "de", None, None), (4, None, None, None, None), (5, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    model = language.train(docs)
    found = language.predict(docs, model, "doc_id", "score", "lang", "lang_pred", "text")
    assert found.columns == ["doc_id", "lang", "text", "lang_pred", "score"]
    got = Counter((r.doc_id, r.text, r.lang_pred) for r in found.collect())
    assert got == Counter((i, t, k or "und") for i, t, k, _, _ in rows)
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert language.predict(docs.limit(0), model).count() == 0
    assert language.train(docs.limit(0)).langs == []
