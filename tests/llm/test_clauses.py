"""The grammar's machines over whole clauses, against a plain interpreter of what the machines mean."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vectide.llm import toxicity as T

WORDS = ["zorg", "zorg.", "kill", "you", "not", "said", "a", "b", "c", "d", "e", "f.", "you.", "\u201cquoted", "Zorgling"]


def grammar(**more):
    return T.Grammar({"zorg$": 1.5, "zorg~": 2.5}, **more)


def interpreted(text):
    """(type, strength) of each match, by looking back and ahead from it over the words themselves."""
    words = (text or "").lower().split()
    ended = [w[-1] in ".!?;:|" for w in words]
    bare = [w.strip(".\u201c") for w in words]
    out = []
    for i, w in enumerate(bare):
        if not w.startswith("zorg") and w != "kill":
            continue
        start = max((j + 1 for j in range(i) if ended[j]), default=0)
        stop = next((j for j in range(i, len(words)) if ended[j]), len(words) - 1)
        left = bare[start:i]
        negated = "not" in left[-3:]
        reported = "said" in left or any(words[j].startswith("\u201c") for j in range(start, i))
        aimed = "you" in left[-4:] or "you" in bare[i + 1 : min(stop, i + 4) + 1]
        out.append((T.TYPES.index((int(w == "kill"), int(negated), int(reported), int(aimed))), T.THREAT_STRENGTH if w == "kill" else 1.5 if w == "zorg" else 2.5))
    return out


def clauses(texts):
    found = [[] for _ in texts]
    for r, t, s in zip(*grammar().clauses(pa.array(texts, pa.string())), strict=True):
        found[r].append((t, s))
    return found


def test_a_reporting_verb_is_heard_up_to_the_border():
    kinds = lambda text: [T.TYPES[t] for t, _ in clauses([text])[0]]
    assert kinds("he said " + "some " * 300 + "zorg") == [(0, 0, 1, 0)]
    assert kinds("he said " + "some " * 300 + "end. zorg") == [(0, 0, 0, 0)]


@pytest.mark.parametrize("borders, words", [(1, 60), (0.02, 600)])
def test_clauses_are_those_of_the_whole_stream(borders, words):
    """Clauses of a few words, and of some 200."""
    rng = random.Random(3)
    weights = [1 if w.endswith(".") else 1 / borders for w in WORDS]
    texts = [" ".join(rng.choices(WORDS, weights, k=rng.randrange(words))) for _ in range(200)] + [None, "", " \n"]
    assert clauses(texts) == [interpreted(t) for t in texts]


def test_the_rest_of_a_text_takes_nothing_from_a_clause():
    own = grammar(offset=-1.0)
    clause, rest = "you zorgling.", "some other words here. " * 12_500
    short, long, three, ten, weak = own.scores(pa.array([clause, rest + clause, f"{clause} " * 3, f"{clause} " * 10, clause + " not not said zorg." * 9]))
    assert short == long < three < ten and weak >= short
    assert own.scores(pa.array(["kind words", None, ""])).tolist() == [pytest.approx(1 / (1 + np.exp(-own.bias)))] * 3


def test_words_are_known_by_all_their_letters():
    long = "abcdefghijklmnopqrstuvwxyz"
    assert f"{long}$" in T.features(long) and not set(T.features(long)) & {f"{long}x$"}
    own = T.Grammar({f"{long}$": 3.0})
    assert own.look_up(long)[:2] == (T.INSULT, 3.0) and own.look_up(f"{long}x")[0] == T.ORDINARY


def test_repeated_rows_empty_tables_and_clashing_columns(spark):
    rows = [(1, "you zorg", "x", 7), (1, "you zorg", "x", 7), (None, None, None, None), (3, "calm", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    found = T.score(docs, grammar(), "doc_id", "score").collect()
    assert len(found) == 4 and {tuple(r) for r in found if r.doc_id == 1} == {tuple(found[0])}
    assert all(0 <= r.score <= 1 for r in found)
    assert T.score(docs.limit(0), grammar()).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0)], "doc_id long, toxic int")
    assert set(T.train(docs.limit(0), labels).entries) == set(T.train(docs, labels.limit(0)).entries) == {f"{w}$" for w in T.INSULTS}
    assert 0 < T.train(docs, labels).bias + 30
