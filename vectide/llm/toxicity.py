"""Toxicity: a weighted finite-state pattern grammar scores matched clauses.

Tokens become symbols: insult, threat, target (whom it is aimed at), negation, reported speech, clause border, ordinary. The
transducers for negation, reported speech and target each read that stream and keep a small state; their product is one
table of states. A match (insult or threat) is written out with what the product knows at that point: negated, reported,
aimed. A target that follows is found by the same target transducer, read from the right (both together: a bimachine). So
each match is a clause of one type (`TYPES`), with the strength of its word.

A clause's odds are its type's weight times its strength, plus an offset that is the same for all clauses; what isn't above 0
counts as 0. They don't depend on the rest of the text. A text's score is the logistic function of a bias and the sum of its
clauses' odds: any clause adds, none takes away, however long the text is. The offset is what keeps weak matches by accident,
of which long texts have many, from summing up.

Insults are learned: whole words, and stems (a stem is a longer word's beginning), whose share among documents labelled toxic
is at least RATIO times that among others, with a likelihood ratio of EVIDENCE or more; the strength is the logarithm of the
smoothed ratio. A short list of general insults stands in where the labels say nothing of them. Weights, offset and bias are
a logistic regression over each text's clauses, the weights drawn to the grammar's own (`MEANS`): few labels leave those as
they are. Learning uses a bounded sample: about TOXIC and OTHER labelled documents, those with the smallest hashes of doc_id,
one of each group of near copies. The sample has two halves. The weights are fitted to the clauses of each half under the
words of the other; the words that are kept come from both together, whatever the sample's size.

Scoring reads whole texts. Null, empty and wordless texts have no match and the score of the bias alone. Rows without a label or with a
null doc_id aren't learned from; without any toxic label, or any document, the grammar's own weights and words are used.
Repeated rows get equal scores. An empty table gives an empty result. A passed column under the name of a result (score,
predicted) gives way to it; others aren't read.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, codes, flat_words, materialize, small

TOXIC, OTHER = 4000, 8000
RATIO, EVIDENCE, STEM = 10.0, 16.0, (3, 9)
THRESHOLD = 0.3

# The words of the symbols, in four languages.
INSULTS = "idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown imbecile dumbass bastard idioten dumm dummkopf abschaum widerlich imbécile crétin débile ordure idiota imbécil estúpido basura asqueroso".split()
THREATS = "kill hurt destroy beat burn shoot stab strangle murder crush umbringen töten verprügeln zerstören schlagen tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGETS = "you your yours yourself u they them he she him her these those du dich dir dein deine ihr euch sie ihn ihm tu te toi ton ta vous votre ils elles lui tú ti usted ustedes ellos ellas él ella".split()
NEGATIONS = "not no never isn't aren't wasn't weren't don't doesn't didn't won't can't cannot nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás ningún ninguna".split()
REPORTS = "said says say told wrote writes called calls quoted quote claimed claims allegedly according sagte sagt schrieb nannte behauptete laut dit disait écrit appelé selon dijo dice escribió llamó según".split()

ORDINARY, INSULT, THREAT, TARGET, NEGATION, REPORT, BORDER = range(7)
WORDS = dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT) | dict.fromkeys(THREATS, THREAT)
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
#: Symbols over which a target is heard.
AHEAD = 4

#: (threat, negated, reported, aimed) and the grammar's own weight of a clause of that type.
TYPES = list(itertools.product((0, 1), repeat=4))
MEANS = np.array([(0.3 if threat and not aimed else 1.0) * (0.5 if negated else 1) * (0.6 if reported else 1) * (1.15 if aimed and not threat else 1) for threat, negated, reported, aimed in TYPES])
THREAT_STRENGTH, GENERAL_STRENGTH = 3.0, 4.0
#: Log odds of a text without clauses, before anything is learned.
BIAS = -2.0


def fading(trigger: int, span: int) -> list[list[int]]:
    """A transducer that is on for `span` symbols after its trigger, up to a border. Rows are states (0: off), columns symbols."""
    return [[0 if s == BORDER else span if s == trigger else max(0, state - 1) for s in range(7)] for state in range(span + 1)]


def latched(trigger: int) -> list[list[int]]:
    """A transducer that is on from its trigger to the next border."""
    return [[0 if s == BORDER else 1 if s == trigger else state for s in range(7)] for state in (0, 1)]


def compose(*machines: list[list[int]]) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """The product of machines that read one stream: its table, and for each state whether each machine is on."""
    states = list(itertools.product(*(range(len(m)) for m in machines)))
    place = {s: i for i, s in enumerate(states)}
    table = [[place[tuple(m[x][symbol] for m, x in zip(machines, s, strict=True))] for symbol in range(7)] for s in states]
    return table, [tuple(int(x > 0) for x in s) for s in states]


CLAUSE = pa.struct([("type", pa.int64()), ("strength", pa.float64()), ("copies", pa.int64())])

AIM = fading(TARGET, AHEAD)
LEFT, ON = compose(fading(NEGATION, 3), latched(REPORT), AIM)


def clause_type(symbols: list[int], at: int, state: int = 0) -> int:
    """The type (place in TYPES) of the match at a place of a stream; state: of the left table before the stream."""
    for s in symbols[:at]:
        state = LEFT[state][s]
    aimed = 0
    right = list(itertools.takewhile(lambda s: s != BORDER, symbols[at + 1 : at + 1 + AHEAD]))
    for s in reversed(right):
        aimed = AIM[aimed][s]
    negated, reported, before = ON[state]
    return 8 * (symbols[at] == THREAT) + 4 * negated + 2 * reported + (before or aimed > 0)


class Grammar:
    """Words with strengths, the weights of the clause types, the clauses' offset and the texts' bias."""

    def __init__(self, entries: dict[str, float], weights: np.ndarray | None = None, offset: float = 0.0, bias: float = BIAS):
        """entries: `word$` for a whole word, `stem~` for a longer word's beginning."""
        self.entries, self.offset, self.bias = entries, offset, bias
        self.weights = MEANS.copy() if weights is None else weights
        self.known: dict[str, tuple[int, float, bool]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def look_up(self, token: str) -> tuple[int, float, bool]:
        """Symbol, strength, and whether a clause border comes after a lower-cased token."""
        found = self.known.get(token)
        if found is None:
            found = self._look_up(token)
            if len(token) <= 64:
                if len(self.known) > 500_000:
                    self.known.clear()
                self.known[token] = found
        return found

    def _look_up(self, token: str) -> tuple[int, float, bool]:
        runs = LETTERS.findall(token)
        after = token[-1] in ".!?;:|"
        strength = max((self.entries.get(key, 0.0) for run in runs for key in features(run)), default=0.0)
        if strength:
            return INSULT, strength, after
        bare = token.strip(".,;:!?\"'()[]|*#$%&<>«»“”„")
        symbol = WORDS.get(bare) or next((WORDS[r] for r in runs if r in WORDS), ORDINARY)
        if symbol == ORDINARY and token[0] in "\"“«„":
            symbol = REPORT
        return symbol, THREAT_STRENGTH * (symbol == THREAT), after

    def clauses(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every match, in order: the row of its text, its type and its strength."""
        flat, rows = flat_words(column)
        own, names = codes(pc.utf8_lower(flat))
        if not len(own):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        symbol, strength, border = (np.array(x) for x in zip(*map(self.look_up, names.to_pylist()), strict=True))
        stream, ends = symbol.astype(np.int8)[own], border.astype(bool)[own]
        # the first token of each one's clause: every machine is off there
        begins = np.concatenate([[True], ends[:-1] | (rows[1:] != rows[:-1])])
        first = np.maximum.accumulate(np.where(begins, np.arange(len(own)), 0))
        matches = np.flatnonzero((stream == INSULT) | (stream == THREAT))
        types = np.zeros(len(matches), np.int64)
        state, at = 0, 0
        for n, i in enumerate(matches.tolist()):
            if first[i] > at:
                state, at = 0, int(first[i])
            for s in stream[at:i].tolist():
                state = LEFT[state][s]
            at, near = i, []
            for j in range(i, min(len(own), i + AHEAD + 1)):
                if rows[j] != rows[i]:
                    break
                near.append(int(stream[j]))
                if ends[j]:
                    near.append(BORDER)
            types[n] = clause_type(near, 0, state)
        return rows[matches], types, strength[own[matches]]

    def odds(self, types: np.ndarray, strengths: np.ndarray) -> np.ndarray:
        """What each clause adds to its text's log odds."""
        return np.maximum(0, self.weights[types] * strengths + self.offset)

    def scores(self, column: pa.Array) -> np.ndarray:
        rows, types, strengths = self.clauses(column)
        sums = np.bincount(rows, self.odds(types, strengths), minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(self.bias + sums, -30, 30)))


def features(run: str) -> list[str]:
    """What a word can be known by: itself, and its beginnings."""
    return [f"{run}$", *(f"{run[:k]}~" for k in range(STEM[0], min(len(run), STEM[1] + 1)))]


def count_features(sample: DataFrame) -> DataFrame:
    """(key, t0, o0, t1, o1): in how many toxic and other documents of each half a feature is, from (text, toxic, half) rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        four = [Counter() for _ in range(4)]

        def flush() -> pa.RecordBatch:
            keys = list(set().union(*four))
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in four)], names=["key", "t0", "o0", "t1", "o1"])
            for c in four:
                c.clear()
            return out

        for batch in batches:
            for text, label, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                four[2 * half + 1 - label].update({k for run in set(LETTERS.findall((text or "").lower())) for k in features(run)})
                if sum(map(len, four)) > 300_000:
                    yield flush()
        yield flush()

    counted = sample.select("text", "toxic", "half").mapInArrow(count, "key string, t0 long, o0 long, t1 long, o1 long")
    return materialize(counted.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("t0", "o0", "t1", "o1")]), "toxicity-words")


def learn_words(counted: DataFrame, t: Column, o: Column, toxic: int, other: int) -> dict[str, float]:
    """Entries with strengths; t and o: a feature's documents, toxic and other: all documents. An entry is in 10 or more toxic
    documents of the sample, as EVIDENCE asks, so the number of entries is bounded by the sample's words."""
    entries = {f"{w}$": GENERAL_STRENGTH for w in INSULTS}
    if not toxic:
        return entries
    ratio = ((t + 0.5) / (toxic + 1)) / ((o + 0.5) / (other + 1))
    n, share = t + o, toxic / (toxic + other)
    part = lambda c, p: F.when(c > 0, c * F.log(c / (n * p))).otherwise(0.0)
    evidence = 2 * (part(t, share) + part(o, max(1 - share, 1e-9)))
    learned = (ratio >= RATIO) & (evidence >= EVIDENCE)
    known = F.col("key").isin(list(entries)) & (n >= 5)
    rows = counted.where(learned | known).select("key", F.greatest(F.log(ratio), F.lit(0.0)).alias("strength")).collect()
    return entries | {r["key"]: r["strength"] for r in rows}


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression (rows x features, labels, row weights) with a normal prior."""

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + (precision * (b - mean) ** 2).sum() / 2)

    beta = mean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (p - y)) + precision * (beta - mean)
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(precision)
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):  # a full step can overshoot
            size /= 2
        beta = beta - size * step
        if size * np.abs(step).max() < 1e-6:
            break
    return beta


def fit_clauses(grammar: Grammar, docs: np.ndarray, types: np.ndarray, strengths: np.ndarray, copies: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float) -> None:
    """Sets a grammar's weights, offset and bias from the clauses (document, type, strength, how often) of documents (label, weight)."""
    n = len(MEANS)
    x = np.zeros((len(y), n + 2))
    np.add.at(x, (docs, types), copies * strengths)
    np.add.at(x, (docs, n), copies)
    x[:, n + 1] = 1
    least = math.log(prior / (1 - prior))
    beta = fit(x, y, w, np.concatenate([MEANS, [0, least]]), np.concatenate([np.full(n, 16.0), [1, 1]]))
    grammar.weights, grammar.offset = np.maximum(beta[:n], 0), min(0.0, float(beta[n]))
    # the bias, now that odds below 0 count as 0
    sums = np.bincount(docs, copies * grammar.odds(types, strengths), minlength=len(y))
    grammar.bias = float((fit(np.column_stack([sums, np.ones(len(y))]), y, w, np.array([1.0, least]), np.array([1e9, 1.0])))[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int, other: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic, half) of a bounded sample, one of each group of near copies; and the numbers of labels."""
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in labels.groupBy("toxic").agg(F.count(F.lit(1))).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, toxic / max(1, sizes.get(1, 0)))).otherwise(min(1.0, other / max(1, sizes.get(0, 0))))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 20))
    chosen = small(labels.where(draw < share * (1 << 20)).dropDuplicates(["doc_id"]), 4 * (toxic + other))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in batch.column(0).to_pylist():
                words = (text or "").lower().split()
                keys.append(min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) >> 1 for i in range(max(1, len(words) - 4))), default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["text", "toxic", "key"])

    joined = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic")
    keyed = joined.mapInArrow(key, "text string, toxic int, key long").groupBy("key", "toxic").agg(F.min("text").alias("text"))
    return materialize(keyed.select("text", "toxic", F.pmod("key", F.lit(2)).cast("int").alias("half")), "toxicity-sample"), sizes


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, other: int = OTHER) -> Grammar:
    """A grammar from docs (doc_id, text) and labels (doc_id, toxic)."""
    bound_batches(docs.sparkSession)
    sample, sizes = labelled_sample(docs, labels, toxic, other)
    n = {(r[0], r[1]): r[2] for r in sample.groupBy("toxic", "half").agg(F.count(F.lit(1))).collect()}
    of = lambda label, *halves: sum(n.get((label, h), 0) for h in halves)
    if not of(1, 0, 1):
        return Grammar({f"{w}$": GENERAL_STRENGTH for w in INSULTS})
    counted = count_features(sample)
    t, o = ([F.col(f"{c}{h}") for h in (0, 1)] for c in "to")
    grammar = Grammar(learn_words(counted, t[0] + t[1], o[0] + o[1], of(1, 0, 1), of(0, 0, 1)))
    crossed = [Grammar(learn_words(counted, t[h], o[h], of(1, h), of(0, h))) for h in (1, 0)]  # for texts of half 0 and 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half, own in enumerate(crossed):
                part = batch.filter(pc.equal(batch.column(2), half))
                rows, types, strengths = own.clauses(part.column(0))
                counts: list[Counter] = [Counter() for _ in range(part.num_rows)]
                for r, k in zip(rows.tolist(), zip(types.tolist(), strengths.tolist(), strict=True), strict=True):
                    counts[r][k] += 1
                clauses = [[{"type": a, "strength": b, "copies": c} for (a, b), c in sorted(x.items())] for x in counts]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(clauses, pa.list_(CLAUSE))], names=["toxic", "clauses"])

    # a row for each document of the bounded sample, with at most one element for each type and strength
    rows = sample.select("text", "toxic", "half").mapInArrow(found, "toxic int, clauses array<struct<type:long,strength:double,copies:long>>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["toxic"], [tuple(c.values()) for c in r["clauses"]]))
    y = np.array([r["toxic"] for r in rows], float)
    prior = min(0.9, max(0.001, sizes[1] / sum(sizes.values())))
    weight = np.where(y == 1, prior / max(1e-9, y.mean()), (1 - prior) / max(1e-9, 1 - y.mean()))
    at = np.repeat(np.arange(len(rows)), [len(r["clauses"]) for r in rows])
    types, strengths, copies = (np.array([c[k] for r in rows for c in r["clauses"]], kind) for k, kind in (("type", np.int64), ("strength", float), ("copies", float)))
    fit_clauses(grammar, at, types, strengths, copies, y, weight, prior)
    return grammar


def score(docs: DataFrame, grammar: Grammar, *passed: str, threshold: float = THRESHOLD) -> DataFrame:
    """The columns `passed` of docs (doc_id if none), score and predicted of every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    passed = tuple(c for c in passed or ("doc_id",) if c not in ("score", "predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.scores(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[*passed, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed)
    return docs.select("text", *passed).mapInArrow(run, f"{kinds}, score double, predicted int")
