"""Quality by weak supervision: rules vote or abstain, expectation-maximisation finds their accuracies, and the posterior
probability of good quality decides.

Each rule looks at counts of the whole text and votes good (1), bad (-1) or abstains (0). Documents with the same votes are
alike to the model, so EM runs on the counts of vote patterns: at most 3^rules rows reach the driver, whatever the input,
and they cover all documents. The model: a document is good with probability `prior`; a rule that votes is right with one
accuracy on good documents and another on bad ones, independently of the others given the truth. So a rule that looks for one
kind of junk, and lets the other kinds pass, can be sure when it votes bad and say little when it votes good. EM starts from
documents without a bad vote as good. Accuracies stay in ON_GOOD and ON_BAD and on the right side of chance, so good keeps
its meaning and a rule that votes at random can't split the documents; the prior stays in PRIOR. An abstention says nothing. The posterior is a sum of log odds, evaluated by Spark per row.

Words are [^\\x20\\x09-\\x0D]+; null text has none. The base test fails texts with under 50 words or with over half of their
words in repeated 3-word windows, whatever the posterior. Empty texts fail it. Repeated rows are documents of their own
with equal results; other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, codes, flat_words, materialize, per_row, texts

ON_GOOD, ON_BAD, PRIOR, ROUNDS, KEEP = (0.9, 0.999), (0.01, 0.999), (0.2, 0.98), 50, 0.5
MIN_WORDS, MAX_REPEAT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_marked_words", "n_upper", "n_letters", "n_ends")

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def byte_sums(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """How many bytes of each text are in the table."""
    column = pa.concat_arrays([column])  # without an offset
    if not len(column):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    return np.diff(sums[offsets - offsets[0]])


def repeat_words(own: np.ndarray, rows: np.ndarray, n_names: int, n: int) -> np.ndarray:
    """For each row, its words in 3-word windows that its text has twice or more."""
    if len(own) < 3:
        return np.zeros(n, np.int64)
    pair = pd.factorize(own[:-1] * n_names + own[1:])[0]
    window = pd.factorize(pair[:-1] * np.int64(n_names) + own[2:])[0]
    at = np.flatnonzero(rows[:-2] == rows[2:])
    key = pd.factorize(rows[at] * np.int64(window.max() + 1) + window[at])[0]
    twice = at[np.bincount(key)[key] > 1] if len(at) else at
    covered = np.zeros(len(own), bool)
    for i in range(3):
        covered[twice + i] = True
    return per_row(rows[covered], n)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n = texts(batch.column(1)), batch.num_rows
            flat, rows = flat_words(text)
            own, names = codes(flat)
            lists = pc.split_pattern(text, "\n")
            line_rows = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
            lines = lists.flatten()
            trimmed = pc.ascii_trim_whitespace(lines)
            full = pc.greater(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
            line_own, line_names = codes(lines)
            key = line_rows[full] * max(1, len(line_names)) + line_own[full]
            again = pd.Series(key).duplicated().to_numpy()
            # what words are like is found once for each distinct one
            letters = pc.utf8_length(pc.replace_substring_regex(names, r"\P{L}", "")).to_numpy(zero_copy_only=False)
            upper = pc.utf8_length(pc.replace_substring_regex(names, r"\P{Lu}", "")).to_numpy(zero_copy_only=False)
            marked = pc.match_substring_regex(names, r"[#*$%&|<>]|!!").to_numpy(zero_copy_only=False)
            ends = pc.match_substring_regex(trimmed, r"""[.!?:;…»"'”)]$""").to_numpy(zero_copy_only=False)
            columns = {
                "n_words": per_row(rows, n),
                "word_chars": per_row(rows, n, pc.utf8_length(flat).to_numpy(zero_copy_only=False)),
                "n_symbols": byte_sums(text, SYMBOLS),
                "n_dup_lines": per_row(line_rows[full][again], n),
                "n_repeat_words": repeat_words(own, rows, max(1, len(names)), n),
                "n_lines": per_row(line_rows[full], n),
                "n_alpha_words": per_row(rows[letters[own] > 0] if len(own) else rows, n),
                "n_marked_words": per_row(rows[marked[own]] if len(own) else rows, n),
                "n_upper": per_row(rows, n, upper[own]) if len(own) else np.zeros(n, np.int64),
                "n_letters": per_row(rows, n, letters[own]) if len(own) else np.zeros(n, np.int64),
                "n_ends": per_row(line_rows[full & ends], n),
            }
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[c]) for c in COUNTS)], names=["doc_id", *COUNTS])

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def vote(value: Column, good: Column, bad: Column) -> Column:
    """1, -1 or 0; 0 also where there is nothing to look at."""
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules: each takes a ratio of counts; between its two bounds it abstains."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    size, length = F.col("n_words"), ratio("word_chars", "n_words")
    low = lambda x, good, bad: vote(x, x <= good, x > bad)
    return {
        "v_size": vote(size, size >= 80, size < 20),
        "v_word_length": vote(length, (length >= 3) & (length <= 12), (length < 2.5) | (length > 20)),
        "v_symbols": low(ratio("n_symbols", "n_words"), 0.05, 0.3),
        "v_marked": low(ratio("n_marked_words", "n_words"), 0.05, 0.3),
        "v_lines": low(ratio("n_dup_lines", "n_lines"), 0.1, 0.3),
        "v_repeats": low(ratio("n_repeat_words", "n_words"), 0.2, 0.5),
        "v_alpha": (lambda x: vote(x, x >= 0.8, x < 0.6))(ratio("n_alpha_words", "n_words")),
        "v_upper": low(ratio("n_upper", "n_letters"), 0.2, 0.5),
        "v_ends": (lambda x: vote(x, x >= 0.3, x < 0.02))(ratio("n_ends", "n_lines")),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """The prior, and the rules' accuracies on good and on bad documents, from (votes, number of documents) rows."""
    if not patterns:
        return 0.5, [], []
    v = np.array([p for p, _ in patterns], float)
    n = np.array([c for _, c in patterns], float)
    good = np.where((v < 0).any(1), 0.05, 0.95)
    for _ in range(rounds):
        prior = float(np.clip((n * good).sum() / n.sum(), *PRIOR))
        # two votes at 0.8 steady rare rules
        on_good = ((n * good) @ (v > 0) + 1.6) / ((n * good) @ (v != 0) + 2)
        on_bad = ((n * (1 - good)) @ (v < 0) + 1.6) / ((n * (1 - good)) @ (v != 0) + 2)
        on_good, on_bad = np.clip(on_good, *ON_GOOD), np.clip(on_bad, *ON_BAD)
        on_bad = np.maximum(on_bad, 1 - on_good)  # votes are never evidence for the other side
        odds = math.log(prior / (1 - prior)) + (v > 0) @ np.log(on_good / (1 - on_bad)) + (v < 0) @ np.log((1 - on_good) / on_bad)
        good = 1 / (1 + np.exp(-odds))
    return prior, on_good.tolist(), on_bad.tolist()


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, posterior and the votes of every row of docs (doc_id, text)."""
    rules = votes()
    # written once: the patterns' counts and the result read it
    voted = materialize(counts(docs).withColumns(rules), "votes")
    rows = voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).collect()
    prior, on_good, on_bad = fit(sorted((tuple(r[:-1]), r[-1]) for r in rows))
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, g, b in zip(rules, on_good, on_bad, strict=False):
        odds = odds + F.when(F.col(name) > 0, math.log(g / (1 - b))).when(F.col(name) < 0, math.log((1 - g) / b)).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    out = voted.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.select("doc_id", *COUNTS[:5], "base_failed", (~failed & (F.col("posterior") >= keep)).alias("kept"), "posterior", *rules)
