"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts the n-grams (1 to `GRAMS` code points of the lower-cased text, with a space at each end) of whole texts in
`BUCKETS` buckets, in Spark, over a sample of the labelled rows: those with the smallest hashes of doc_id, about `PER_LANG`
documents a language. The matrix of log probabilities, languages x buckets, is broadcast; its size doesn't depend on the
rows. Each batch of texts is scored in numpy as a sparse product: the n-grams of all its texts in one array, their columns
of the matrix gathered, and summed between the texts' borders. Whole texts are read, in runs of bounded size; each n-gram of a
text counts once, whichever run it begins in, in learning and in scoring.

A text that is null or has no letter is `und` with score 0. Otherwise lang_pred is the most probable learned language (ties:
the first by code point), and score its posterior probability, with a text's n-grams counting as at most `EVIDENCE` of them,
so that very long texts aren't certain by length alone. Without any labelled row all texts are `und`. Priors are uniform.

Rows are judged one by one: repeated rows and doc_ids stay rows with equal results, a null doc_id is passed on (and hashed as the
text null when the sample is drawn), an empty table gives an empty result. Columns that aren't asked for are not read; one that
is passed under the name of a result (lang_pred, score) gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, texts

GRAMS, BUCKETS, PER_LANG, EVIDENCE, SMOOTHING = 4, 1 << 16, 3000, 400, 0.1
LETTER = regex.compile(r"\p{L}")
#: Code points whose n-grams are found in one go.
RUN = 1 << 17


def gram_runs(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, for n from 1 to GRAMS: those that begin at up to RUN code points at a time, each once."""
    text = f" {text.lower()} "
    for at in range(0, len(text), RUN):
        points = np.frombuffer(text[at : at + RUN + GRAMS - 1].encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        found, code = [], np.zeros(len(points), np.uint64)
        for n in range(1, min(GRAMS, len(points)) + 1):
            code = code[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
            found.append(((code[:RUN] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)) & np.uint64(BUCKETS - 1))
        yield np.concatenate(found).astype(np.int64)


def grams(text: str) -> np.ndarray:
    return np.concatenate(list(gram_runs(text)))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: languages x buckets."""
        smooth = counts + SMOOTHING
        self.langs, self.logs = langs, np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32))

    def predict(self, values: list[str]) -> tuple[list[str], list[float]]:
        """Languages and scores of texts."""
        sums, sizes = np.zeros((len(values), max(1, len(self.langs)))), np.zeros(len(values))
        pending: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            starts = np.cumsum([0, *(len(g) for _, g in pending[:-1])])
            both = np.add.reduceat(self.logs[np.concatenate([g for _, g in pending])], starts, axis=0, dtype=np.float64)
            for (i, g), s in zip(pending, both, strict=True):
                sums[i] += s
                sizes[i] += len(g)

        letters = [bool(self.langs and LETTER.search(x)) for x in values]
        for i, text in enumerate(values):
            for found in gram_runs(text) if letters[i] else ():
                pending.append((i, found))
                held += len(found)
                if held > 4 * RUN:
                    flush()
                    pending, held = [], 0
        if pending:
            flush()
        sums *= np.minimum(1, EVIDENCE / np.maximum(sizes, 1))[:, None]
        odds = np.exp(sums - sums.max(1, keepdims=True))
        odds /= odds.sum(1, keepdims=True)
        best = odds.argmax(1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], [float(odds[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, letters, strict=True))]


def train(labelled: DataFrame, per_lang: int = PER_LANG) -> Model:
    """The model of (doc_id, text, lang) rows; rows with a null lang don't count.

    The sample: rows whose hash of doc_id is below the fraction per_lang / rows of their language.
    """
    spark = labelled.sparkSession
    bound_batches(spark)
    labelled = labelled.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    place = {lang: i for i, lang in enumerate(langs)}
    if not langs:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / sizes[lang]))]), F.col("lang"))
    sample = labelled.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("language")), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(texts(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums = own.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for found in gram_runs(text):
                    sums += np.bincount(found, minlength=BUCKETS)
        for lang, sums in own.items():
            full = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([place[lang]] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array(sums[full], pa.int64())], names=["lang", "bucket", "n"])

    # at most languages x BUCKETS rows, whatever the input
    rows = sample.select("text", "lang").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), BUCKETS))
    counts[rows["lang"].to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model, *passed: str) -> DataFrame:
    """The columns `passed` of docs (doc_id if none), lang_pred and score of every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passed = tuple(c for c in passed or ("doc_id",) if c not in ("lang_pred", "score"))
    sent = list(dict.fromkeys(("text", *passed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(texts(batch.column(0)).to_pylist())
            own = [batch.column(sent.index(c)) for c in passed]
            yield pa.RecordBatch.from_arrays([*own, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*passed, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed)
    return docs.select(*sent).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, by a modulus; 0 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))
