"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts per (language, bucket) inside each partition and then in one Spark aggregation; the
log-probability matrix (buckets x languages) is broadcast, and texts are scored batch by batch as a sparse
document-by-word product in numpy: each distinct word of a batch is scored once. A language always has the same
``1 << BITS`` buckets, 128 KB of the matrix; a table with over ``MAX_LANGS`` languages is an error that names their number,
since it would take a broadcast without a bound (its column holds something else than languages).

Cases: null or empty text, or text without a letter -> ``und``, score 0; a very long text is scored whole; no labelled row
at all -> every text is ``und``; repeated rows are scored alike; ties go to the language that sorts first; an empty table
gives no row; extra columns are kept by ``identify``, but for one that has the name of a new column, which is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import crc_mod, dictionary, give_back, pieces, quoted, split_words, text_array

ORDERS = (1, 2, 3, 4)
#: Buckets of a language, and the most languages of a model (128 MB of matrix).
BITS, MAX_LANGS = 15, 1000
#: Bytes of text that are counted or scored at once.
PIECE = 6 << 20
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def word_ngrams(words: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: indices of words and buckets of their n-grams. Anything but a letter is a boundary."""
    joined = f" {' '.join(words)} ".lower()
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    word = np.cumsum(codes == 32) - 1
    codes = np.where(_letters()[codes], codes, 0).astype(np.uint64)
    real = codes > 0
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        inner = np.ones(m, bool) if n > 2 else (real[:m] if n == 1 else real[:m] | real[1 : m + 1])
        for i in range(1, n - 1):
            inner &= real[i : m + i]
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ codes[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        yield word[at + (~real[at])], (h >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    logp: np.ndarray  # languages x buckets
    bits: int


def train(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None) -> Model:
    """Fit on all rows of ``docs`` that ``where`` admits and that have a text and a language."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.where(where) if where is not None else rows
    prior = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(MAX_LANGS + 1).collect()}
    if len(prior) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages in column {lang}")
    langs, bits = sorted(prior), BITS
    if not langs:
        return Model([], np.zeros(0), np.zeros((0, 2)), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        total: dict[int, np.ndarray] = {}
        number = {name: i for i, name in enumerate(langs)}
        parts = ((batch, texts, a, b) for batch in batches for texts in [text_array(batch.column(0))] for a, b in pieces(texts, PIECE))
        for batch, texts, a, b in parts:
            words, offsets = split_words(texts.slice(a, b - a))
            distinct, index = dictionary(words)
            if not distinct:
                continue
            of_text = np.array([number[x] for x in batch.column(1).slice(a, b - a).to_pylist()])
            of_word = np.repeat(of_text, np.diff(offsets))
            weights = {k: np.bincount(index[of_word == k], minlength=len(distinct)) for k in np.unique(of_word)}
            for at, bucket in word_ngrams(distinct, bits):
                for k, weight in weights.items():
                    total.setdefault(k, np.zeros(1 << bits))
                    total[k] += np.bincount(bucket, weights=weight[at], minlength=1 << bits)
        for k, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(counts[some].astype(np.int64))], ["k", "bucket", "n"]
            )

    parts = rows.select(text, lang).mapInArrow(count, "k int, bucket int, n long")
    # At most MAX_LANGS x buckets rows.
    sums = parts.groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), 1 << bits), np.float32)
    counts[sums["k"].to_numpy(), sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    logp = np.log((counts + 0.5) / (counts.sum(1, keepdims=True, dtype=np.float64) + 0.5 * counts.shape[1]))
    docs_of = np.array([prior[x] for x in langs], float)
    return Model(langs, np.log(docs_of / docs_of.sum()), logp.astype(np.float32), bits)


def score_batch(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    words, offsets = split_words(texts)
    distinct, index = dictionary(words)
    if not model.langs or not distinct:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    word_score = np.zeros((len(model.langs), len(distinct)))
    grams = np.zeros(len(distinct))
    for at, bucket in word_ngrams(distinct, model.bits):
        grams += np.bincount(at, minlength=len(distinct))
        for k in range(len(model.langs)):
            word_score[k] += np.bincount(at, weights=model.logp[k][bucket], minlength=len(distinct))
    of_text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    total = np.stack([np.bincount(of_text, weights=s[index], minlength=len(texts)) for s in word_score])
    known = np.bincount(of_text, weights=grams[index], minlength=len(texts)) > 0
    total += model.prior[:, None]
    best = total.argmax(0)
    share = 1 / np.exp(np.minimum(total - total.max(0), 0)).sum(0)
    return [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], np.where(known, share, 0.0)


def identify(docs: DataFrame, model: Model, text: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its posterior; all columns and rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(lang_col, score_col)
    at = docs.columns.index(text)
    names = [*docs.columns, lang_col, score_col]
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema) + f", {quoted(lang_col)} string, {quoted(score_col)} double"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            texts = text_array(batch.column(at))
            for a, b in pieces(texts, PIECE):
                pred, score = score_batch(texts.slice(a, b - a), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(pred, pa.string()), pa.array(score)], names)

    # By place, since mapInArrow looks its columns up by unquoted names.
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(apply, schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Language and posterior of every document of ``documents``; a third of them, held out, is not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = train(docs, where=~held_out)
    out = identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, score_col="score")
    return out.select("doc_id", "held_out", "lang_pred", "score")
