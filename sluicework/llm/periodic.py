"""Stretches of a text in which a few words come again and again.

A run is a stretch of words with smallest period q, at least ``max(LEAST, TIMES * q)`` long, that no neighbouring word extends keeping
the period. The search is a dynamic program over sparse diagonals: a word that an earlier one equals at lag q makes the match on
diagonal q longer by one, and a diagonal that ends with enough matches (the length less q) is a run.

Which earlier occurrences count keeps the diagonals sparse without losing a run. Lags up to ``NEAR`` are compared outright. For
lags in (s, 2s], s = NEAR, 2 NEAR, ..., a word counts as the first of the 2s words from it, and only the nearest earlier occurrence
of these 2s words: inside a run of smallest period q <= 2s it is the one q words before, since a nearer one would give the run a
smaller period (Fine and Wilf), and such a run has at least 3q > 2s matches. So each word is on one diagonal a scale, and a text of n words
takes O(n log n) steps in sorted arrays, whatever repeats in it. The 2s words are compared exactly, by numbers given
to pairs of s words; words whose s words come once drop out of all larger scales.

Cases: null or empty text -> no words, no runs, an empty collapsed text; very long texts are searched whole; repeated rows, equal
and null ids stay as they are; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import WORD, give_back, pieces, segment_sum, split_words, text_array

LEAST, TIMES, NEAR = 6, 4, 8
PIECE = 8 << 20


def _segments(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of neighbouring numbers in a sorted array."""
    if not len(at):
        return at, at
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    first = np.concatenate([[0], cuts])
    return at[first], np.diff(np.concatenate([first, [len(at)]]))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key, equal where keys are, and which keys come more than once."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return number, count[number] > 1


def find_runs(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), sorted by start and period, of several texts at once: ``words`` holds a number for each
    word, ``offsets`` where texts begin, and starts count from the first word of all."""
    n, lengths = len(words), np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)
    found = []

    def emit(starts: np.ndarray, matches: np.ndarray, lags: np.ndarray | int) -> None:
        whole = matches + lags
        some = whole >= np.maximum(LEAST, TIMES * lags)
        if some.any():
            found.append(np.stack([(starts - lags)[some], whole[some], np.broadcast_to(lags, whole.shape)[some]], 1))

    if not n:
        return np.zeros((0, 3), np.int64)
    # Equal numbers mean equal words of one text.
    number, repeated = _numbered(text * (int(words.max()) + 1) + words)
    for q in range(1, min(NEAR, n - 1) + 1):
        starts, matches = _segments(np.flatnonzero(number[q:] == number[:-q]) + q)
        emit(starts, matches, q)
    if found:
        # A stretch of smaller period shows on the diagonals of its multiples too, with the same ends.
        near = np.concatenate(found)
        near = near[np.lexsort((near[:, 2], near[:, 1], near[:, 0]))]
        found = [near[np.concatenate([[True], (near[1:, :2] != near[:-1, :2]).any(1)])]]
    at, ids, width = np.flatnonzero(repeated), number[repeated], 1
    longest = int(lengths.max())
    while len(at) and TIMES * width <= longest:
        # Words from ``at`` on, twice as many: pairs of a place and the place ``width`` words later, where both are left.
        place = np.full(n + width + 1, -1, np.int64)
        place[at] = np.arange(len(at))
        other = place[at + width]
        both = other >= 0
        at, left, right = at[both], ids[both], ids[other[both]]
        width *= 2
        if not len(at):
            break
        ids, repeated = _numbered(left * (int(ids.max()) + 1) + right)
        at, ids = at[repeated], ids[repeated]
        if width > NEAR and len(at):
            order = np.lexsort((at, ids))
            sorted_at, same = at[order], np.diff(ids[order]) == 0
            lag = np.diff(sorted_at)[same]
            later = sorted_at[1:][same]
            fits = (lag > width // 2) & (lag <= width)
            lag, later = lag[fits], later[fits]
            by_lag = np.lexsort((later, lag))
            lag, later = lag[by_lag], later[by_lag]
            # One number line for all diagonals, far enough apart.
            starts, matches = _segments(lag * (2 * n + 2) + later)
            emit(starts % (2 * n + 2), matches + width - 1, starts // (2 * n + 2))
    runs = np.concatenate([*found, np.zeros((0, 3), np.int64)])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _searched(doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    words, offsets = split_words(texts)
    coded = words.dictionary_encode()
    runs = find_runs(coded.indices.to_numpy().astype(np.int64), offsets)
    text = np.searchsorted(offsets, runs[:, 0], "right") - 1
    n_runs = np.bincount(text, minlength=len(texts)).astype(np.int64)
    structs = pa.StructArray.from_arrays([pa.array(runs[:, 0] - offsets[text]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["start", "length", "period"])
    # Words after a run's first period go: +1 where such a stretch begins, -1 after it.
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    n_kept = segment_sum(kept.astype(np.float64), offsets).astype(np.int64)
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_kept)])), words.filter(pa.array(kept)))
    columns = {
        "doc_id": doc_ids, "n_words": pa.array(np.diff(offsets)), "runs": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_runs)]), pa.int32()), structs),
        "collapsed": pc.binary_join(lists, pa.scalar(" ", words.type)).cast(pa.string()),
    }
    return pa.RecordBatch.from_pydict(columns)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text by start and period, and its words joined by one blank without
    those that a run holds after its first period."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            texts = text_array(batch.column("text"))
            for a, b in pieces(texts, PIECE):
                yield _searched(batch.column("doc_id").slice(a, b - a), texts.slice(a, b - a))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(apply, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text of about one document in ten with its end repeated, by the rule of the query."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)

    def with_end(words: Column) -> Column:
        g, n = F.floor(h / 10), F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(at, lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))), " ")

    # One pass over the words: an array of one array.
    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, with_end(w)).otherwise("")), 1)
    return F.when(h % 10 == 0, changed).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Digests of the runs of every document and of its collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("best", best)
    period = -F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
