"""The best documents of every item by the words that they share, equal documents being scored once.

Documents are restricted to the vocabulary of the items: what is left of a text is a bag, the numbers of the items' terms that it holds
with their counts, and its length. Bags are grouped where they arise and then by a shuffle on the whole bag and the
document's m, which hashes it and compares it in full. A class of equal bags has one score for an item, so classes are scored,
and a class keeps its ``k`` smallest ids only: of one item, the k best documents lie in the k best classes ordered by score and
first id, and among the first k ids of each.

Items are worked on in blocks of at most ``TERMS`` different terms an item summed up and ``ITEMS`` items, so what is sent to every
task has a bound whatever the number of items; a single item is never cut. Terms of over ``TERM_BYTES`` bytes are known by their SHA-256. Scores are
sums of 64-bit integers.

Cases: null or empty text -> no term, in a document (it counts nowhere) and in an item (it has no result); very long texts are
read whole; a repeated row is a document of its own, so an id may hold several places, a repeated item is one item; ids null come
after all others; an empty table on either side gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicework.llm.common import give_back, pieces, saved, split_words, text_array

TERMS, ITEMS, TERM_BYTES, PIECE = 1_000_000, 1_000, 64, 8 << 20
#: Classes that are scored at once; parts in which a class's ids are brought together; a null id, after all others.
ROWS, PARTS, NONE = 4096, 64, (1 << 63) - 1
_ASCII = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128)).lower()
_FOLD = np.concatenate([np.frombuffer(_ASCII.encode(), np.uint8), np.arange(128, 256, dtype=np.uint8)])


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of ``texts`` in order, and the offsets of each text's: runs of ASCII letters and digits and of all that
    is not ASCII, A-Z as a-z."""
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    folded = _FOLD[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.zeros(0, np.uint8)
    return split_words(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(folded)))


def known_by(terms: pa.Array) -> pa.Array:
    """Terms as bytes, long ones as a byte that no text holds and their digest."""
    terms = terms.cast(pa.large_binary())
    long = pc.greater(pc.binary_length(terms), TERM_BYTES)
    if not pc.any(long).as_py():
        return terms
    digests = [b"\xff" + hashlib.sha256(t).digest() for t in terms.filter(long).to_pylist()]
    return pc.replace_with_mask(terms, long, pa.array(digests, pa.large_binary()))


def grouped(rows: np.ndarray, terms: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, terms, counts): the different terms of each row, ascending."""
    span = int(terms.max(initial=0)) + 1
    pairs, counts = np.unique(rows * span + terms, return_counts=True)
    return np.concatenate([[0], np.cumsum(np.bincount(pairs // span, minlength=n_rows))]), pairs % span, counts


class Items:
    """A block of items as their terms: what every task of the search gets."""

    def __init__(self, ids: list, texts: pa.Array):
        words, offsets = terms_of(texts)
        coded = words.dictionary_encode()
        rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
        self.ids, self.names = ids, known_by(coded.dictionary)
        self.offsets, self.terms, _ = grouped(rows, coded.indices.to_numpy().astype(np.int64), len(texts))

    def by_term(self) -> tuple[np.ndarray, np.ndarray]:
        """The items by term, and where each term's begin."""
        order = np.argsort(self.terms, kind="stable")
        items = np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))
        return items[order], np.searchsorted(self.terms[order], np.arange(len(self.names) + 1))


def item_blocks(items: DataFrame, terms: int = TERMS, most: int = ITEMS) -> list[DataFrame]:
    """``items`` (item_id, text) dealt to as many blocks as their different terms and their number ask for."""
    words = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0))
    n, held = items.agg(F.count(F.lit(1)), F.sum(F.size(words))).first()
    blocks = max(1, math.ceil(n / most), math.ceil((held or 0) / terms))
    # Half as many again as the bound asks for, so that blocks of uneven size keep to it.
    blocks = blocks if blocks == 1 else math.ceil(1.5 * blocks)
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [items.where(place == b) if blocks > 1 else items for b in range(blocks)]


def bags(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """(n, terms, counts, docs, ids): bags that a task meets in a piece of its texts, each with its number of documents
    and the smallest ``k`` of their ids. A document without any term has n = 0."""
    names = items.names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            texts = text_array(batch.column("text"))
            for a, b in pieces(texts, PIECE):
                ids = pc.fill_null(batch.column("doc_id").slice(a, b - a), NONE).to_pylist()
                words, offsets = terms_of(texts.slice(a, b - a))
                coded = words.dictionary_encode()
                known = pc.fill_null(pc.index_in(known_by(coded.dictionary), value_set=names), -1).to_numpy().astype(np.int64)
                term, n = known[coded.indices.to_numpy()], np.diff(offsets)
                rows = np.repeat(np.arange(len(n)), n)[term >= 0]
                ends, term, count = grouped(rows, term[term >= 0], len(n))
                term, count = term.astype(np.int32), count.astype(np.int32)
                met: dict[tuple, list] = {}
                for r, (x, y, length) in enumerate(zip(ends, ends[1:], n.tolist(), strict=False)):
                    met.setdefault((length, term[x:y].tobytes(), count[x:y].tobytes()), []).append(ids[r])
                best = [sorted(m)[:k] for m in met.values()]
                column = lambda at: [np.frombuffer(key[at], np.int32) for key in met]  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([key[0] for key in met], pa.int64()), "terms": pa.array(column(1), pa.list_(pa.int32())), "counts": pa.array(column(2), pa.list_(pa.int32())),
                    "docs": pa.array([len(m) for m in met.values()], pa.int64()), "ids": pa.array(best, pa.list_(pa.int64())),
                })

    return docs.select("doc_id", "text").mapInArrow(apply, "n long, terms array<int>, counts array<int>, docs long, ids array<long>")


def classes(found: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(m, terms, counts, docs, ids): one row for all documents of equal bag and m; and the number of documents that hold a term."""
    n, length = found.where(F.col("n") > 0).agg(F.sum("docs"), F.sum(F.col("n") * F.col("docs"))).first()
    m = F.expr(f"100 - 90 + (90 * n * {n or 0}L) div {length or 1}L")
    rows = found.where(F.size("terms") > 0).select(m.alias("m"), "terms", "counts", "docs", "ids")
    smallest = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k)
    # A class may hold any share of the rows, so its ids come together in parts first.
    for keys in ((F.pmod(F.xxhash64("ids"), F.lit(PARTS)).alias("part"),), ()):
        rows = rows.groupBy("m", "terms", "counts", *keys).agg(F.sum("docs").alias("docs"), smallest.alias("ids")).drop("part")
    return rows, n or 0


def _best(items: np.ndarray, scores: np.ndarray, firsts: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` best of every item, by score and then by first id."""
    order = np.lexsort((firsts, -scores, items))
    starts = np.flatnonzero(np.diff(items[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


class Best:
    """The best classes of each item so far: items, scores, first ids, and all ids that a class keeps (null as ``NONE``)."""

    def __init__(self, n_items: int, k: int):
        self.n_items, self.k, self.last = n_items, k, np.zeros(n_items, np.int64)
        self.items, self.scores, self.firsts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, table: np.ndarray, ids: list[list[int]]) -> None:
        """``table`` has a row a class and a column an item."""
        # A class that ties with the last one kept may come before it.
        row, item = np.nonzero(table >= np.maximum(self.last, 1)[None, :])
        if len(row) > self.k * self.n_items and len(table) > self.k:
            least = np.partition(table, len(table) - self.k, axis=0)[len(table) - self.k]
            some = table[row, item] >= least[item]
            row, item = row[some], item[some]
        if not len(row):
            return
        items, scores = np.concatenate([self.items, item]), np.concatenate([self.scores, table[row, item]])
        ids = self.ids + [ids[r] for r in row.tolist()]
        firsts = np.concatenate([self.firsts, np.array([x[0] for x in ids[len(self.ids) :]], np.int64)])
        best = _best(items, scores, firsts, self.k)
        self.items, self.scores, self.firsts, self.ids = items[best], scores[best], firsts[best], [ids[x] for x in best.tolist()]
        count = np.bincount(self.items, minlength=self.n_items)
        full = np.flatnonzero(count >= self.k)
        self.last[full] = self.scores[np.cumsum(count)[full] - 1]

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, score, id) of the best documents of the classes."""
        n = np.array([len(x) for x in self.ids], np.int64)
        items, scores, ids = np.repeat(self.items, n), np.repeat(self.scores, n), np.array([x for members in self.ids for x in members], np.int64)
        best = _best(items, scores, ids, self.k)
        return items[best], scores[best], ids[best]


def scores_of(batch: pa.RecordBatch, n_items: int, items: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The score of each class of a batch for each item."""
    ends = batch.column("terms").offsets.to_numpy().astype(np.int64)
    term, tf = (batch.column(c).values.slice(ends[0], ends[-1] - ends[0]).to_numpy().astype(np.int64) for c in ("terms", "counts"))
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    value = (1_000_000_000 * tf) // (1000 * tf + 8 * batch.column("m").to_numpy()[row])
    order = np.argsort(term, kind="stable")
    cuts = np.flatnonzero(np.diff(term[order], prepend=-1))
    table = np.zeros((batch.num_rows, n_items), np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=False):
        mine, t = order[a:b], term[order[a]]
        table[row[mine][:, None], items[starts[t] : starts[t + 1]][None, :]] += (value[mine] * weights[t])[:, None]
    return table


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): of every item (item_id, text) the ``k`` documents (integer doc_id, text) with the
    highest scores above 0."""
    key = items.schema["item_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for block in item_blocks(items.select("item_id", "text").distinct()):
        held = block.toArrow()
        one = Items(held["item_id"].to_pylist(), text_array(held["text"]))
        rows, n = classes(saved(bags(docs, one, k)), k)
        rows = saved(rows)
        df = rows.select("docs", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("docs").alias("df")).toArrow()
        holding = np.zeros(len(one.names), np.int64)
        holding[df["term"].to_numpy()] = df["df"].to_numpy()
        weights = np.floor(1000 * np.log((2 * n + 2) / (2 * holding + 1))).astype(np.int64)
        found = rows.select("m", "terms", "counts", "ids").mapInArrow(_searcher(len(one.ids), *one.by_term(), weights, k), "item int, score long, doc_id long")
        doc_id = F.nullif("doc_id", F.lit(NONE))
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        best = found.withColumn("rank", place).where(F.col("rank") <= k)
        names = docs.sparkSession.createDataFrame(list(enumerate(one.ids)), f"item int, item_id {key}")
        best = best.join(names, "item").select("item_id", "rank", doc_id.alias("doc_id"), "score")
        out = best if out is None else out.unionByName(best)
    return out


def _searcher(n_items: int, items: np.ndarray, starts: np.ndarray, weights: np.ndarray, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        best = Best(n_items, k)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                best.add(scores_of(batch, n_items, items, starts, weights), batch.column("ids").to_pylist())
        of, scores, ids = best.documents()
        yield pa.RecordBatch.from_pydict({"item": pa.array(of, pa.int32()), "score": pa.array(scores), "doc_id": pa.array(ids)})

    return search


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of every item of ``benchmark``."""
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = {
    "op13_ranked_search": r"""WITH texts AS (SELECT row_number() OVER () AS place, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  cut AS (SELECT place, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM texts),
  sizes AS (SELECT place, doc_id, len(terms) AS n FROM cut WHERE len(terms) > 0), totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
  counts AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM cut) GROUP BY ALL), holding AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
  items AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  weighed AS (SELECT item_id, text, items.term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM items JOIN holding ON holding.term = items.term, totals),
  scored AS (SELECT item_id, text, doc_id, s.place, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length)))) AS BIGINT) AS score
    FROM weighed JOIN counts ON counts.term = weighed.term JOIN sizes s ON s.place = counts.place, totals GROUP BY ALL),
  ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST, place) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
  SELECT * FROM ranked WHERE rank <= 10"""
}
