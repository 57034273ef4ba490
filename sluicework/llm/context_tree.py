"""LM scoring: context-tree weighting over bytes, beside an add-one word model.

A text is the byte string of its lower-cased words, each closed by a space, and one end byte. Each byte is eight binary
decisions; each decision node has a context tree over the up to ``DEPTH`` bytes before it in the text, earlier words and
spaces included, weighted bottom-up: Pw = 1/2 Pe + 1/2 prod Pw(children), with Pe the Krichevsky-Trofimov estimate. A context that the training
texts lack predicts as its longest suffix that they have does; no other context is left out.

Distinct byte n-grams with their counts travel chunk -> bucket -> chunk; a bucket holds whole subtrees (all contexts
that share their last ``TOP + 1`` bytes), weights them and answers with the probability of each n-gram's byte. What all
tasks receive are the contexts of at most ``TOP`` bytes, whose weights a first pass sums up from the subtrees.

Word counts travel chunk -> bucket -> chunk as 64-bit fingerprints, one per chunk and distinct word; their totals come from
the training pass. A chunk sends nothing to a bucket that it has no gram or word for.

Cases: null or empty text -> one end token; a very long text is read in one chunk, whole; no training row -> uniform bytes
and c = 0 for all tokens; repeated rows are scored alike, and so are equal texts; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import crc_mod, dictionary, give_back, hash64, in_chunks, in_order, mix64, pieces, round_trip, segment_sum, split_words, text_array

DEPTH = 6
#: Contexts of at most TOP bytes are sent to all tasks; deeper ones live in the bucket of their last TOP + 1 bytes.
TOP = 2
#: Whether a context reaches back over the start of its word.
ACROSS = True
CHUNK_BYTES, BUCKET_BYTES, PIECE, SLICE = 12 << 20, 12 << 20, 1 << 20, 1 << 18
#: Bytes whose keys are sorted at once where only their counts are asked for.
SORTED = 4 << 20
#: Distinct grams and words that a task of the training pass gathers before it sends them on.
GRAMS_HELD, WORDS_HELD = 1_000_000, 500_000
END = 10


def lowered_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    words, offsets = split_words(pc.ascii_lower(texts))
    distinct, index = dictionary(words)
    return distinct, index, offsets


def _contexts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Key of each byte of ``raw``: the bytes before it from the nearest to the farthest, then the byte itself.

    No context reaches back over one of the (sorted) ``starts``. Contexts that share a suffix share a prefix of their keys."""
    padded = np.concatenate([np.zeros(DEPTH, np.uint8), raw, np.zeros(8 - DEPTH, np.uint8)])
    # The eight bytes from the farthest one on, read as a number whose lowest byte comes first: the nearest are the highest.
    keys = np.ndarray(len(raw), "<i8", padded, strides=(1,)) & ((1 << 8 * DEPTH) - 1)
    keys <<= 8
    keys |= raw
    for k in range(DEPTH):
        # Bytes with k before them; past a short text lies the start of the next, which keeps less.
        at = starts + k
        keys[at[at < len(raw)]] &= ((1 << 8 * k) - 1) << 8 * (DEPTH - k + 1) | 255
    return keys


def byte_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The key of each byte of each word and its closing space, and the bounds of the words."""
    raw = np.frombuffer((" ".join(words) + " ").encode() if words else b"", np.uint8)
    bounds = np.concatenate([[0], np.flatnonzero(raw == 32) + 1])
    return _contexts(raw, bounds[:-1]), bounds


def text_grams(texts: pa.Array, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """The key of each byte of each text as the model reads it, and the bounds of the texts.

    With ``across`` a context reaches back to the start of the text, without it to the start of the word.
    """
    spaced = pc.binary_join_element_wise(pc.ascii_lower(texts), *(pa.scalar(x, pa.large_string()) for x in ("", " " + chr(END))))
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(spaced).to_numpy().astype(np.int64))])
    raw = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[: bounds[-1]]
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    space[bounds[1:] - 1] = False
    first = np.ones(len(raw), bool)
    first[1:] = space[:-1]
    first[bounds[:-1]] = True
    keep = ~(space & first)
    out = np.where(space, np.uint8(32), raw)[keep]
    bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(keep, bounds[:-1], dtype=np.int64))]) if len(texts) else bounds
    starts = bounds[:-1] if across else np.union1d(bounds[:-1], np.flatnonzero(out == 32) + 1)
    return _contexts(out, starts), bounds


class Sums:
    """Sorted distinct keys with the sums of their counts; what comes in waits until it outweighs what is there."""

    def __init__(self, dtype: type = np.int64):
        self.keys, self.counts = np.zeros(0, dtype), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        if sum(len(k) for k, _ in self.waiting) > len(self.keys):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            self.keys, self.counts = _summed(np.concatenate([self.keys, *(k for k, _ in self.waiting)]), np.concatenate([self.counts, *(n for _, n in self.waiting)]))
            self.waiting = []
        return self.keys, self.counts


@dataclass
class Piece:
    """A run of up to 256 texts: its distinct keys in order, how many bytes have each, the text of each byte in order of keys and the bytes of each text."""

    first: int
    last: int
    keys: np.ndarray
    times: np.ndarray
    text: np.ndarray
    coded: np.ndarray

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over the bytes of each text of what ``values`` has for their keys; a text's sum rests on no other text."""
        return np.bincount(self.text, np.repeat(values, self.times), self.last - self.first)


def gram_pieces(texts: pa.Array, across: bool):
    for a, b in ((c, min(c + 256, b)) for a, b in pieces(texts, PIECE) for c in range(a, b, 256)):
        grams, ends = text_grams(texts.slice(a, b - a), across)
        # A key has seven bytes, so the number of its text fits beside it.
        both = grams.view(np.uint64)
        both <<= np.uint64(8)
        both |= np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(ends))
        both.sort()
        keys = (both >> np.uint64(8)).view(np.int64)
        first = _firsts(keys)
        yield Piece(a, b, keys[first], np.diff(first, append=len(keys)), both.astype(np.uint8), np.diff(ends))


def gram_counts(texts: pa.Array, trained: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all texts, and how often each occurs in the ``trained`` ones."""
    sums = Sums()
    for a, b in pieces(texts, SORTED):
        grams, ends = text_grams(texts.slice(a, b - a), across)
        # A key has seven bytes, so whether its text is learned from fits beside it, and one sort without an order is enough.
        grams <<= 1
        grams |= np.repeat(trained[a:b], np.diff(ends))
        grams.sort()
        first = _firsts(grams >> 1)
        sums.add(grams[first] >> 1, np.add.reduceat(grams & 1, first) if len(first) else np.zeros(0, np.int64))
    return sums.settle()


def _firsts(values: np.ndarray) -> np.ndarray:
    """The places of sorted ``values`` that differ from the one before."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = _firsts(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), 8).T).tobytes()


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Differences of sorted keys and counts by byte planes, which compress well."""
    return _planes(np.diff(keys, prepend=np.int64(0))) + _planes(counts.astype(np.int64))


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw, np.uint8).reshape(2, 8, len(raw) // 16)
    deltas, counts = (np.ascontiguousarray(x.T).view(np.int64).reshape(-1) for x in both)
    return np.cumsum(deltas), counts


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by bucket, and the bounds of the buckets. Contexts that share their last ``TOP + 1`` bytes share a bucket."""
    bucket = (mix64((keys >> (8 * (DEPTH - TOP))).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros(len(x))
    for i in range(6):
        shift += np.log(x + i)
    z = x + 6.0
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) - shift


_SMALL = 1 << 12
_HALF, _WHOLE = _lgamma(np.arange(_SMALL) + 0.5), _lgamma(np.arange(_SMALL) + 1.0)


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones (whole numbers)."""
    n = a + b
    small = n < _SMALL
    if small.all():
        return _HALF[a] + _HALF[b] - math.log(math.pi) - _WHOLE[n]
    out, big = np.empty(len(a)), ~small
    out[small] = _HALF[a[small]] + _HALF[b[small]] - math.log(math.pi) - _WHOLE[n[small]]
    out[big] = _lgamma(a[big] + 0.5) + _lgamma(b[big] + 0.5) - math.log(math.pi) - _lgamma(n[big] + 1.0)
    return out


def _weighted(pe: np.ndarray, child: np.ndarray) -> np.ndarray:
    return np.logaddexp(pe, child) - math.log(2)


def _advance(state, kt, w, seen):
    """(p, s, r) one depth on: prediction so far, and the mixture's settled part and its rest."""
    p, s, r = state
    return np.where(seen, s + r * kt, p), np.where(seen, s + r * w * kt, s), np.where(seen, r * (1 - w), r)


class Subtrees:
    """The tree below depth ``TOP`` over sorted keys; keys of count 0 are asked for only and change nothing."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts, self.up = {DEPTH: keys}, {DEPTH: counts}, {}
        for d in range(DEPTH - 1, TOP - 1, -1):
            below = self.keys[d + 1]
            self.keys[d], self.up[d] = np.unique((below >> 16) << 8 | (below & 255), return_inverse=True)
            self.counts[d] = np.bincount(self.up[d], weights=self.counts[d + 1], minlength=len(self.keys[d])).astype(np.int64)

    def nodes(self, j: int) -> dict:
        """By depth, for the decisions of bit ``j``: (node of each key, first key of each node, a, b, pe, pw)."""
        out, child = {}, None
        for d in range(DEPTH, TOP, -1):
            keys, n = self.keys[d], self.counts[d]
            stem = keys >> (8 - j)
            new = np.concatenate([[True], stem[1:] != stem[:-1]])
            node, first = np.cumsum(new) - 1, np.flatnonzero(new)
            total, b = np.add.reduceat(n, first), np.add.reduceat(n * ((keys >> (7 - j)) & 1), first)
            pe = _estimate(total - b, b)
            if child is None:
                pw = pe
            else:
                of, value = child
                pw = _weighted(pe, np.bincount(node[self.up[d][of]], weights=value, minlength=len(first)))
            out[d], child = (node, first, total - b, b, pe, pw), (first, pw)
        return out

    def roots(self):
        """(context of TOP bytes, node, a, b, sum of pw) over the subtrees."""
        for j in range(8):
            _, first, a, b, _, pw = self.nodes(j)[TOP + 1]
            keys = self.keys[TOP + 1][first]
            yield keys >> 16, (1 << j) | (keys & 255) >> (8 - j), a, b, pw

    def log10(self, top: list) -> np.ndarray:
        """log10 of the probability of each key's byte after its context."""
        out = np.zeros(len(self.keys[DEPTH]))
        for j in range(8):
            nodes, keys = self.nodes(j), self.keys[TOP]
            state = np.full(len(keys), 0.5), np.zeros(len(keys)), np.ones(len(keys))
            for d, (known, kt, w) in enumerate(top):
                want = (keys >> (8 * (TOP - d + 1))) << 8 | (1 << j) | (keys & 255) >> (8 - j)
                if len(known):
                    at = np.minimum(np.searchsorted(known, want), len(known) - 1)
                    state = _advance(state, kt[at], w[at], known[at] == want)
            for d in range(TOP + 1, DEPTH + 1):
                node, _, a, b, pe, pw = nodes[d]
                w = np.ones(len(a)) if d == DEPTH else np.exp(pe - math.log(2) - pw)
                kt = (b + 0.5) / (a + b + 1)
                state = _advance([x[self.up[d - 1]] for x in state], kt[node], w[node], (a + b > 0)[node])
            p = np.clip(state[0], 1e-7, 1 - 1e-7)
            out += np.log10(np.where((self.keys[DEPTH] >> (7 - j)) & 1, p, 1 - p))
        return out


def _cuts(keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of about ``SLICE`` sorted keys that part no subtree."""
    if not len(keys):
        return []
    stem = keys >> (8 * (DEPTH - TOP))
    starts = np.flatnonzero(np.concatenate([[True], stem[1:] != stem[:-1]]))
    cuts = starts[np.concatenate([[True], np.diff(starts // SLICE) > 0])].tolist()
    return list(zip(cuts, [*cuts[1:], len(keys)], strict=True))


def answer(top: list, blobs: list[bytes]) -> list[np.ndarray]:
    """log10 of the probability of each key of each blob under the counts of all blobs."""
    found = [unpacked(raw) for raw in blobs]
    keys, counts = _summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))
    logs = np.zeros(len(keys), np.float32)
    for a, b in _cuts(keys):
        logs[a:b] = Subtrees(keys[a:b], counts[a:b]).log10(top)
    return [logs[np.searchsorted(keys, k)] for k, _ in found]


def word_counts(texts: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the distinct words and of the end token (the empty word), and how often each occurs in texts of weight 1."""
    distinct, index, offsets = lowered_words(texts)
    counts = np.bincount(index, weights=np.repeat(weight, np.diff(offsets)), minlength=len(distinct)) if distinct else np.zeros(0)
    return hash64([*distinct, ""]), np.append(counts, weight.sum()).astype(np.int64)


def counted(docs: DataFrame, buckets: int, across: bool) -> DataFrame:
    """(bucket, data): keys and counts of pieces of all texts of ``docs``; from ``buckets`` on, their words and counts."""
    names = ["bucket", "data"]

    def words_out(fps, counts):
        bucket = (fps % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(buckets + b, order[bounds[b] : bounds[b + 1]]) for b in range(buckets) if bounds[b + 1] > bounds[b]]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([fps[r].tobytes() + _planes(counts[r]) for _, r in rows], pa.binary())], names)

    def grams_out(keys, counts):
        order, bounds = by_bucket(keys, buckets)
        rows = [(b, order[bounds[b] : bounds[b + 1]]) for b in range(buckets) if bounds[b + 1] > bounds[b]]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([packed(keys[r], counts[r]) for _, r in rows], pa.binary())], names)

    def count(batches):
        give_back()
        grams, words = Sums(), Sums(np.uint64)
        for texts in (t.slice(a, b - a) for batch in batches for t in [text_array(batch.column(0))] for a, b in pieces(t, SORTED)):
            all_texts = np.ones(len(texts), bool)
            grams.add(*gram_counts(texts, all_texts, across))
            if len(grams.keys) > GRAMS_HELD:
                yield grams_out(*grams.settle())
                grams = Sums()
            words.add(*word_counts(texts, all_texts))
            if len(words.keys) > WORDS_HELD:
                yield words_out(*words.settle())
                words = Sums(np.uint64)
        for sums, out in ((grams, grams_out), (words, words_out)):
            if len(sums.settle()[0]):
                yield out(*sums.settle())

    return docs.select("text").mapInArrow(count, "bucket long, data binary")


def words_of_blob(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 16
    return np.frombuffer(raw, np.uint64, n), np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=8 * n).reshape(8, n).T).view(np.int64).reshape(-1)


@dataclass
class Model:
    counts: DataFrame  # (bucket, data), every context of the training texts
    top: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by depth up to TOP: context << 8 | node, its estimate, its weight
    buckets: int
    tokens: int = 0  # words and ends of the training texts, and how many of them differ
    distinct: int = 0

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's byte; the grams travel to the buckets of their contexts."""
        keys, index = np.unique(grams, return_inverse=True)
        order, bounds = by_bucket(keys, self.buckets)
        spark, top = self.counts.sparkSession, self.top
        rows = [(b, packed(k := keys[order[bounds[b] : bounds[b + 1]]], np.zeros(len(k), np.int64)), True) for b in range(self.buckets)]
        asked = spark.createDataFrame(rows, "bucket long, data binary, asked boolean")

        def met(key, table):
            blobs, mine = table["data"].to_pylist(), table["asked"].to_pylist()
            logs = answer(top, blobs)[mine.index(True)]
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([logs.tobytes()], pa.binary())})

        both = asked.unionByName(self.counts.where(F.col("bucket") < self.buckets).withColumn("asked", F.lit(False)))
        out = np.zeros(len(keys), np.float32)
        for b, raw in both.groupBy("bucket").applyInArrow(met, "bucket long, data binary").collect():
            out[order[bounds[b] : bounds[b + 1]]] = np.frombuffer(raw, np.float32)
        return out[index]


def train(docs: DataFrame, across: bool = False, buckets: int = 8) -> Model:
    """Counts of every context. ``top`` holds all contexts of at most TOP bytes: at most 256 ** TOP, whatever the input."""
    counts = counted(docs, buckets, across)
    names = ["ctx", "node", "a", "b", "pw"]

    def roots(key, table):
        give_back()
        if key[0].as_py() >= buckets:
            fps, n = zip(*map(words_of_blob, table["data"].to_pylist()), strict=True)
            _, n = _summed(np.concatenate(fps), np.concatenate(n))
            return pa.table({"ctx": [-1], "node": [0], "a": [int(n.sum())], "b": [int((n > 0).sum())], "pw": [0.0]})
        found = [unpacked(raw) for raw in table["data"].to_pylist()]
        keys, n = _summed(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))
        parts = [part for a, b in _cuts(keys) for part in Subtrees(keys[a:b], n[a:b]).roots()]
        return pa.table({name: np.concatenate([p[i] for p in parts]) for i, name in enumerate(names)})

    found = counts.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(roots, "ctx long, node long, a long, b long, pw double")
    rows = found.groupBy("ctx", "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("pw")).toArrow()
    words = rows.filter(pc.less(rows["ctx"], 0))
    tokens, distinct = (int(pc.sum(words[c]).as_py() or 0) for c in ("a", "b"))
    rows = rows.filter(pc.greater_equal(rows["ctx"], 0))
    node = (rows["ctx"].to_numpy() << 8) | rows["node"].to_numpy()
    order = np.argsort(node)
    node, a, b, child = (x[order] for x in (node, rows["a"].to_numpy(), rows["b"].to_numpy(), rows["pw"].to_numpy()))
    top = []
    for _ in range(TOP + 1):
        pe = _estimate(a, b)
        pw = _weighted(pe, child)
        top.insert(0, (node, (b + 0.5) / (a + b + 1), np.exp(pe - math.log(2) - pw)))
        node, at = np.unique((node >> 16) << 8 | (node & 255), return_inverse=True)
        a, b = (np.bincount(at, weights=x, minlength=len(node)).astype(np.int64) for x in (a, b))
        child = np.bincount(at, weights=pw, minlength=len(node))
    return Model(counts, top, buckets, tokens, distinct)


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """docs: (doc_id, text), a stored table. Rows where ``held_out`` holds are scored but not learned from."""
    docs = docs.select("doc_id", "text")
    chunks, n_chunks, total = in_chunks(docs, CHUNK_BYTES, floor=16)
    chunks = chunks.withColumn("held_out", held_out)
    buckets = max(32, math.ceil(total / BUCKET_BYTES))
    model = train(docs.where(~held_out), ACROSS, buckets)
    n_all, n_distinct = model.tokens, model.distinct
    shared = docs.sparkSession.sparkContext.broadcast(model.top)

    def words_of(table):
        distinct, index, offsets = lowered_words(text_array(table["text"]))
        fp = hash64([*distinct, ""])
        bucket = (fp % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return distinct, index, offsets, fp, order, np.searchsorted(bucket[order], np.arange(buckets + 1))

    def emit(chunk, table):
        table = in_order(table)
        distinct, index, offsets, fp, order, bounds = words_of(table)
        trained = ~table["held_out"].to_numpy(zero_copy_only=False)
        counts = np.bincount(index, weights=np.repeat(trained, np.diff(offsets)), minlength=len(distinct)) if distinct else np.zeros(0)
        counts = np.append(counts, trained.sum()).astype(np.int64)
        del distinct, index, offsets
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            rows = order[bounds[b] : bounds[b + 1]]
            yield b, fp[rows].tobytes() + _planes(counts[rows])
        keys, n = gram_counts(text_array(table["text"]), trained, ACROSS)
        order, bounds = by_bucket(keys, buckets)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            rows = order[bounds[b] : bounds[b + 1]]
            yield buckets + b, packed(keys[rows], n[rows])

    def merge(bucket, blobs):
        if bucket >= buckets:
            for (chunk, _), logs in zip(blobs, answer(shared.value, [raw for _, raw in blobs]), strict=True):
                yield chunk, logs.tobytes()
            return
        fps, counts = zip(*(words_of_blob(raw) for _, raw in blobs), strict=True)
        distinct, sums = _summed(np.concatenate(fps), np.concatenate(counts))
        for (chunk, _), mine in zip(blobs, fps, strict=True):
            yield chunk, _planes(sums[np.searchsorted(distinct, mine)])

    def finish(chunk, table, answers):
        table = in_order(table)
        distinct, index, offsets, _, order, bounds = words_of(table)
        c = np.zeros(len(distinct) + 1, np.int64)
        texts = text_array(table["text"])
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            raw = np.frombuffer(answers[b], np.uint8).reshape(8, -1)
            c[order[bounds[b] : bounds[b + 1]]] = np.ascontiguousarray(raw.T).view(np.int64).reshape(-1)
        n = np.diff(offsets)
        logs = np.log10(c + 1.0)
        base = segment_sum(logs[index], offsets) + logs[-1] - (n + 1) * math.log10(n_all + n_distinct + 1)
        known = segment_sum((c > 0)[index], offsets).astype(np.int64) + int(c[-1] > 0)
        parts = list(gram_pieces(texts, ACROSS))
        keys = np.sort(np.concatenate([np.zeros(0, np.int64), *(part.keys for part in parts)]))
        keys = keys[_firsts(keys)]
        order, bounds = by_bucket(keys, buckets)
        logp = np.zeros(len(keys), np.float32)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            logp[order[bounds[b] : bounds[b + 1]]] = np.frombuffer(answers[buckets + b], np.float32)
        total_score, coded = np.zeros(len(texts)), np.zeros(len(texts))
        for part in parts:
            total_score[part.first : part.last] = part.sums(logp[np.searchsorted(keys, part.keys)])
            coded[part.first : part.last] = part.coded
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
        columns = [
            table["doc_id"], table["held_out"], pa.array(n + 1), pa.array(known), pa.array(np.full(len(n), n_all)), pa.array(base), pa.array(total_score),
            pa.array(-total_score * math.log2(10) / np.maximum(coded, 1)),
        ]
        return pa.Table.from_arrays(columns, names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return round_trip(chunks, n_chunks, 2 * buckets, emit, merge, finish, schema)


def op6_context_tree(spark, sf_dir: str) -> DataFrame:
    """Score of every document of ``documents`` under a model of those that are not held out; bits a coded byte beside it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, crc_mod(F.col("doc_id"), 7) == 2)
