"""N-gram Jaccard join: MinHash LSH forest with sorted prefix tries, then exact verification.

1. Each text becomes its set of five-word shingles (all its words, if fewer) and a MinHash signature. Texts of equal sets
   are one node from here on.
2. ``TREES`` tries hold the signatures as sorted strings of ``DEPTH`` hashes, no hash in two tries. Nodes are matched on the
   whole string first; then the matched prefix is shortened hash by hash, until a pair at the threshold shares it in some
   trie with probability ``RECALL``. In a map task, and then once more over all tasks, a node that is close to a leader by
   signature is linked to it, at the longest prefix they share; only leaders go on to shorter prefixes and to other tasks,
   so a prefix that a third of all rows share sends a few rows a task. Links are made at a distance that also covers what a
   leader stands for, hence no pair is lost to the grouping (the Jaccard distance obeys the triangle inequality).
   Signatures only estimate that distance: links are made up to ``NOISE`` beyond it, over seven standard errors of the
   estimate for a pair at the threshold.
3. Linked nodes form candidate clusters (connected components, in Spark). Each text of a cluster is read once and all
   pairs of a cluster are verified exactly, as products of sparse incidence blocks; clusters above ``CELL`` nodes or
   ``CELL_BYTES`` of text are cut into pairs of blocks that run apart. What comes back is a number of links and one root for
   each node and cell, never a pair.

The result is one row per document: class_id (smallest id of the component of verified links), n_links (different
shingle sets at or above the threshold) and n_copies (other documents of the same set).

Cases: null text, or text without a word, is in a class of its own with no link; a very long text is one set like any
other and is read whole; a null id counts as larger than any id; of documents that tie for the head of a class the one with
the smaller text hash stands for it; repeated rows share a class; an empty table gives no row; extra columns, whatever
their names, are ignored by ``near_copies`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import dictionary, give_back, hash64, mix64, pieces, quoted, saved, split_words, text_array
from sluicework.llm.graph import components, sorted_groups
from sluicework.llm.repeats import prefix_hashes, window_starts

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.998
HASHES = TREES * DEPTH
#: Nodes and bytes of text of a verification block; bytes of text that are signed at once.
CELL, CELL_BYTES, PIECE = 1000, 12 << 20, 6 << 20
#: Hashes of a signature that estimate a distance, a byte of each; what an estimate may be off.
MARKS, NOISE = 80, 0.15
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
#: The hashes of each trie, in the order of its strings. The tries share no hash, so they are independent.
_PICK = np.arange(HASHES).reshape(DEPTH, TREES).T


def prefix_length(threshold: float = THRESHOLD, target: float = RECALL) -> int:
    """Shorten the prefix until a pair at the threshold meets in some trie with the target probability."""
    k = DEPTH
    while k > 1 and 1 - (1 - threshold**k) ** TREES < target:
        k -= 1
    return k


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and each text's offsets."""
    words, offsets = split_words(texts)
    distinct, index = dictionary(words)
    h = hash64(distinct)[index] if distinct else np.zeros(0, np.uint64)
    starts, doc = window_starts(offsets, n)
    values = prefix_hashes(h, starts, n)
    lengths = np.diff(offsets)
    for m in range(1, n):
        short = np.flatnonzero(lengths == m)
        values = np.concatenate([values, prefix_hashes(h, offsets[short], m) ^ np.uint64(m)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[keep], doc[keep]
    return values, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, offsets: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """texts x hashes minima, of the non-empty sets."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, hashes), np.uint32)
    for i in range(hashes if len(full) else 0):
        out[full, i] = np.minimum.reduceat(((values * _A[i] + _B[i]) >> np.uint64(32)).astype(np.uint32), offsets[full])
    return out


def _sign(batches):
    names = ["doc_id", "th", "size", "node", "signature"]
    give_back()
    for batch in batches:
        texts = text_array(batch.column(1))
        for a, b in pieces(texts, PIECE):
            values, offsets = shingle_sets(texts.slice(a, b - a))
            sig = signatures(values, offsets)
            raw = values.tobytes()
            node = [xxhash.xxh3_128_digest(raw[8 * s : 8 * e]) if e > s else None for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            blobs = [x.tobytes() if k else None for x, k in zip(sig, node, strict=True)]
            size = pc.binary_length(texts.slice(a, b - a)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), size, pa.array(node, pa.binary()), pa.array(blobs, pa.binary())], names)


def _agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity from signatures of one byte a hash."""
    return np.maximum((many == one).mean(1) - 1 / 256, 0) / (1 - 1 / 256)


class Joined:
    """Union-find over what one task has linked: of all links that connect the same nodes, a spanning forest goes out."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def add(self, a: bytes, b: bytes) -> bool:
        """True if the link joins what was apart."""
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _lead(nodes: list[bytes], marks: np.ndarray, wide: np.ndarray, threshold: float, joined: Joined):
    """Links (node, leader) and the indices of the leaders; ``wide`` leaders stand for others and becomes so here."""
    far = 1 - threshold
    leaders, links = np.zeros(0, np.int64), []
    for i in range(len(nodes)):
        if len(leaders):
            near = _agreement(marks[i], marks[leaders])
            reach = far * (1 + wide[i] + 1)  # a leader may come to stand for others
            hit = leaders[near >= 1 - reach - NOISE]
            links += [(nodes[i], nodes[j]) for j in hit.tolist() if joined.add(nodes[i], nodes[j])]
            close = leaders[near >= threshold]
            if len(close) and not wide[i]:
                wide[close[0]] = True
                continue
        leaders = np.append(leaders, i)
    return links, leaders


def shorten(strings: np.ndarray, order: np.ndarray, stop: int, nodes: list[bytes], marks: np.ndarray, wide: np.ndarray, threshold: float, joined: Joined):
    """Links found while the matched prefix of a sorted trie goes from whole strings to ``stop`` hashes, and the rows that still lead.

    ``order`` sorts the rows of ``strings``, so rows that share a prefix are neighbours at every length."""
    links = []
    for level in range(strings.shape[1], stop - 1, -1):
        s = strings[order, :level]
        same = (s[1:] == s[:-1]).all(1)
        starts = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(order)))
        stay = np.ones(len(order), bool)
        for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            group = order[a : a + n]
            own = wide[group]
            found, leaders = _lead([nodes[j] for j in group], marks[group], own, threshold, joined)
            wide[group] = own
            links += found
            stay[a : a + n] = False
            stay[a + leaders] = True
        order = order[stay]
    return links, order


def candidate_links(nodes: DataFrame, threshold: float, prefix: int) -> DataFrame:
    """(a, b) from (node, signature)."""
    schema = "key long, deep binary, node binary, mark binary, wide boolean, other binary"
    names = ["key", "deep", "node", "mark", "wide", "other"]

    def rows(keys, deep, nodes, marks, wide, others):
        values = [pa.array(keys, pa.int64()), pa.array(deep, pa.binary()), pa.array(nodes, pa.binary()), pa.array(marks, pa.binary()), pa.array(wide, pa.bool_()), pa.array(others, pa.binary())]
        return pa.RecordBatch.from_arrays(values, names)

    def combine(batches):
        for batch in batches:
            names_, sig = batch.column(0).to_pylist(), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            marks = sig[:, :MARKS].astype(np.uint8)
            links, joined = [], Joined()
            for t in range(TREES):
                strings, wide = sig[:, _PICK[t]], np.zeros(len(sig), bool)
                found, on = shorten(strings, np.lexsort(strings.T[::-1]), prefix, names_, marks, wide, threshold, joined)
                links += found
                key = np.full(len(on), t + 1, np.uint64)
                for i in range(prefix):
                    key = mix64(key ^ strings[on, i])
                deep = [x.tobytes() for x in strings[on, prefix:].astype(">u2")]
                yield rows(key.view(np.int64), deep, [names_[j] for j in on], [marks[j].tobytes() for j in on], wide[on], [None] * len(on))
            if links:
                a, b = zip(*links, strict=True)
                yield rows(np.frombuffer(b"".join(x[:8] for x in a), np.int64), [None] * len(a), a, [None] * len(a), [False] * len(a), b)

    def meet(batches):
        give_back()
        joined = Joined()
        for group in sorted_groups(batches, 1):
            if group.num_rows < 2 and group["mark"].null_count == 0:
                continue
            linked = group.filter(pc.is_null(group["mark"]))
            links = [(a, b) for a, b in zip(linked["node"].to_pylist(), linked["other"].to_pylist(), strict=True) if joined.add(a, b)]
            lead = group.filter(pc.is_valid(group["mark"]))
            if lead.num_rows > 1:
                marks = np.frombuffer(b"".join(lead["mark"].to_pylist()), np.uint8).reshape(-1, MARKS)
                # What is left of the strings after the prefix that all rows of the group share.
                deep = np.frombuffer(b"".join(lead["deep"].to_pylist()), ">u2").reshape(lead.num_rows, -1)
                links += shorten(deep, np.arange(lead.num_rows), 0, lead["node"].to_pylist(), marks, lead["wide"].to_numpy().copy(), threshold, joined)[0]
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    sent = nodes.select("node", "signature").mapInArrow(combine, schema).repartition("key").sortWithinPartitions("key", "deep")
    return sent.mapInArrow(meet, "a binary, b binary")


def intersections(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sizes of all pairwise intersections of the sets, as a product of incidence blocks."""
    m = len(offsets) - 1
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), np.diff(offsets))
    shared = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    row, column = row[shared], rank[column[shared]]
    out = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = max(256, min(8192, (1 << 22) // max(m, 1)))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        block = np.zeros((m, step), np.float32)
        block[row[lo:hi], column[lo:hi] - a] = 1
        out += block @ block.T
    return out


def verify_cell(nodes: list[bytes], sides: np.ndarray, texts: pa.Array, one_block: bool, threshold: float):
    """For each node of a cell its verified links and the smallest node that it reaches inside the cell."""
    values, offsets = shingle_sets(texts)
    both = intersections(values, offsets)
    n = np.diff(offsets).astype(np.float64)
    linked = both >= threshold * (n[:, None] + n[None] - both) - 1e-6
    np.fill_diagonal(linked, False)
    if not one_block:
        linked &= sides[:, None] != sides[None]
    root = np.arange(len(nodes))
    order = np.argsort(np.array([int.from_bytes(x, "big") for x in nodes], object), kind="stable")
    todo = np.ones(len(nodes), bool)
    for i in order.tolist():  # smallest first, so it is the root of all it reaches
        if not todo[i]:
            continue
        front = np.array([i])
        todo[i] = False
        while len(front):
            root[front] = i
            front = np.flatnonzero(linked[front].any(0) & todo)
            todo[front] = False
    return linked.sum(1), [nodes[r] for r in root]


def near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, th, class_id, class_th, n_links, n_copies); th is xxhash64 of the text.

    (class_id, class_th) names the document that stands for the class: smallest id, then th.
    """
    prefix = prefix_length(threshold)
    signed = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).mapInArrow(_sign, "doc_id long, th long, size long, node binary, signature binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th"))
    nodes = signed.where(F.col("node").isNotNull()).groupBy("node").agg(first.alias("of"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("signature").alias("signature"))
    nodes = saved(nodes)
    clusters = components(candidate_links(nodes, threshold, prefix).distinct())
    member = clusters.join(nodes.select("node", "of", "size"), "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / CELL, F.sum("size") / CELL_BYTES))
    member = member.join(member.groupBy("root").agg(blocks.cast("int").alias("g")), "root").select(
        "node", F.col("root").alias("cluster"), "g", F.col("of.doc_id").alias("doc_id"), F.col("of.th").alias("th")
    )
    own = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("t"))
    read = member.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("t"))).withColumn("side", own)
    cells = read.select(
        "cluster", F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.least(F.col("side"), j) * F.col("g") + F.greatest(F.col("side"), j))).alias("cell"),
        "g", "side", "node", "text",
    ).repartition("cluster", "cell").sortWithinPartitions("cluster", "cell", "node")

    def verify(batches):
        give_back()
        for group in sorted_groups(batches, 2):
            # Repeated rows of the document that stands for a node come more than once.
            names = group["node"].to_pylist()
            once = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            if len(once) < 2:
                continue
            group = group.take(once)
            cell, g = group["cell"][0].as_py(), group["g"][0].as_py()
            links, root = verify_cell(group["node"].to_pylist(), group["side"].to_numpy(), text_array(group["text"]), cell // g == cell % g, threshold)
            yield pa.RecordBatch.from_arrays([group["node"].combine_chunks(), pa.array(root, pa.binary()), pa.array(links.astype(np.int64))], ["node", "root", "links"])

    verified = saved(cells.mapInArrow(verify, "node binary, root binary, links long"))
    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = nodes.select("node", "of", "n").join(roots, "node", "left").join(links, "node", "left").select(
        "node", "of", "n", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    heads = labelled.groupBy("root").agg(F.min("of").alias("head"))
    labelled = labelled.join(heads, "root").select("node", "head", "n", "n_links")
    out = signed.select("doc_id", "th", "node").join(labelled, "node", "left")
    alone = F.col("head").isNull()
    return out.select(
        "doc_id", "th", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), F.when(alone, F.col("th")).otherwise(F.col("head.th")).alias("class_th"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_copies"),
    )


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, one row for each class; texts without words stay."""
    keep = near_copies(docs, threshold).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th")))
    keep = keep.select(F.col("doc_id").alias("keep_id"), F.col("th").alias("keep_th")).distinct()
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    marked = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"))
    kept = marked.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("t") == F.col("keep_th")), "left_semi")
    return kept.dropDuplicates(["id", "t"]).select("row.*")


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document of ``documents``."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_copies")


#: All pairs of sets that share a shingle: exact, so the join is compared with it on a small table only.
ORACLE_SQL = {
    "op2_jaccard_join": r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
starts AS (
  SELECT r, i, n, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM words),
sets AS (SELECT DISTINCT r, s FROM starts WHERE i = 1 OR i + 4 <= n),
keyed AS MATERIALIZED (SELECT r, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM sets GROUP BY r),
nodes AS MATERIALIZED (SELECT k, min(r) AS r, count(*) AS n, min(doc_id) AS first FROM keyed JOIN d USING (r) GROUP BY k),
shingles AS MATERIALIZED (SELECT k, s, count(*) OVER (PARTITION BY k) AS size FROM nodes JOIN sets USING (r)),
links AS MATERIALIZED (
  SELECT a.k AS a, b.k AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.k <> b.k
  GROUP BY a.k, b.k, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-6),
reach(k, root) AS (SELECT k, k FROM nodes UNION SELECT b, root FROM reach JOIN links ON a = reach.k),
classes AS (SELECT reach.k, min(first) AS class_id FROM reach JOIN nodes ON nodes.k = root GROUP BY reach.k),
degree AS (SELECT a AS k, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, CASE WHEN k IS NULL THEN doc_id ELSE class_id END AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n - 1, 0) AS n_copies
FROM d LEFT JOIN keyed USING (r) LEFT JOIN (SELECT k, n FROM nodes) USING (k) LEFT JOIN classes USING (k) LEFT JOIN degree USING (k)"""
}
