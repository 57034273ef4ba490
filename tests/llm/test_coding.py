"""BPE by trees, periodic runs and ranked search against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluicework.llm import bpe_tree, periodic, ranking
from sluicework.llm.tokens import default_tokenizer
from tests.compare import duck, normal

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
ALPHABETS = ["ab", "a", "theinanrsto", "äöüaβγ日本語é", "!?-_.", "ing", "Ωσς´'st0"]
LONG_WORDS = st.lists(st.tuples(st.sampled_from(ALPHABETS), st.integers(1, 90), st.randoms(use_true_random=False)), min_size=1, max_size=4)


def spelled(parts):
    return "".join("".join(r.choice(letters) for _ in range(n)) for letters, n, r in parts)


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def trees():
    return {leaf: bpe_tree.TreeEncoder(default_tokenizer(), leaf) for leaf in (1, 8, 100)}


@settings(max_examples=300, deadline=None)
@given(LONG_WORDS, st.sampled_from([1, 8, 100]), st.sampled_from(["", "<|endoftext|>", "'s", "12"]))
def test_trees_of_any_leaf_give_the_ids_of_the_library(trees, whole, parts, leaf, inside):
    text = spelled(parts) + inside + spelled(parts)
    assert trees[leaf].text_ids(text) == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(LONG_WORDS, st.integers(1, 50))
def test_units_of_a_text_join_to_its_ids(trees, whole, parts, block):
    tree, text, out, waiting = trees[8], spelled(parts) + " and <|startoftext|>" + spelled(parts[::-1]), [], []
    for kind, unit in tree.units(text, block):
        ids = tree.unit_ids(kind, unit)
        if kind in (bpe_tree.OPEN, bpe_tree.CLOSE):
            waiting.append(ids)
            ids = []
            if kind == bpe_tree.CLOSE:
                ids, waiting = tree.concatenated(waiting), []
        out += ids
    assert out == whole.encode(text, add_special_tokens=False).ids


def test_a_long_word_is_encoded_by_windows(whole):
    rng = random.Random(5)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(300_000))
    tree = bpe_tree.TreeEncoder(default_tokenizer())
    encoded = []
    leaf_ids = tree.leaf_ids
    tree.leaf_ids = lambda letters, last: encoded.append(len(letters)) or leaf_ids(letters, last)
    assert tree.text_ids(word) == whole.encode(word, add_special_tokens=False).ids
    # Joins encode little besides the leaves.
    assert len(word) <= sum(encoded) < 1.2 * len(word) and max(encoded) <= bpe_tree.LEAF


def test_other_tokenizers_are_encoded_exactly():
    path = default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k")
    tree, library, rng = bpe_tree.TreeEncoder(path, 8), Tokenizer.from_file(path), random.Random(3)
    assert tree.joins and not tree.by_word
    for _ in range(200):
        text = "".join(rng.choice("ab the\n 1!é") for _ in range(rng.randint(0, 150)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert tree.text_ids(text) == ids
        assert bpe_tree.Decoder(path).decode(np.array(ids, np.uint32), np.array([0, len(ids)])).to_pylist() == [library.decode(ids, skip_special_tokens=False)]


def test_every_word_of_the_table_has_the_library_s_ids(spark, whole):
    """The short way to the ids of plain words is the library's own for each of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = [r[0] for r in docs.select(F.explode(F.split("text", r"\s+")).alias("w")).distinct().collect() if r[0]]
    tree = bpe_tree.TreeEncoder(default_tokenizer())
    assert len(words) > 1000
    for w, blob in zip(words, tree._blobs(words), strict=True):
        assert np.frombuffer(blob, np.uint32).tolist() == whole.encode(w, add_special_tokens=False).ids, w


@pytest.mark.parametrize("limits", [(bpe_tree.LONG, bpe_tree.BLOCK), (20, 7)])
def test_encode_and_decode(spark, docs, rows, whole, limits):
    got = collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe_tree.encode_and_decode(docs, default_tokenizer(), *limits).collect())
    want = []
    for d, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        want.append((d, tuple(ids), whole.decode(ids, skip_special_tokens=False)))
    assert got == collections.Counter(want)
    apart = bpe_tree.decode(bpe_tree.encode(docs, default_tokenizer(), *limits), default_tokenizer())
    assert collections.Counter((r.doc_id, r.decoded) for r in apart.collect()) == collections.Counter((d, t) for d, _, t in want)


def test_decode_of_odd_ids(spark, whole):
    rows = spark.createDataFrame([(1, [5, 99_999, None, 49407]), (2, []), (3, None)], "`a``b` long, ids array<int>")
    got = {r[0]: r.decoded for r in bpe_tree.decode(rows, default_tokenizer()).collect()}
    assert got == {1: whole.decode([5, 49407], skip_special_tokens=False), 2: "", 3: None}


def test_op11_digests(spark, sf_dir, whole, empty):
    assert bpe_tree.encode_and_decode(empty, default_tokenizer()).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe_tree.op11_bpe_tree(spark, sf_dir).collect():
        ids = whole.encode(texts.pop(r.doc_id) or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False)))
    assert not texts


def slow_runs(w):
    """Every maximal stretch of every period, the smallest period of each tried out."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if length >= max(6, 4 * q) and min(p for p in range(1, q + 1) if all(w[x] == w[x - p] for x in range(s + p, s + length))) == q:
                out.add((s, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


PARTS = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=25), st.integers(1, 9)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=4))
def test_runs_of_any_words(parts):
    texts = [[w for base, times in p for w in base * times] for p in parts]
    offsets = np.cumsum([0, *map(len, texts)])
    got = periodic.find_runs(np.array([w for t in texts for w in t], np.int64), offsets)
    assert [tuple(r) for r in got.tolist()] == [(s + o, n, q) for t, o in zip(texts, offsets, strict=False) for s, n, q in slow_runs(t)]


def test_runs_of_a_long_text_of_one_word_take_no_square_of_it():
    words = np.zeros(1_000_000, np.int64)
    assert periodic.find_runs(words, np.array([0, 1_000_000])).tolist() == [[0, 1_000_000, 1]]
    cycle = np.tile(np.arange(100_000), 5)
    assert periodic.find_runs(cycle, np.array([0, len(cycle)])).tolist() == [[0, 500_000, 100_000]]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plant(doc_id, words):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digests(doc_id, words):
    found = slow_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None, None, None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_documents(spark, docs, rows, empty):
    periods = [" ".join(["x"] * 7), "a b c " * 5, "one two a b a b a b a b a b three", " ".join(str(i % 30) for i in range(200))]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(periods)], "doc_id long, text string"))
    got = periodic.runs(more).collect()
    want = [(d, split(t)) for d, t in [*rows, *((900 + i, t) for i, t in enumerate(periods))] if len(split(t)) < 5000]
    runs = collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got if r.n_words < 5000)
    assert runs == collections.Counter((*(x := (d, len(w), tuple(slow_runs(w)))), " ".join(w[i] for i in range(len(w)) if all(not s + q <= i < s + n for s, n, q in x[2]))) for d, w in want)
    assert sum(len(r.runs) for r in got) >= 4 and len(got) == len(rows) + 4 and periodic.runs(empty).count() == 0


def test_op12_digests(spark, sf_dir):
    texts = [(r.doc_id, plant(r.doc_id, split(r.text))) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r) for r in periodic.op12_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for d, words in texts:
        if len(words) < 1500:
            assert got[d] == digests(d, words)
    assert sum(r[1] for r in got.values()) > 10


def test_planting_of_every_kind_of_text(spark, docs, rows):
    got = collections.Counter((r.doc_id, tuple(split(r.t))) for r in docs.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("t")).collect())
    assert got == collections.Counter((d, tuple(plant(d, split(t)))) for d, t in rows)


def slow_terms(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def slow_rank(docs, items, k):
    cut = [(d, collections.Counter(w), len(w)) for d, t in docs if (w := slow_terms(t))]
    n, length = len(cut), sum(c for _, _, c in cut)
    df = collections.Counter(w for _, tf, _ in cut for w in tf)
    out = []
    for item, text in set(items):
        scored = []
        for d, tf, c in cut:
            m = 100 - 90 + 90 * c * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m)) for w in set(slow_terms(text)) if w in tf)
            scored += [(-s, d is None, d or 0)] if s > 0 else []
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:k])]
    return collections.Counter(out)


ITEMS = [(1, "aaa BBB bcd, fgh fgh"), (2, ""), (3, None), (None, "one two words"), (5, "Ünïcode straße 123 x"), (6, "a b c d e"), (6, "a b c d e"), (6, "two"), (7, "q" * 300)]


@pytest.fixture(scope="module")
def more(docs, spark):
    rng = random.Random(9)
    items = [*ITEMS, *((100 + i, " ".join(r.text.split()[:12])) for i, r in enumerate(docs.where("length(text) between 20 and 2000").limit(25).collect()))]
    texts = [(3000 + i, " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(5))) for i in range(200)] + [(4000, "q" * 300 + " one"), (4001, "Q" * 300), (4002, "q" * 299)]
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string")).repartition(5).cache(), items


@pytest.mark.parametrize("k", [1, 3, 10])
def test_ranking(spark, more, k):
    docs, items = more
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    got = ranking.rank(docs.withColumn("item_id", F.lit(1)), table, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == slow_rank([(r.doc_id, r.text) for r in docs.collect()], items, k)


def test_ranking_in_blocks_of_items(spark, more, monkeypatch):
    docs, items = more
    monkeypatch.setattr(ranking, "ROWS", 16)
    monkeypatch.setattr(ranking.item_blocks, "__defaults__", (30, 5))
    table = spark.createDataFrame(items, "item_id long, text string")
    assert len(ranking.item_blocks(table)) > 5
    assert collections.Counter(map(tuple, ranking.rank(docs, table, 4).collect())) == slow_rank([(r.doc_id, r.text) for r in docs.collect()], items, 4)


def test_ranking_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.rank(empty, items).count() == 0 and ranking.rank(docs, items.limit(0)).count() == 0


def test_equal_bags_are_scored_once(spark):
    docs = spark.createDataFrame([(i, f"apple pear {'xyz'[i % 3] * 3}") for i in range(3000)], "doc_id long, text string").repartition(8)
    items = ranking.Items([1], ranking.text_array(ranking.pa.array(["pear, apple"])))
    found, n = ranking.classes(ranking.bags(docs, items, 10), 10)
    assert n == 3000 and [(r.docs, r.ids) for r in found.collect()] == [(3000, list(range(10)))]


def test_op13_equals_sql(spark, sf_dir):
    ours = ranking.op13_ranked_search(spark, sf_dir).toPandas()
    theirs = duck(sf_dir).sql(ranking.ORACLE_SQL["op13_ranked_search"]).df()
    assert normal(ours) == normal(theirs) and len(ours) > 100
