"""The stages against plain Python on a small table."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sluicework.llm import language_id, mixing, near_copies, secrets
from sluicework.llm.common import saved
from sluicework.llm.tokens import default_tokenizer
from tests.llm.test_search import plain_classes

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        after = saved(f(spark, docs, SF))
        out.append((docs, after))
        docs = after
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "packing"]
    assert all(a.columns == b.columns for a, b in stages[:-1])


def test_language_keeps_clean_documents(stages):
    before, after = stages[0]
    assert after.count() >= 0.97 * before.count()


def test_one_document_of_each_group(stages):
    before, after = (x.select("doc_id", "text").toPandas() for x in stages[1])
    root, _ = plain_classes(list(before.itertuples(index=False, name=None)))
    first = before.assign(root=root).groupby("root").doc_id.min()
    assert sorted(first) == sorted(after.doc_id)


def test_secrets_are_masked(stages):
    before, after = (x.select("doc_id", "text").toPandas().set_index("doc_id").text for x in stages[2])
    import re

    assert sorted(before.index) == sorted(after.index)
    want = before.map(lambda t: re.sub(r'(?<=token = ")[0-9a-f]{40}(?=")|(?<=password=)[0-9a-f]{18}|AKIA[A-Z2-7]{16}', secrets.MASK, t))
    assert (want == after.loc[before.index]).all() and (before != want).any()


def test_mix_and_pack(stages):
    before, after = (x.select("doc_id", "source", "text").toPandas() for x in stages[3])
    copies = after.doc_id.value_counts()
    assert copies.max() <= 2 and set(after.doc_id) <= set(before.doc_id)
    pieces = stages[4][1].toPandas()
    t = Tokenizer.from_file(default_tokenizer())
    ids = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for d, x in before[["doc_id", "text"]].itertuples(index=False)}
    assert pieces.length.sum() == sum(len(ids[d]) * n for d, n in copies.items())
    assert all(zlib.crc32(ids[d][a : a + n].tobytes()) == c for d, a, n, c in pieces[["doc_id", "start", "length", "ids_crc32"]].itertuples(index=False))
    fill = pieces.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and (2048 - fill).sum() < 0.05 * fill.sum()


def test_odd_columns_stay(spark):
    """Names with a backtick or a dot, and maps at any depth, pass through every stage that keeps columns."""
    rows = [(i, f"{' '.join(f'w{i % 7}x{k}' for k in range(20))}", "en", "s", {"b": [{"y": i}], "a": None}, (None if i == 3 else {i: "v"},), i) for i in range(12)] + [(12, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `m``p` map<string, array<map<string, int>>>, s struct<`in.ner`: map<int, string>>, `a.b` long")
    want = {r.doc_id: r.asDict(recursive=True) for r in docs.collect()}
    mixed = mixing.mix(docs).select("row.*")
    assert mixed.columns == docs.columns and [f.dataType.simpleString() for f in mixed.schema] == [f.dataType.simpleString() for f in docs.schema]
    assert {r.doc_id: r.asDict(recursive=True) for r in mixed.collect()} == want
    assert {r.doc_id: r.asDict(recursive=True) for r in secrets.redact(docs).collect()} == want
    kept = near_copies.drop_near_copies(docs)
    assert {r.doc_id: r.asDict(recursive=True) for r in kept.collect()} == {i: want[i] for i in (*range(7), 12)}
    plain = docs.drop("s")
    named = language_id.identify(plain, language_id.train(plain))
    assert named.columns == [*plain.columns, "lang_pred", "lang_score"]
    assert {r.doc_id: r["m`p"] for r in named.collect()} == {i: x["m`p"] for i, x in want.items()}
