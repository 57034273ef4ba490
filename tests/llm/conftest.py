from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, node string, size long"


def words(rng, n, letters="abcdefghij"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows and clashing column names."""
    rng = random.Random(1)
    texts = [" ".join(words(rng, rng.randint(0, 120))) for _ in range(60)]
    base = words(rng, 100)
    near = []
    for _ in range(40):
        w = list(base)
        w[rng.randrange(100)] = rng.choice("xyz") * 4
        near.append(" ".join(w))
    passage = " ".join(words(rng, 20))
    texts += [texts[3], texts[3], *near, f"{texts[5]} {passage}", f"{passage}\t\n {texts[6]}", None, "", " \t\n", "one", "two words", "a b c d", "a b c d", " ".join(words(rng, 20_000)), "### 123 !!", "Ünïcode Straße ΣΑΣ \x85 x\x1cy"]
    rows = [(i, t, ["de", "en", None][i % 3], [f"src{i % 4}", None][i % 9 == 0], 1, i, "n", 5) for i, t in enumerate(texts)]
    rows += [(None, texts[8], None, None, None, None, None, None), (7, texts[7], "en", "src1", 1, 1, "n", 5), (7, "other text under the same id", "en", "src1", 1, 1, "n", 5), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
