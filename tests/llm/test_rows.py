"""Tables with null and repeated ids, through the dedup stages of the pipeline and op3."""

import hashlib

import pytest

import corpus_pipeline as P
from pulsegrid.llm import exact_dedup, queries

A, B, C, D, E = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
ROWS = [(1, A), (1, A), (1, B), (2, A), (2, C), (3, B), (None, D), (None, D), (None, E), (4, "  ".join(C.split())), (5, A + " tail")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def bag(df):
    return sorted(((r.doc_id, " ".join(r.text.split())) for r in df.collect()), key=repr)


def test_exact_copies(spark, docs):
    want = sorted([(1, A), (1, B), (2, C), (None, D), (None, E), (5, A + " tail")], key=repr)
    assert bag(P.without_copies(spark, docs, "")) == want


def test_near_copies(spark, docs):
    want = sorted([(1, A), (1, B), (2, C), (None, D), (None, E)], key=repr)
    assert bag(P.without_near_copies(spark, docs, "")) == want
    assert bag(P.without_near_copies(spark, P.without_copies(spark, docs, ""), "")) == want


def test_op3(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_exact_dedup(spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(" ".join(t.split()).encode()).hexdigest()
    low, size = {}, {}
    for i, t in ROWS:
        if i is not None:
            h = sha(t)
            low[h], size[h] = min(low.get(h, i), i), size.get(h, 0) + 1
    want = [(i, i if i is None else low[sha(t)], 1 if i is None else size[sha(t)], i is None or i == low[sha(t)], sha(t)) for i, t in ROWS]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
