"""Word search against brute force; nothing of questions or words may be gathered in the driver."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gleaner.operators import retrieval as R
from gleaner.operators import word_search

_RNG = np.random.default_rng(5)
_COMMON, _RARE = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(900)]


def _texts() -> list[str]:
    texts = [" ".join([*_RNG.choice(_COMMON, 6), *_RNG.choice(_RARE, int(_RNG.integers(1, 40)))]) for _ in range(260)]
    texts += [" ".join([*_RNG.choice(_COMMON, 25), *_RNG.choice(_RARE, 400)]) for _ in range(12)]     # long ones
    texts += [texts[3] + " r1 r2", texts[3], texts[3], "", "c1"]                                      # copies
    return texts


def _brute(asked: list[tuple], texts: list[tuple], k: int) -> dict:
    words = [set((t or "").split()) for _, t in texts]
    n = len(texts)
    df = {w: sum(w in s for s in words) for w in {w for _, q in asked for w in (q or "").split()}}
    weight = {w: math.log((n + 1) / (d + 1)) for w, d in df.items()}
    whole: dict = {}
    for q, text in asked:                                      # rows of one question count together
        whole.setdefault(q, []).extend(set((text or "").split()))
    out = {}
    for q, tokens in whole.items():
        total = sum(weight[w] for w in tokens)
        score = [round(sum(weight[w] for w in tokens if w in s) / total, 10) if total > 0 else 0 for s in words]
        best = sorted((j for j in range(n) if score[j] > 0), key=lambda j: (-score[j], texts[j][0]))[:k]
        out |= {(q, r + 1): (texts[j][0], pytest.approx(score[j], abs=2e-10)) for r, j in enumerate(best)}
    return out


@pytest.mark.parametrize("passes, floor_docs, long_docs", [(1, 10**9, 128), (4, 30, 8)])
def test_word_search_is_exact_and_bypasses_the_driver(spark, monkeypatch, passes, floor_docs, long_docs):
    texts = list(enumerate(_texts()))
    asked = [(None if i == 70 else i, t) for i, t in texts if i % 2 == 0 or i > 255] + [(4, "r5 r6 unknown"), (4, "c1 r5"), (5000, None), (5001, "nowhere")]
    monkeypatch.setattr(R, "FLOOR_DOCS", floor_docs)
    monkeypatch.setattr(word_search, "LONG_DOCS", long_docs)
    monkeypatch.setattr(word_search, "SCORES_PER_STEP", 2_000)
    monkeypatch.setattr(word_search, "LOOKUPS_PER_STEP", 500)
    queries = spark.createDataFrame(asked, "query_id bigint, question string")
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    gathered, collect = [], type(queries).collect

    def counted(self):
        rows = collect(self)
        gathered.append(len(rows))
        return rows

    def refuse(self, *a, **kw):
        raise AssertionError("questions must not be gathered in the driver")

    with monkeypatch.context() as m:                           # all questions' words were gathered before
        m.setattr(type(queries), "toPandas", refuse)
        m.setattr(type(queries), "toArrow", refuse)
        m.setattr(type(queries), "collect", counted)
        found = R.lexical_top_k(queries, docs, 4, passes=passes)
    assert max(gathered) < 60                                  # lengths, shards, passes; not 140 questions
    assert {(r.query_id, r.vector_rank): (r.chunk_id, r.score) for r in found.collect()} == _brute(asked, texts, 4)


def test_word_search_keeps_other_keys_and_repeated_documents(spark):
    queries = spark.createDataFrame([("a", "red green"), ("b", "blue")], "query_id string, question string")
    docs = spark.createDataFrame([("x", "red"), ("x", "red"), (None, "green red"), ("y", "blue"), ("z", "other")], "doc_id string, text string")
    rows = {(r.query_id, r.vector_rank): r.chunk_id for r in R.lexical_top_k(queries, docs, 3).collect()}
    assert rows == {("a", 1): None, ("a", 2): "x", ("a", 3): "x", ("b", 1): "y"}
