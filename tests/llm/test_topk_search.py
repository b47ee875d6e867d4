"""Exact top-k search against scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.llm import queries, topk_search

SCHEMA = "vec_id long, embedding array<double>, query_id long, score string, row int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 0, "s", 1, 1) for i, x in rows], SCHEMA)


def slow(rows, k, by):
    whole = [[max(-(2**63), min(2**63 - 1, math.floor(256 * v))) for v in x] if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x) else None for i, x in rows]
    out = []
    for n, (i, _) in enumerate(rows):
        if whole[n] is None or i % by:
            continue
        scores = [(sum(a * b for a, b in zip(whole[n], whole[m], strict=True)), j) for m, (j, _) in enumerate(rows) if m != n and whole[m] is not None and len(whole[m]) == len(whole[n])]
        scores = sorted((-max(-(2**63), min(2**63 - 1, s)), j) for s, j in scores)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def vectors(n, d, seed, integers=False):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    made = [[rng.choice((-0.5, 0, 0.25, 1.0)) if integers else c + rng.gauss(0, 0.6) for c in rng.choice(centres)] for _ in range(n)]
    for i in range(0, n, 3):  # a third of all are one vector
        made[i] = made[0]
    return [(i, [v / 4 for v in x]) for i, x in enumerate(made)]


@pytest.mark.parametrize(("block", "queries_", "stripe", "few"), [(2048, 1024, 4, 1 / 16), (16, 8, 2, 1 / 16), (16, 8, 3, 0), (1, 3, 1, 0)])
def test_best_of_all_pairs(spark, monkeypatch, block, queries_, stripe, few):
    for name, v in (("BLOCK", block), ("QUERIES", queries_), ("STRIPE", stripe), ("FEW", few)):
        monkeypatch.setattr(topk_search, name, v)
    for k, (n, d, integers) in enumerate([(150, 12, False), (150, 3, True), (90, 24, True)]):
        rows = vectors(n, d, k, integers)
        got = topk_search.top_k(frame(spark, rows).repartition(3), F.col("vec_id") % 10 == 0)
        assert sorted(map(tuple, got.collect())) == slow(rows, 5, 10)


def test_odd_vectors(spark):
    """Nulls, non-finite and huge numbers, lengths, shared and null ids, fewer candidates than asked for."""
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (10, [0.0, 0.0]), (20, None), (30, [nan, 1.0]), (40, [inf, 1.0]), (50, [1.0, None]), (None, [1.0, 1.0]), (60, [1e30, -1e300]), (7, [-1e300, 3e17]),
            (70, []), (80, []), (1, []), (90, [1.0]), (100, [1.0, 2.0, 3.0]), (3, [0.5, 0.5, 1 / 3]), (-10, [5.0, -5.0])]
    got = topk_search.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == slow(rows, 5, 10)
    assert topk_search.top_k(frame(spark, rows).limit(0), F.lit(True)).count() == 0
    assert topk_search.top_k(frame(spark, rows), F.lit(None).cast("boolean")).count() == 0


def test_reading_stops_before_the_lists_end(monkeypatch):
    """With bounds known from earlier blocks, half of each list is enough to rule out most vectors, and what is left holds all of the best."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 64))
    x = np.floor(32 * (centres[rng.integers(0, 20, 4000)] + 0.5 * rng.standard_normal((4000, 64))))
    q, none = x[:40], (np.zeros(0, np.int64),) * 2
    exact = q @ x.T
    kth = np.sort(exact, axis=1)[:, -5]
    monkeypatch.setattr(topk_search, "READ", (1 / 2,))
    i, j = topk_search.contenders(q, x, none, kth.copy(), 5)
    assert len(set(i)) == 40  # every query stopped there
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    assert found >= set(zip(*(v.tolist() for v in np.nonzero(exact >= kth[:, None])), strict=True))
    assert len(found) < 40 * 4000 / 16


def test_query_is_its_sql(spark):
    import duckdb

    found = queries.op12_topk_search(spark, "/root/testdata/sf0.01")
    duckdb.sql("CREATE OR REPLACE VIEW embeddings AS FROM '/root/testdata/sf0.01/embeddings.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(duckdb.sql(queries.oracle_sql()["op12_topk_search"]).fetchall())
