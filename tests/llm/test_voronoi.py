from __future__ import annotations

import math

import numpy as np
import pytest

from clientela.llm import queries, voronoi

SF = "/root/testdata/sf0.01"


def brute_force(rows, step=20, k=20):
    usable = {}
    for own, vector in rows:
        if own is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            usable.setdefault((own, tuple(vector)), [int(math.floor(64 * x)) for x in vector])
    items = [(own, v) for (own, _), v in usable.items()]
    out = []
    for query in sorted({own for own, _ in items if own % step == 0}):
        scores = {(other, sum(a * b for a, b in zip(q, v))) for own, q in items if own == query for other, v in items if other != query}
        best = sorted(scores, key=lambda s: (-s[1], s[0]))[:k]
        out += [(query, rank, other, score) for rank, (other, score) in enumerate(best, 1)]
    return out


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.fixture
def make_vectors(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cell int, v int")


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found(queries.op10_voronoi_top_k(spark, SF)) == brute_force(rows)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_cells_blocks_and_ties(make_vectors, monkeypatch, spread):
    monkeypatch.setattr(voronoi, "ROWS_PER_PIVOT", 40)
    monkeypatch.setattr(voronoi, "DATA_BLOCK", 30)
    monkeypatch.setattr(voronoi, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (6, 8))
    vectors = [centres[rng.integers(6)] + spread * rng.normal(0, 1, 8) for _ in range(500)] + [[0.5] * 8] * 150
    rows = [(int(own), [float(np.float32(x)) for x in v]) for own, v in zip(rng.permutation(len(vectors)), vectors)]
    assert found(voronoi.top_k(make_vectors(rows))) == brute_force(rows)


def test_edge_cases(make_vectors):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -0.01]), (0, [1.0, -0.01]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [inf, 1.0]), (None, [1.0, 1.0]),
        (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [1.0]), (4, []), (-20, [0.5, 0.25, 4.0]), (100, [0.0, 0.0]),
    ]
    assert found(voronoi.top_k(make_vectors(rows))) == brute_force(rows)
    assert voronoi.top_k(make_vectors([])).collect() == [] and voronoi.top_k(make_vectors([(20, None)])).collect() == []
    assert voronoi.top_k(make_vectors([(20, [1.0])])).collect() == []


def test_large_components_are_exact(make_vectors):
    rows = [(0, [2.0**40, 3.0]), (1, [2.0**40, 1.0]), (2, [2.0**40, -1.0]), (3, [-(2.0**100), 0.0])]
    result = found(voronoi.top_k(make_vectors(rows)))
    exact = brute_force(rows)
    held = [(q, r, v, max(-(2**63), min(2**63 - 1, s))) for q, r, v, s in exact]
    assert {(v, s) for *_, v, s in result} == {(v, s) for *_, v, s in held}


@pytest.mark.parametrize("copies", [0, 100])
def test_one_id_holds_a_third_of_all_rows(make_vectors, monkeypatch, copies):
    monkeypatch.setattr(voronoi, "ROWS_PER_PIVOT", 40)
    rng = np.random.default_rng(2)
    own = rng.normal(0, 0.01, (100, 3)) + [100, 0, 0]
    others = rng.normal(0, 1, (200, 3))
    rows = [(0, [float(np.float32(x)) for x in v]) for v in own] + [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(others, 1)]
    rows += [(1000, [2.0, 0.0, k / 64]) for k in range(copies)]  # the same score with a query on the first axis
    rows += [(2000, [50.0, 0.0, 0.0])]
    assert found(voronoi.top_k(make_vectors(rows))) == brute_force(rows)


def test_equal_scores_of_an_id_do_not_push_out_others(make_vectors):
    rows = [(0, [1.0, 0.0])] + [(1, [2.0, float(k)]) for k in range(40)] + [(k, [1.0, 0.0]) for k in range(2, 15)]
    assert found(voronoi.top_k(make_vectors(rows))) == brute_force(rows)
