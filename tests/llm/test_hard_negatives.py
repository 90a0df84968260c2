from __future__ import annotations

import math

import numpy as np
import pytest

from clientela.llm import hard_negatives, queries

SF = "/root/testdata/sf0.01"
LIMIT = 2**63 - 1


def brute_force(rows, step=100):
    """Python whole numbers throughout; rows are (id, vector, label)."""
    usable = {}
    for own, vector, label in rows:
        if own is None or label is None or vector is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in vector):
            continue
        usable[own, label, tuple(math.floor(256 * x) for x in vector)] = None
    out = []
    for own, label, v in usable:
        if own % step:
            continue
        scores = [(max(-LIMIT - 1, min(LIMIT, sum(a * b for a, b in zip(v, w)))), other, theirs) for other, theirs, w in usable if other != own]
        positives = sorted({(-s, other) for s, other, theirs in scores if theirs == label})[:5]
        for minus, positive in positives:
            window = sorted({(-s, other) for s, other, theirs in scores if theirs != label and -80 * minus <= 100 * s <= -100 * minus})[:5]
            out += [(own, positive, rank, other, -minus, -s) for rank, (s, other) in enumerate(window, 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.fixture
def make_vectors(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label long, key long, v int, top double".replace("top double", "top int"))


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found(queries.op13_hard_negatives(spark, SF)) == brute_force(rows)


@pytest.mark.parametrize("size", [1, 3, 70, 600, 5000])
@pytest.mark.parametrize("top", [1, 300, 2**40, 10**30])
def test_products_are_exact(size, top):
    rng = np.random.default_rng(size)
    draw = lambda rows: np.floor(rng.uniform(-1, 1, (rows, size)) * top)
    a, b = draw(4), draw(6)
    a[0], b[0], b[1] = top, top, -top
    primes, columns = hard_negatives.moduli(top, size)
    got = hard_negatives.signed_products(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes, columns)
    exact = [[max(-LIMIT - 1, min(LIMIT, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in b] for u in a]
    assert got.tolist() == exact


def test_residues_fit_float32():
    for size in (1, 64, 256, 100_000):
        primes, columns = hard_negatives.moduli(10**6, size)
        assert columns * max(p // 2 for p in primes) ** 2 < 2**24 and len(set(primes)) == len(primes)
    assert hard_negatives.moduli(2**1031, 64)[0]


def test_blocks_ties_and_labels(make_vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 8 * 8 * 30)
    monkeypatch.setattr(hard_negatives, "ANCHORS_IN_BLOCK", 4)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (5, 8))
    rows = [(int(k), [round(float(x), 1) for x in centres[k % 5] + rng.normal(0, 0.4, 8)], int(rng.integers(3))) for k in range(400)]
    rows += [(1000 + k, [0.5] * 8, k % 2) for k in range(150)]
    assert found(hard_negatives.hard_negatives(make_vectors(rows), step=20)) == brute_force(rows, 20)


def test_one_id_holds_a_third_of_all_rows(make_vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 8 * 4 * 25)
    rng = np.random.default_rng(2)
    rows = [(0, rng.normal(0, 1, 4).tolist(), int(k % 2)) for k in range(100)]
    rows += [(int(k), rng.normal(0, 1, 4).tolist(), int(k % 3)) for k in range(1, 200)]
    # an id with several vectors is an anchor with each, so equal answers of two of its vectors both stay
    assert found(hard_negatives.hard_negatives(make_vectors(rows))) == brute_force(rows)


def test_edge_cases(make_vectors):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.0], 2), (3, [0.9], 2), (4, [0.85, 0.0, 5.0], 3), (5, [0.9, 0.1], 1),
        (100, [], 1), (200, None, 1), (300, [None, 1.0], 1), (400, [nan], 2), (500, [inf], 2), (600, [1.0], None), (None, [1.0], 2), (700, [1e308], 2),
        (800, [-1.0, 0.0], 9), (900, [-0.5, -0.5], 9), (901, [0.5, 0.5], 9),
    ]
    result = found(hard_negatives.hard_negatives(make_vectors(rows)))
    assert result == brute_force(rows) and len(result) > 4
    assert hard_negatives.hard_negatives(make_vectors([])).collect() == []
    assert hard_negatives.hard_negatives(make_vectors([(1, [1.0], 1)])).collect() == []
    assert hard_negatives.hard_negatives(make_vectors([(100, [1.0], 1)])).collect() == []
    huge = [(0, [2.0**60, 3.0], 1), (1, [2.0**59, 1.0], 1), (2, [2.0**59, 0.5], 2), (3, [-(2.0**60), 1.0], 2), (4, [2.0**-8, 2.0**20], 2)]
    assert found(hard_negatives.hard_negatives(make_vectors(huge))) == brute_force(huge)
