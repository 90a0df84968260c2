import random

import pytest
from pyspark.sql import functions as F

from clientela.operators import ordered
from clientela.operators.ordered import At, Bracket, bracket, keys_at, log_bin, rows_after, rows_between, sketch, values_at, with_global_order
from conftest import local_frame

KINDS = "id string, value bigint"


def rows(seed, n, hot):
    rng = random.Random(seed)
    return [(f"c{i:04d}", 7 if rng.random() < hot else rng.randint(-50, 1000)) for i in range(n)]


def falling(data):
    """By value, largest first and none last, then id."""
    return sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), (r[0] is not None, r[0] or "")))


@pytest.mark.parametrize("task_rows", [1_000_000, 20])
@pytest.mark.parametrize("n,hot", [(0, 0), (1, 0), (300, 0.0), (300, 0.7)])
def test_positions_and_running_totals(spark, monkeypatch, n, hot, task_rows):
    monkeypatch.setattr(ordered, "TASK_ROWS", task_rows)
    data = rows(n, n, hot) + ([("none", None)] if n else [])
    df = local_frame(spark, data, KINDS)
    with_order = with_global_order(df, "value", ["id"], {"running": "value"})
    assert with_order.columns == ["id", "value", "position", "running", "running_total"]
    expected, total = [], 0
    for position, (i, value) in enumerate(falling(data), 1):
        total += value or 0
        expected.append((i, value, position, total, sum(v or 0 for _, v in data)))
    got = sorted(map(tuple, with_order.collect()), key=lambda r: r[2])
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert [r[3:] for r in got if r[1] is not None] == [r[3:] for r in expected if r[1] is not None]


def test_hot_values_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 50)
    df = local_frame(spark, rows(1, 600, 0.8), KINDS)
    stored = df.selectExpr("*", "value IS NULL AS _blank", "-value AS _less", f"{log_bin('-value')} AS _bin")
    parts = stored.withColumn("part", ordered._parts(stored, ["_blank", "_less", "id"])).groupBy("_bin", "part").count()
    assert parts.agg(F.max("count")).first()[0] < 150 < stored.groupBy("_bin").count().agg(F.max("count")).first()[0]


def test_bins_never_fall(spark):
    rng = random.Random(2)
    values = {0, 1, -1, 2**62, -(2**62), 2**63 - 1, -(2**63) + 1} | {s * (1 << k) + d for k in range(62) for s in (1, -1) for d in (-1, 0, 1)}
    values |= {rng.randint(-(10**9), 10**9) for _ in range(2000)} | set(range(-300, 300))
    found = sorted(map(tuple, local_frame(spark, [(v,) for v in values], "v bigint").selectExpr("v", f"{log_bin('v')} AS b").collect()))
    bins = [b for _, b in found]
    assert bins == sorted(bins)
    by_bin = {}
    for v, b in found:
        by_bin.setdefault(b, []).append(v)
    assert all((max(vs) - min(vs)) * 900 <= max(abs(vs[0]), abs(vs[-1])) for vs in by_bin.values())


@pytest.mark.parametrize("task_rows,sample", [(1_000_000, 4096), (10, 30)])
@pytest.mark.parametrize("first,last", [(0, 5), (17, 60), (295, 340), (0, 1), (500, 510)])
def test_rows_between_positions(spark, monkeypatch, first, last, task_rows, sample):
    monkeypatch.setattr(ordered, "TASK_ROWS", task_rows)
    monkeypatch.setattr(ordered, "SAMPLE", sample)
    data = rows(5, 300, 0.6)
    data += data[:20] + [("x", None), (None, 3), (None, None)]
    found = rows_between(local_frame(spark, data, KINDS), "value", ["id"], first, last).collect()
    assert [tuple(r) for r in found] == falling(data)[first:last]


def test_rows_after_a_key(spark):
    data = rows(6, 60, 0.5)
    data += data[:10] * 3 + [("x", None), ("x", None)]
    df, expected = local_frame(spark, data, KINDS), falling(data)
    for at in range(0, len(expected), 7):
        shown = sum(r == expected[at] for r in expected[: at + 1])
        i, value = expected[at]
        assert [tuple(r) for r in rows_after(df, "value", ["id"], (value, i), shown, 9).collect()] == expected[at + 1 : at + 10]
    assert [tuple(r) for r in rows_after(df, "value", ["id"], None, 0, 9).collect()] == expected[:9]


@pytest.mark.parametrize("low,high,n", [(0, 0, 3), (-5, 20_000, 500), (10**12, 10**12 + 10**9, 300), (1, 3, 200)])
@pytest.mark.parametrize("off", [0, 10_000_000])
def test_values_at_positions(spark, low, high, n, off):
    rng = random.Random(n)
    values = [rng.randint(low, high) for _ in range(n)]
    df = local_frame(spark, [(str(k), v) for k, v in enumerate(values)], KINDS)
    ranked = sorted(values)
    limits = ranked[0], ranked[-1]
    # intervals that hold the values, and intervals that hold none of them
    wanted = {p: (max(limits[0], ranked[p] - 3 + off), min(limits[1], ranked[p] + 5 + off), n) if not off else (limits[1], limits[1], 0) for p in (0, n // 3, n // 2, n - 1)}
    expected = {p: At(ranked[p], sum(v < ranked[p] for v in values), values.count(ranked[p])) for p in wanted}
    twice = values_at(df, {"value": wanted, "value * 2": {0: (2 * limits[0], 2 * limits[1], n)}}, {"value": limits, "value * 2": (2 * limits[0], 2 * limits[1])})
    assert twice == {"value": expected, "value * 2": {0: At(2 * ranked[0], 0, values.count(ranked[0]))}}


def test_sketched_brackets_hold_the_quartiles(spark):
    rng = random.Random(9)
    values = [int(rng.lognormvariate(10, 2)) for _ in range(30_000)]
    df, ranked = spark.createDataFrame([(v,) for v in values], "value bigint"), sorted(values)
    found = df.selectExpr(f"{sketch('value', [0.25, 0.5])} AS s").first()["s"]
    for k, q in enumerate((0.25, 0.5)):
        low, high, _ = bracket(found, k, len(values), 0, max(values))
        assert low <= ranked[int(q * len(values))] <= high and sum(low <= v <= high for v in values) < 300
    assert bracket(found, 0, 20, 1, 9) == (1, 9, 20)


@pytest.mark.parametrize("sample", [4096, 25])
@pytest.mark.parametrize("hot", [0.0, 0.8])
def test_keys_at_positions(spark, monkeypatch, hot, sample):
    monkeypatch.setattr(ordered, "SAMPLE", sample)
    data = rows(11, 400, hot) + [("copy", 5)] * 90 + [(None, 7)]
    df = local_frame(spark, data, KINDS)
    ranked = sorted(((v, i) for i, v in data), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    wanted = [0, 1, 49, 200, 399, len(data) - 1]
    found = keys_at(df, ["value", "id"], {p: Bracket(F.lit(True), 0, len(data)) for p in wanted})
    assert found == {p: (ranked[p], ranked.index(ranked[p])) for p in wanted}
