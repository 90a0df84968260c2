from __future__ import annotations

import hashlib
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings as given_settings, strategies as st

from clientela.llm import periodic_runs, queries

SF = "/root/testdata/sf0.01"


def brute_runs(words):
    """(start, end, smallest period) of every run, lag by lag over all words."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e, q) for (s, e), q in out.items())


def collapsed(words, runs):
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return [w for i, w in enumerate(words) if i not in gone]


def found(*texts):
    ids = np.array([w for text in texts for w in text], np.int64)
    starts = np.cumsum([0, *map(len, texts)])
    begin, end, period = periodic_runs.find_runs(ids, starts)
    return list(zip(begin.tolist(), end.tolist(), period.tolist()))


def expected(*texts):
    starts = np.cumsum([0, *map(len, texts)]).tolist()
    return sorted(((s + o, e + o, q) for o, text in zip(starts, texts) for s, e, q in brute_runs(text)), key=lambda r: (r[0], r[2]))


_text = st.one_of(
    st.lists(st.integers(0, 1), max_size=90),
    st.lists(st.integers(0, 30), max_size=60),
    st.builds(lambda unit, times, tail: unit * times + tail, st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 6), st.lists(st.integers(0, 9), max_size=9)),
    st.builds(lambda unit, times: (unit * 2 + [99]) * times, st.lists(st.integers(0, 2), min_size=1, max_size=20), st.integers(1, 4)),
)


@given(st.lists(_text, max_size=4))
@given_settings(max_examples=400, deadline=None)
def test_runs_equal_brute_force(texts):
    assert found(*texts) == expected(*texts)


def test_runs_of_two_words_with_few_blocks_at_once(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCKS_AT_ONCE", 16)
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 2, n).tolist() for n in (300, 200, 13, 12, 11)] + [([0, 1, 1] * 40 + [2]) * 3, [bin(i).count("1") & 1 for i in range(600)]]
    assert found(*texts) == expected(*texts)


def test_long_texts_take_near_linear_time():
    rng = np.random.default_rng(4)
    begin = time.perf_counter()
    assert found([7] * 200_000) == [(0, 200_000, 1)]
    assert found((rng.integers(0, 50, 30_000).tolist()) * 5) == [(0, 150_000, 30_000)]
    assert found(rng.integers(0, 400, 200_000).tolist()) == []
    assert time.perf_counter() - begin < 60


def by_hand(own, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(own).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words) if len(words) <= 1500 else None
    return words, runs


def test_query_equals_brute_force(spark):
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == source.keys()
    planted = 0
    for own, text in source.items():
        words, runs = by_hand(own, text)
        if runs is None:
            continue
        row = rows[own]
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
        assert (row.n_runs, row.runs_sha256) == (len(runs), hashlib.sha256(lines.encode()).hexdigest())
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
        if runs:
            s, e, q = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (s, e - s, q, 1000 * (e - s) // q)
            planted += 1
        else:
            assert (row.start, row.length, row.period, row.exponent_milli) == (None,) * 4
    assert planted > 50


def test_edge_cases(make_docs):
    texts = {
        1: None, 2: "", 3: " \t\n\x0b\x0c\r ", 4: "a " * 11, 5: "a " * 12, 6: ("x y z " * 6 + "b ") * 2, 7: "\x1c\x85 " * 30,
        8: "ab " * 40_000, 9: "é è " * 9 + "z" * 200_000, 10: "A a " * 6,
    }
    rows = [*texts.items(), (5, texts[5]), (None, texts[5])]
    result = periodic_runs.periodic_runs(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.collapsed) for r in result if r.doc_id in (5, None)) == [("5", "a"), ("5", "a"), ("None", "a")]
    for r in result:
        words = (texts[r.doc_id or 5] or "").encode().split()
        runs = [(0, 40_000, 1)] if r.doc_id == 8 else brute_runs(words)
        assert r.n_words == len(words) and [(x.start, x.start + x.length, x.period) for x in r.runs] == runs
        assert r.collapsed.encode() == b" ".join(collapsed(words, runs))
    assert {r.doc_id for r in result if not r.runs} == {1, 2, 3, 4}
    assert periodic_runs.periodic_runs(make_docs()).collect() == []


def test_rewrite_sees_ids_and_words(make_docs):
    repeat = lambda own, words: words * 12 if own else words
    rows = periodic_runs.periodic_runs(make_docs([(1, "q"), (None, "q")]), rewrite=repeat).collect()
    assert {r.doc_id: (r.n_words, r.collapsed, len(r.runs)) for r in rows} == {1: (12, "q", 1), None: (1, "q", 0)}


@pytest.mark.parametrize("words", [["w"] * 13, ["u", "v"] * 7])
def test_runs_do_not_cross_texts(words):
    ids = [hash(w) % 97 for w in words]
    assert found(ids[:6], ids[6:]) == []
