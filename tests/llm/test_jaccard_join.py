from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings as hypothesis_settings, strategies as st

from clientela.llm import queries, texts
from clientela.llm.components import connected_components
from clientela.llm.jaccard_join import jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(FOLD))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_force(rows):
    """{row number: (set size, component, links)} by comparing all pairs that share a shingle."""
    sets = [shingles(text) for _, text in rows]
    holders = defaultdict(list)
    for k, one in enumerate(sets):
        for shingle in one:
            holders[shingle].append(k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    partners = defaultdict(set)
    for k, one in enumerate(sets):
        shared = Counter(other for shingle in one for other in holders[shingle])
        for other, both in shared.items():
            if other != k and 100 * both >= 75 * (len(one) + len(sets[other]) - both):
                root[find(k)] = find(other)
                if sets[other] != one:
                    partners[k].add(sets[other])
    least = {}
    for k, (own, _) in enumerate(rows):
        least[find(k)] = min(own, least.get(find(k), own))
    return sorted((rows[k][0], len(sets[k]), least[find(k)], len(partners[k])) for k in range(len(rows)))


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect())


def test_query_equals_brute_force_on_all_documents(spark, corpus):
    result = queries.op1_ngram_jaccard_join(spark, "/root/testdata/sf0.001")
    assert found(result) == brute_force([(own, text) for own, text, _ in corpus])


def family(rng, words, copies, edits):
    out = []
    for _ in range(copies):
        text = list(words)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("chunk", [200, 20_000])
def test_families_of_copies_in_chunks(make_docs, chunk):
    rng = random.Random(chunk)
    texts_ = []
    for size, copies, edits in ((60, 60, 6), (12, 25, 2), (5, 10, 1), (200, 8, 10)):
        texts_ += family(rng, [f"v{rng.randrange(3000)}" for _ in range(size)], copies, edits)
    passage = " ".join(f"p{k}" for k in range(30))
    texts_ += [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(40)) for _ in range(30)]
    texts_ += [texts_[0]] * 20
    rng.shuffle(texts_)
    rows = [(1000 - k, text) for k, text in enumerate(texts_)]
    assert found(jaccard_components(make_docs(rows), chunk_shingles=chunk)) == brute_force(rows)


def test_threshold_is_exact(make_docs):
    base = [f"w{k}" for k in range(25)]  # 21 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:-3])), (3, " ".join(base + ["x1", "x2", "x3"])), (4, " ".join(base[:-5]))]
    assert found(jaccard_components(make_docs(rows))) == brute_force(rows)


def test_edge_cases(make_docs):
    long = " ".join(f"z{k}" for k in range(30_000))
    rows = [(5, None), (6, ""), (7, " \n\t "), (8, "One two"), (9, "one\vTWO"), (9, "one two"), (10, "a b c d e"), (11, "A b c D e"), (12, long), (13, long + " end")]
    result = found(jaccard_components(make_docs(rows)))
    assert result == brute_force(rows)
    assert [r for r in result if r[0] in (5, 6, 7)] == [(5, 0, 5, 0), (6, 0, 6, 0), (7, 0, 7, 0)]


def test_null_id_and_empty_table(make_docs):
    rows = jaccard_components(make_docs([(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in rows) == [(0, 2, None), (2, 2, 2), (3, 2, 2)]
    assert jaccard_components(make_docs()).collect() == []


@hypothesis_settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té漢", max_size=30), max_size=8))
def test_shingle_sets_match_the_definition(rows):
    import pyarrow as pa

    counts = {}
    for first, last, text, _ in texts.shingle_sets(texts.as_strings(pa.array(rows, pa.string()))):
        counts |= {first + k: int((text == k).sum()) for k in range(last - first)}
    assert counts == {k: len(shingles(row)) for k, row in enumerate(rows)}


def test_slices_do_not_change_hashes(monkeypatch):
    import pyarrow as pa

    rows = pa.array(["the quick brown fox jumps over", "", "the quick brown fox jumps over the dog", "x"])
    whole = [h for *_, h in texts.shingle_sets(texts.as_strings(rows))]
    monkeypatch.setattr(texts, "slices", lambda offsets, most=0: ((k, k + 1) for k in range(len(offsets) - 1)))
    parts = [h for *_, h in texts.shingle_sets(texts.as_strings(rows))]
    assert np.array_equal(np.concatenate(whole), np.concatenate(parts))


def test_components_of_a_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(200, 201), (201, 201), (None, 5)], "a long, b long")
    rows = {r.node: r.root for r in connected_components(edges).collect()}
    assert rows == {**{k: 0 for k in range(n + 1)}, 200: 200, 201: 200}


def test_workers_hold_and_send_bounded_parts():
    import tracemalloc

    import pyarrow as pa

    from clientela.llm import jaccard_join

    rng = np.random.default_rng(3)
    rows = [" ".join(map(str, rng.integers(10**6, size=2000).tolist())) for _ in range(560)]  # 1.1 million shingles, dealt in two parts
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 280)), pa.array(rows[k : k + 280])], names=["doc_id", "text"]) for k in (0, 280)]
    del rows
    tracemalloc.start()
    most = sent = 0
    for batch in jaccard_join._dealt(5, 8)(iter(batches)):
        most, sent = max(most, batch.nbytes), sent + sum(len(h) // 6 for h in batch.column(1).to_pylist())
    dealt = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == 560 * 1996
    assert dealt < 64e6 and most < 4e6, (dealt, most)


def test_shared_shingles_are_sent_in_bounded_parts():
    import pyarrow as pa

    from clientela.llm import jaccard_join

    n, nodes = 30_000, range(1, 13)
    h = np.arange(n, dtype="<u8")
    six = h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    rows = [{"bucket": 0, "h": six, "times": np.array([n], np.uint16).tobytes(), "node": np.array([k], np.uint64).tobytes(), "n": np.array([n], np.uint32).tobytes()} for k in nodes]
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("h", "times", "node", "n"))])
    out = list(jaccard_join._shared(16)(iter([pa.RecordBatch.from_pylist(rows, schema)])))
    sent = [[len(x) // 8 for x in batch.column(1).to_pylist()] for batch in out]
    assert len(sent) > 1 and all(sum(part) <= jaccard_join.SENT_SHINGLES or len(part) == 1 for part in sent), sent
    node, got = (np.concatenate([np.frombuffer(x, np.uint64) for batch in out for x in batch.column(c).to_pylist()]) for c in (1, 3))
    assert len(node) == n * len(nodes) and all(np.array_equal(np.sort(got[node == k]), h) for k in nodes)
