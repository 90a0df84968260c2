from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from clientela.llm import language_model as lm
from clientela.llm import queries

SF = "/root/testdata/sf0.001"


def sentences(n, rng):
    return [" ".join(f"{rng.choice(['red', 'blue'])} {rng.choice(['cat', 'dog'])} runs home" for _ in range(30)) for _ in range(n)]


def test_query_scores_every_document(spark, corpus):
    rows = queries.op6_lm_scoring(spark, SF).collect()
    assert sorted((r.doc_id, r.n_words) for r in rows) == sorted((own, len(text.split())) for own, text, _ in corpus)
    assert all(r.log_likelihood <= 0 for r in rows)


def test_order_matters_after_training(make_docs):
    rng = random.Random(0)
    docs = sentences(120, rng)
    model = lm.train(make_docs(list(enumerate(docs))).coalesce(1), rounds=6, stride=2)
    held_out = sentences(1, random.Random(9))[0]
    words = held_out.split()
    rng.shuffle(words)
    rows = lm.score(make_docs([(1, held_out), (2, " ".join(words)), (3, "unseen words only here")]), model).collect()
    mean = {r.doc_id: r.mean_log for r in rows}
    assert mean[1] > mean[2] + 0.5 and mean[1] > mean[3] + 0.5 and mean[1] > -1.5


def test_scores_equal_the_definition(make_docs):
    model = lm.train(make_docs([(1, "a b c a b c a b d"), (2, "b c a")]))
    network = lm.Network(model.weights)
    text = "a b c d a x"
    _, _, words, around, _ = next(iter(lm._windows(pa.array([text]), model.vocabulary)))
    total = 0.0
    for t, word in enumerate(words):
        state = network.hidden.astype(float)
        for k, place in enumerate(lm.PLACES):
            there = words[t + place] if 0 <= t + place < len(words) else model.vocabulary.size
            assert around[k, t] == there
            state = state + network.places[k][there]
        state = np.append(np.tanh(state), 1)
        for logits, choice in ((state @ network.classes, word // lm.CLASS_SIZE), (state @ network.words[word // lm.CLASS_SIZE], word % lm.CLASS_SIZE)):
            total += logits[choice] - np.log(np.exp(logits).sum())
    (row,) = lm.score(make_docs([(5, text)]), model).collect()
    assert abs(row.log_likelihood - total) < 1e-3 and row.n_words == 6


def test_gradient_points_uphill():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 40, 64).astype(np.int32)
    around = rng.integers(0, 40, (4, 64)).astype(np.int32)
    network, power = lm.Network(), lm.Network(np.zeros_like(lm.Network().flat))
    before = network.log_probabilities(around, words).sum()
    for _ in range(30):
        network.train_step(around, words, power, 0.05)
    assert network.log_probabilities(around, words).sum() > before + 30


def test_edge_cases(make_docs):
    model = lm.train(make_docs([(1, None), (2, ""), (3, "one word")]))
    rows = [(1, None), (2, " \n"), (None, "one"), (4, "w " * 50_000), (4, "w"), (5, "One ONE")]
    found = sorted((r.doc_id or 0, r.n_words, r.mean_log is None) for r in lm.score(make_docs(rows), model).collect())
    assert found == [(0, 1, False), (1, 0, True), (2, 0, True), (4, 1, False), (4, 50_000, False), (5, 2, False)]
    empty = lm.train(make_docs())
    assert lm.score(make_docs(), empty).collect() == [] and len(lm.score(make_docs([(1, "a b")]), empty).collect()) == 1


def test_training_does_not_depend_on_order_of_sums(make_docs):
    docs = make_docs([(k, f"a b c {k % 5} d e f") for k in range(40)]).repartition(4, "doc_id")
    assert np.array_equal(lm.train(docs).weights, lm.train(docs).weights)


def test_every_word_is_a_target_with_the_defaults(make_docs, monkeypatch):
    model = lm.train(make_docs([(1, "a b c d e f g h i")]))
    column = pa.array(["a b c d e f g h i", "a", "b c", "", "d e f"])
    seen = []
    monkeypatch.setattr(lm.Network, "train_step", lambda self, around, words, power, rate: seen.extend(words.tolist()))

    class Sent:
        value = model.weights

    for turn in range(lm.ROUNDS):
        list(lm._train(model.vocabulary, Sent, turn % lm.STRIDE, lm.STRIDE)([pa.RecordBatch.from_arrays([column], names=["text"])]))
    words = np.concatenate([w for _, _, w, _, _ in lm._windows(column, model.vocabulary)])
    assert sorted(seen) == sorted(words.tolist())


def test_learns_with_the_defaults(make_docs):
    """What always stands at the third or fourth place of four is learned as well."""
    docs = ["red cat runs home " * 200 for _ in range(40)]
    model = lm.train(make_docs(list(enumerate(docs))).coalesce(1))
    rows = lm.score(make_docs([(1, "red cat runs home " * 5), (2, "home red runs cat " * 5)]), model).collect()
    mean = {r.doc_id: r.mean_log for r in rows}
    network = lm.Network(model.weights)
    _, _, words, around, _ = next(iter(lm._windows(pa.array(["red cat runs home " * 5]), model.vocabulary)))
    logs = network.log_probabilities(around, words)[4:-4]
    assert mean[1] > mean[2] + 0.5 and all(logs[k::4].mean() > -0.5 for k in range(4))


def zipf_docs(rng, n=60):
    return [" ".join(f"w{k}" for k in rng.choices(range(5000), [1 / (k + 1) for k in range(5000)], k=300)) for _ in range(n)]


def test_words_beyond_the_vocabulary_are_predicted_by_their_counts(make_docs):
    docs = zipf_docs(random.Random(4))
    model = lm.train(make_docs(list(enumerate(docs))))
    counts = Counter(" ".join(docs).split())
    hashed = {w: int(lm.texts.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hashes[0]) for w in [*counts, "zzqx"]}
    beyond = {w for w in counts if hashed[w] not in set(model.vocabulary.hashes.tolist())}
    assert len(beyond) > 500
    totals = Counter()
    for w in beyond:
        totals[hashed[w] % 32] += counts[w]
    words = [max(beyond, key=counts.get), min(beyond, key=counts.get), "zzqx"]
    rows = {r.doc_id: r.log_likelihood for r in lm.score(make_docs(list(enumerate(words))), model).collect()}
    network = lm.Network(model.weights)
    for k, w in enumerate(words):
        _, _, ids, around, _ = next(iter(lm._windows(pa.array([w]), model.vocabulary)))
        share = counts.get(w, 0.5) / (totals[hashed[w] % 32] + 0.5)
        assert abs(rows[k] - float(network.log_probabilities(around, ids)[0]) - math.log(share)) < 1e-4


def test_joined_counts_equal_sent_ones(make_docs, monkeypatch):
    docs = zipf_docs(random.Random(5))
    table = make_docs([*enumerate(docs), (None, docs[0]), (3, docs[3]), (99, "new zzqx zzqx w1"), (100, None)])
    training = make_docs(list(enumerate(docs)))
    sent = lm.train(training)
    monkeypatch.setattr(lm, "SENT_WORDS", len(sent.shares.hashes) - 1)
    joined = lm.train(training)
    assert sent.shares.complete and not joined.shares.complete and 0 < len(joined.shares.hashes) < lm.SENT_WORDS
    want, got = (sorted((r.doc_id or -1, r.n_words, r.log_likelihood) for r in lm.score(table, m).collect()) for m in (sent, joined))
    assert len(want) == 64 and np.allclose(np.array(want, float), np.array(got, float), atol=1e-6)


def test_classes_grow_with_the_vocabulary(make_docs, monkeypatch):
    monkeypatch.setattr(lm, "ROOT_PER_CLASS", 1)
    docs = [" ".join(f"w{k}" for k in range(a, a + 250)) for a in range(0, 5000, 250)]
    model = lm.train(make_docs(list(enumerate(docs))))
    assert model.vocabulary.classes == 70 and len(model.vocabulary.hashes) == 69 * lm.CLASS_SIZE
    assert len(lm.Network(model.weights).words) == 70 and lm.score(make_docs([(1, docs[0])]), model).first().log_likelihood < 0


def test_hashes_are_found_among_sorted_ones():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 3000):
        known = np.unique(np.r_[rng.integers(0, 2**64 - 1, n, np.uint64), np.arange(min(n, 7), dtype=np.uint64), np.full(min(n, 1), 2**64 - 1, np.uint64)])
        sought = rng.permutation(np.r_[known, known, rng.integers(0, 2**64 - 1, 500, np.uint64), np.array([3, 2**64 - 1], np.uint64)])
        found, at = lm.Places(known).find(sought)
        assert sorted(found.tolist()) == np.flatnonzero(np.isin(sought, known)).tolist() and np.array_equal(known[at], sought[found])


def definition_of_a_step(network, power, around, words, rate):
    """A step in doubles, word by word."""
    get = lambda n: {k: np.array(getattr(n, k), float) for k in ("places", "hidden", "classes", "words")}
    weights, squares = get(network), get(power)
    grads = {k: np.zeros_like(v) for k, v in weights.items()}
    for t, word in enumerate(words):
        h = np.tanh(weights["hidden"] + sum(weights["places"][k][around[k, t]] for k in range(len(lm.PLACES))))
        state, back = np.append(h, 1), np.zeros(lm.HIDDEN + 1)
        for name, table, choice in (("classes", weights["classes"], word // lm.CLASS_SIZE), ("words", weights["words"][word // lm.CLASS_SIZE], word % lm.CLASS_SIZE)):
            out = np.exp(state @ table)
            error = -out / out.sum()
            error[choice] += 1
            back += table @ error
            (grads[name] if name == "classes" else grads[name][word // lm.CLASS_SIZE])[...] += np.outer(state, error) / len(words)
        inner = back[:-1] * (1 - h**2) / len(words)
        grads["hidden"] += inner
        for k in range(len(lm.PLACES)):
            grads["places"][k][around[k, t]] += inner
    for k, grad in grads.items():
        squares[k] += grad**2
        weights[k] += rate * grad / (np.sqrt(squares[k]) + 1e-6)
    return weights, squares


def test_a_step_equals_the_definition():
    """Few classes of many as well as most; ids that repeat and the place beyond a text's edge; views stay the weights themselves."""
    rng = np.random.default_rng(8)
    for classes, n, most in ((32, 300, 1024), (80, 40, 2560), (32, 1, 5)):
        network = lm.Network(classes=classes)
        power = lm.Network(rng.random(network.flat.size).astype(np.float32) * 1e-4)
        words = rng.integers(0, most, n).astype(np.int32)
        around = rng.integers(0, most, (len(lm.PLACES), n)).astype(np.int32)
        around[0, ::3] = network.places.shape[1] - 1
        weights, squares = definition_of_a_step(network, power, around, words, 0.1)
        network.train_step(around, words, power, 0.1)
        for k in weights:
            assert np.allclose(getattr(network, k), weights[k], atol=1e-4) and np.allclose(getattr(power, k), squares[k], rtol=1e-3, atol=1e-7)
        assert np.array_equal(lm.Network(network.flat).log_probabilities(around, words), network.log_probabilities(around, words))


def test_a_step_keeps_to_few_calls_for_each_class():
    """Products of a class go through the views made once, whole rows at a time, not through a slice of the weights each time."""
    network = lm.Network()
    assert all(m.base is not None and np.shares_memory(m, network.flat) and m.flags.c_contiguous for m in network.matrices)
    assert len(network.matrices) == len(network.turned) == len(network.words)


def test_a_task_adds_up_the_counts_of_its_batches(make_docs, monkeypatch):
    batches = [pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]) for texts in (["a b a", None], [""], ["b c", "A"], ["d"])]
    kept = {}
    frame = make_docs([(1, "a")])
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema, g=type(frame).mapInArrow: kept.setdefault("count", f) and g(self, f, schema))
    lm.count_words(frame)
    for most, parts in ((100, 1), (0, 3)):
        monkeypatch.setattr(lm, "COUNTED_AT_ONCE", most)
        out = list(kept["count"](iter(batches)))
        total = Counter()
        for batch in out:
            assert len(set(batch["word"].to_pylist())) == len(batch)
            total.update(dict(zip(batch["word"].to_pylist(), batch["times"].to_pylist())))
        assert len(out) == parts and sorted(total.values()) == [1, 1, 2, 3] and list(kept["count"](iter([]))) == []
