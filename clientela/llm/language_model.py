"""Masked pseudo-likelihood: every word is predicted from the words on both sides, and the logs are added up.

The network sums one table row per place of the window, applies tanh, and predicts the word in two steps,
its class and then the word within it. Classes grow with the root of the counted words; a word beyond them
is predicted as its hash class, and then by its exact share of that class in the corpus. It is trained in numpy by all tasks at once, each on its own
documents from common weights; after each round their weights are averaged, by number of words. All rounds together take every word as a target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.llm import texts
from clientela.llm.tables import ship, shuffle_partitions, stored

#: Classes at least; beyond these, one for so many of the root of the number of different words.
CLASSES = 32
ROOT_PER_CLASS = 16
CLASS_SIZE = 32
HIDDEN = 32
PLACES = (-2, -1, 1, 2)
#: As many rounds as strides: every word of every text is a target once.
STRIDE = 2
ROUNDS = STRIDE
#: Steps grow with the words a task has seen, from the first size to the last: what is learned at the start needs many,
#: and later ones cost less by the word. Held-out mean logs with steps of 512, 2,048 and 4,096 throughout: -4.717, -4.718, -4.724.
STEP_WORDS = 512
LONGEST_STEP = 2048
SEEN_PER_STEP_WORD = 32
RATE = 0.1
SCORED_AT_ONCE = 4096
#: So many words at a time are held against all classes: what this makes stays in the cache.
CACHED = 512
#: Texts are cut into words in runs of so many bytes, which stay in the cache.
SLICE_BYTES = 1 << 18
#: A task adds up its batches' counts as long as they are about so many.
COUNTED_AT_ONCE = 1 << 20
#: Counts of at most so many words are sent to every task; those of all others are joined.
SENT_WORDS = 1 << 18
#: An unseen word counts as so many occurrences of its hash class.
UNSEEN = 0.5
_PART = 1 << 14
_FIXED_POINT = 2.0**20
#: Weights of each class, and those besides.
_PER_CLASS = len(PLACES) * CLASS_SIZE * HIDDEN + (HIDDEN + 1) * (1 + CLASS_SIZE)
_FIXED = (len(PLACES) + 1) * HIDDEN


class Places:
    """Where a hash stands among sorted ones: by its leading bits, then a few comparisons; hashes are evenly spread."""

    def __init__(self, hashes: np.ndarray):
        bits = max(4, min(22, len(hashes).bit_length() + 4))
        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.searchsorted(hashes, edges).astype(np.int32)
        self.most = int(np.diff(np.r_[self.first, len(hashes)]).max())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these occur (places in ``hashes``), and where each stands."""
        at, here = self.first[(hashes >> self.shift).view(np.int64)], np.arange(len(hashes))
        found, places = [here[:0]], [at[:0]]
        for _ in range(self.most):
            inside = at < len(self.hashes)
            at, here = at[inside], here[inside]
            theirs, sought = self.hashes[at], hashes[here]
            same, later = theirs == sought, theirs < sought
            found.append(here[same])
            places.append(at[same])
            at, here = at[later] + 1, here[later]
        return np.concatenate(found), np.concatenate(places)


@dataclass
class Vocabulary:
    """Hashes of the most frequent words, sorted, with their ids by rank; all other words share the last class."""

    hashes: np.ndarray
    ids: np.ndarray
    classes: int = CLASSES

    @property
    def size(self) -> int:
        return self.classes * CLASS_SIZE

    @property
    def rest(self) -> int:
        """The first id of the last class."""
        return self.size - CLASS_SIZE

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        rest = (self.rest + (hashes % np.uint64(CLASS_SIZE)).astype(np.int64)).astype(np.int32)
        found, at = self.places.find(hashes)
        rest[found] = self.ids[at]
        return rest

    @cached_property
    def places(self) -> Places:
        return Places(self.hashes)


@dataclass
class Shares:
    """Counts of words (sorted hashes, logarithms), occurrences in each hash class, and whether these are all counted words."""

    hashes: np.ndarray
    logs: np.ndarray
    totals: np.ndarray
    complete: bool

    def within(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithm of each word's share of its hash class, less that of its count where the count is not known here; and where so."""
        out = -np.log(self.totals + UNSEEN)[(hashes % np.uint64(CLASS_SIZE)).astype(np.int64)]
        known = np.zeros(len(hashes), bool)
        found, at = self.places.find(hashes)
        known[found] = True
        out[found] += self.logs[at]
        if self.complete:
            out[~known] += math.log(UNSEEN)
            known[:] = True
        return out, ~known

    @cached_property
    def places(self) -> Places:
        return Places(self.hashes)


def count_words(source: DataFrame) -> DataFrame:
    """word (hash), times: all words of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            data, offsets = texts.flat(texts.as_strings(batch.column(0)))
            parts = [texts.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).hashes for a, b in texts.slices(offsets, SLICE_BYTES)]
            held.append(np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_counts=True))
            if sum(len(words) for words, _ in held) > COUNTED_AT_ONCE:
                yield _added_up(held)
                held = []
        if held:
            yield _added_up(held)

    counted = source.select("text").mapInArrow(count, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    return stored(counted, "word-counts")


def _added_up(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The counts of several batches as one: a word that all of them hold goes to the shuffle once."""
    words, times = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(words)
    words, times = words[order], times[order]
    first = np.flatnonzero(np.r_[np.ones(min(len(words), 1), bool), words[1:] != words[:-1]])
    times = np.add.reduceat(times, first) if len(first) else times
    return pa.RecordBatch.from_arrays([pa.array(words[first].view(np.int64)), pa.array(times, pa.int64())], names=["word", "times"])


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words get ids of their own (ties by hash), more of them where there are more words."""
    classes = max(CLASSES, math.isqrt(counts.count()) // ROOT_PER_CLASS)
    rows = counts.orderBy(F.desc("times"), "word").limit((classes - 1) * CLASS_SIZE).collect()
    hashes = np.array([r.word for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], np.arange(len(hashes), dtype=np.int32)[order], classes)


def learn_shares(counts: DataFrame, vocabulary: Vocabulary) -> tuple[Shares, DataFrame]:
    """Shares of the words beyond the vocabulary, and the counts that are too many to be sent."""
    own = counts.sparkSession.createDataFrame([(h,) for h in vocabulary.hashes.view(np.int64).tolist()], "word long")
    beyond = counts.join(F.broadcast(own), "word", "left_anti")
    totals = np.zeros(CLASS_SIZE)
    for r in beyond.groupBy(F.col("word").bitwiseAND(CLASS_SIZE - 1).alias("k")).agg(F.sum("times").alias("n")).collect():
        totals[r.k] = r.n
    least, words = 1, 0
    by_times = sorted(((r.times, r.n) for r in beyond.groupBy("times").agg(F.count("*").alias("n")).collect()), reverse=True)
    for times, n in by_times:
        words += n
        if words > SENT_WORDS:
            least = times + 1
            break
    sent = beyond.where(F.col("times") >= least).toArrow()
    hashes = sent["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    shares = Shares(hashes[order], np.log(sent["times"].to_numpy())[order], totals, least == 1)
    return shares, counts.where(F.col("times") < least)


class Network:
    """Weights as one flat array of 32-bit floats, and views into it."""

    def __init__(self, flat: np.ndarray | None = None, classes: int = CLASSES):
        if flat is not None:
            classes = (len(flat) - _FIXED) // _PER_CLASS
        words = classes * CLASS_SIZE
        shapes = {"places": (len(PLACES), words + 1, HIDDEN), "hidden": (HIDDEN,), "classes": (HIDDEN + 1, classes), "words": (classes, HIDDEN + 1, CLASS_SIZE)}
        sizes = [int(np.prod(s)) for s in shapes.values()]
        if flat is None:
            flat = np.random.default_rng(3).normal(0, 0.1, sum(sizes))
        self.flat = np.asarray(flat, np.float32).copy()
        for (name, shape), start, size in zip(shapes.items(), np.cumsum([0, *sizes[:-1]]), sizes):
            setattr(self, name, self.flat[start : start + size].reshape(shape))
        self.matrices = list(self.words)  # views, made once: a step multiplies by hundreds of them
        self.turned = [w[:-1].T for w in self.words]

    def forward(self, around: np.ndarray) -> np.ndarray:
        """The hidden outputs, and a column of ones."""
        return _with_ones(self._hidden(around))

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        state = self.places[0].take(around[0], axis=0)
        state += self.hidden
        for table, ids in zip(self.places[1:], around[1:]):
            state += table.take(ids, axis=0)
        return np.tanh(state, out=state)

    def log_probabilities(self, around: np.ndarray, words: np.ndarray) -> np.ndarray:
        order = np.argsort(words)  # words of a class lie together
        words, state = words[order], self.forward(around[:, order])
        klass, member = words // CLASS_SIZE, words % CLASS_SIZE
        total = np.empty(len(words), np.float32)
        of_class = [_log_of(self.classes.T @ state[a : a + CACHED].T, klass[a : a + CACHED]) for a in range(0, len(words), CACHED)]
        total[order] = np.concatenate(of_class) + _log_of(self._members(state, _runs(klass, len(self.words))), member)
        return total

    def _members(self, state: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """Each state's outputs for the words of its class, a column each: sums and maxima go fast down columns."""
        outputs = np.empty((len(state), CLASS_SIZE), np.float32)
        for k, a, b in runs:
            state[a:b].dot(self.matrices[k], outputs[a:b])  # small products are fastest on whole rows
        return np.ascontiguousarray(outputs.T)

    def train_step(self, around: np.ndarray, words: np.ndarray, power: "Network", rate: float) -> None:
        """One step of adaptive gradient descent (squares of past gradients in ``power``)."""
        order = np.argsort(words)  # words of a class lie together
        words, around = words[order], around[:, order]
        n, hidden = len(words), self._hidden(around)
        state = _with_ones(hidden)
        klass, member = words // CLASS_SIZE, words % CLASS_SIZE
        every = np.arange(n)
        # gradients are taken downhill, errors being probabilities less one where the word is, and gone against
        back, grad_classes = np.empty_like(hidden), np.zeros_like(self.classes)
        for a in range(0, n, CACHED):
            own = slice(a, a + CACHED)
            error = _softmax(self.classes.T @ state[own].T)
            error[klass[own], every[: error.shape[1]]] -= 1
            np.matmul(error.T, self.classes[:-1].T, out=back[own])
            grad_classes[:-1] += (error @ hidden[own]).T
            grad_classes[-1] += error.sum(axis=1)
        grad_classes /= n
        runs = _runs(klass, len(self.words))
        part = np.ascontiguousarray(_softmax(self._members(state, runs)).T)
        part[every, member] -= 1
        dense = 2 * len(runs) >= len(self.words)  # gradients of classes that don't occur are 0, which moves nothing
        grad_words = (np.zeros if dense else np.empty)((len(self.words) if dense else len(runs), *self.words.shape[1:]), np.float32)
        within = np.empty_like(back)
        for at, (k, a, b) in enumerate(runs):
            part[a:b].dot(self.turned[k], within[a:b])
            state[a:b].T.dot(part[a:b], grad_words[k if dense else at])
        back += within
        grad_words /= n
        _descend(self.words, power.words, grad_words, rate, None if dense else np.array([k for k, _, _ in runs]))
        _descend(self.classes, power.classes, grad_classes, rate)
        inner = np.square(hidden, out=hidden)
        np.subtract(1, inner, out=inner)
        inner *= back
        inner /= n
        _descend(self.hidden, power.hidden, inner.sum(axis=0), rate)
        order = np.argsort(around.astype(np.uint16) if self.places.shape[1] <= 1 << 16 else around, axis=1, kind="stable")  # short keys sort by radix
        for table, squares, ids, by_id in zip(self.places, power.places, around, order):
            ids = ids.take(by_id)
            first = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            pairs = inner.take(by_id, axis=0).view(np.complex64)  # two floats are added at once
            _descend(table, squares, np.add.reduceat(pairs, first, axis=0).view(np.float32), rate, ids.take(first))


def _descend(weights: np.ndarray, squares: np.ndarray, grad: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
    """Move all or some rows against their gradient, by the root of the sum of its squares so far. ``grad`` is used up."""
    total = grad * grad
    if rows is None:
        squares += total
        np.sqrt(squares, out=total)
    else:
        total += squares.take(rows, axis=0)
        squares[rows] = total
        np.sqrt(total, out=total)
    total += 1e-6
    grad *= -rate
    grad /= total
    if rows is None:
        weights += grad
    else:
        grad += weights.take(rows, axis=0)
        weights[rows] = grad


def _with_ones(hidden: np.ndarray) -> np.ndarray:
    out = np.ones((len(hidden), HIDDEN + 1), np.float32)
    out[:, :-1] = hidden
    return out


def _log_of(outputs: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of each column at its chosen row; ``outputs`` is used up."""
    outputs -= outputs.max(axis=0)
    picked = outputs[chosen, np.arange(len(chosen))]
    return picked - np.log(np.exp(outputs, out=outputs).sum(axis=0))


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def _runs(klass: np.ndarray, classes: int) -> list[tuple[int, int, int]]:
    """(class, first place, end) of each class that occurs; classes ascend."""
    edges = np.searchsorted(klass, np.arange(classes + 1)).tolist()
    return [(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]


def _windows(column: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end, words, what stands at each place around them, where each text's words start)."""
    for first, last, _, *rest in _hashed_windows(column, vocabulary):
        yield first, last, *rest


def _hashed_windows(column: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``_windows``, with the hashes of the words after the end."""
    data, offsets = texts.flat(texts.as_strings(column))
    nothing = vocabulary.size
    for first, last in texts.slices(offsets, SLICE_BYTES):
        at = offsets[first : last + 1]
        found = texts.word_hashes(data[at[0] : at[-1]], at - at[0])
        words = vocabulary.encode(found.hashes)
        text = np.repeat(np.arange(last - first), np.diff(found.starts))
        around = np.full((len(PLACES), len(words)), nothing, np.int32)
        for row, place in zip(around, PLACES):
            here, there = (slice(-place, None), slice(None, place)) if place < 0 else (slice(None, -place), slice(place, None))
            same = text[here] == text[there]
            row[here] = np.where(same, words[there], nothing)
        yield first, last, found.hashes, words, around, found.starts


def _train(vocabulary: Vocabulary, weights, phase: int, stride: int):
    """A task's weights times its number of targets, in parts, as whole numbers: sums don't depend on their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(weights.value)
        power = Network(np.zeros_like(network.flat))
        seen = 0
        for batch in batches:
            for _, _, words, around, starts in _windows(batch.column(0), vocabulary):
                place = np.arange(len(words)) - np.repeat(starts[:-1], np.diff(starts))  # in its text, however batches are cut
                target = np.flatnonzero(place % stride == phase)
                start = 0
                while start < len(target):
                    part = target[start : start + min(max(STEP_WORDS, seen // SEEN_PER_STEP_WORD), LONGEST_STEP)]
                    network.train_step(around[:, part], words[part], power, RATE)
                    start += len(part)
                    seen += len(part)
        if seen:
            whole = np.rint(network.flat.astype(np.float64) * _FIXED_POINT).astype(np.int64) * seen
            parts = [whole[a : a + _PART] for a in range(0, len(whole), _PART)]
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array(range(len(parts)), pa.int32()), "sums": pa.array([p.tobytes() for p in parts], pa.binary()), "seen": pa.array([seen] * len(parts), pa.int64())}
            )

    return run


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for part, sums, seen in zip(*(c.to_pylist() for c in batch.columns)):
            whole = np.frombuffer(sums, np.int64)
            held = total.setdefault(part, [0, 0, 0])
            held[0] = held[0] + (whole >> 32)  # in halves: sums stay exact
            held[1] = held[1] + (whole & 0xFFFFFFFF)
            held[2] += seen
    means = {part: ((high.astype(object) * 2**32 + low) / seen).astype(np.float64) / _FIXED_POINT for part, (high, low, seen) in total.items()}
    yield pa.RecordBatch.from_pydict({"part": pa.array(list(means), pa.int32()), "mean": pa.array([m.tobytes() for m in means.values()], pa.binary())})


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    shares: Shares
    counts: DataFrame


def train(docs: DataFrame, text_column: str = "text", rounds: int = ROUNDS, stride: int = STRIDE) -> Model:
    """Vocabulary and weights from all documents; each round takes every ``stride``-th word of each as a target, another one each time.

    With as many rounds as strides (the defaults), or more, every word of every text is a target.
    """
    spark = ship(docs.sparkSession)
    source = docs.select(F.col(text_column).cast("string").alias("text"))
    counts = count_words(source)
    vocabulary = learn_vocabulary(counts)
    weights = Network(classes=vocabulary.classes).flat
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(weights)
        parts = source.mapInArrow(_train(vocabulary, sent, turn % stride, stride), "part int, sums binary, seen long")
        means = parts.repartition(shuffle_partitions(spark), "part").mapInArrow(_add_parts, "part int, mean binary").collect()
        if means:
            weights = np.concatenate([np.frombuffer(r["mean"]) for r in sorted(means, key=lambda r: r.part)]).astype(np.float32)
    return Model(vocabulary, weights, *learn_shares(counts, vocabulary))


def _score(vocabulary: Vocabulary, weights, shares):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(weights.value)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, last, hashes, words, around, starts in _hashed_windows(batch.column(1), vocabulary):
                logs = np.concatenate([np.zeros(0), *[network.log_probabilities(around[:, a : a + SCORED_AT_ONCE], words[a : a + SCORED_AT_ONCE]) for a in range(0, len(words), SCORED_AT_ONCE)]])
                beyond = np.flatnonzero(words >= vocabulary.rest)
                within, unknown = shares.value.within(hashes[beyond])
                logs[beyond] += within
                total = np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])[starts]
                n = np.diff(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(key, key + last - first)), batch.column(0).slice(first, last - first), pa.array(n, pa.int64()),
                        pa.array(np.diff(total), pa.float64()), _words_of(beyond[unknown], hashes, starts),
                    ],
                    names=["key", "doc_id", "n_words", "sums", "beyond"],
                )
                key += last - first

    return run


def _words_of(at: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """The words at these places, counted, text by text."""
    text, word = np.searchsorted(starts, at, side="right") - 1, hashes[at]
    order = np.lexsort((word, text))
    text, word = text[order], word[order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (word[1:] != word[:-1])]) if len(at) else at
    values = pa.StructArray.from_arrays([pa.array(word[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(at)]), pa.int64())], names=["word", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[first], np.arange(len(starts))), pa.int32()), values)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, log_likelihood (sum over its words), mean_log (null without words).

    A word beyond the vocabulary has the probability of its hash class, times its share of that class's
    occurrences in the training documents; all words unseen there together count as half an occurrence.

    Null or empty text: no words, likelihood 0. A null id stays null. Repeated rows: each is scored. Empty
    table: no rows. Other columns are not read. Whole texts are scored, every word from its own window.
    """
    spark = ship(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    sent, shares = spark.sparkContext.broadcast(model.weights), spark.sparkContext.broadcast(model.shares)
    schema = "key long, doc_id long, n_words long, sums double, beyond array<struct<word:long,n:long>>"
    scored = source.mapInArrow(_score(model.vocabulary, sent, shares), schema)
    if not model.shares.complete:
        scored = stored(scored, "scored")  # a key names one row from here on
        words = scored.select("key", F.inline("beyond")).join(model.counts, "word", "left")
        log = F.round(F.log(F.coalesce("times", F.lit(UNSEEN))) * 2**32).cast("long")  # whole numbers: sums don't depend on their order
        added = words.groupBy("key").agg((F.sum(log * F.col("n")) / 2**32).alias("added"))
        scored = scored.join(added, "key", "left").withColumn("sums", F.col("sums") + F.coalesce("added", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("sums") / F.col("n_words"))
    return scored.select("doc_id", "n_words", F.col("sums").alias("log_likelihood"), mean.alias("mean_log"))
