"""Periodic runs of words, by recursive frequency splitting and a lag scan.

A run of period q and at least two periods holds each of its words twice or more. So a word that occurs
once in a segment of a text can be in no run there, and splits the segment; the parts are counted anew,
until no word is left that splits. Segments shorter than the shortest run are dropped. What survives is
scanned lag by lag: a run of period q is a stretch of words that equal the word q further on.

Short lags compare all words. A stretch of a longer lag q has q words at least, so it holds a whole block of
about q / 2 words that starts at a multiple of that length: only such blocks are compared, 4 n / q of them,
and those that agree are extended to both sides. All lags of a segment of n words take about n log n steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.llm.tables import ship
from clientela.llm.texts import as_strings, flat, slices

SHORTEST = 12
SCANNED_LAGS = 15
BLOCKS_AT_ONCE = 1 << 19
RUNS = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_PRIMES = (2147483629, 2147483587)
_BASES = (1103515245, 747796405)


def _split(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that no frequency rules out, ascending, and the number of the segment each lies in."""
    at, segment = np.arange(len(ids)), text
    words = int(ids.max(initial=0)) + 1
    done: list[np.ndarray] = []
    while len(at):
        _, which, counts = np.unique(segment * words + ids[at], return_inverse=True, return_counts=True)
        stays = counts[which] > 1
        split = np.zeros(int(segment[-1]) + 1, dtype=bool)
        split[segment[~stays]] = True
        whole = ~split[segment]
        done.append(at[whole])
        at, segment = at[stays & ~whole], segment[stays & ~whole]
        if len(at):
            parts = np.r_[0, np.cumsum((np.diff(at) != 1) | (np.diff(segment) != 0))]
            large = np.bincount(parts)[parts] >= SHORTEST
            at, segment = at[large], parts[large]
    at = np.sort(np.concatenate([*done, np.zeros(0, np.int64)])).astype(np.int64)
    if not len(at):
        return at, at
    # two segments of a text never touch: the word between them was ruled out
    parts = np.r_[0, np.cumsum((np.diff(at) != 1) | (np.diff(text[at]) != 0))]
    large = np.bincount(parts)[parts] >= SHORTEST
    return at[large], parts[large]


class _Windows:
    """Whether two stretches hold the same words, by their residues modulo two primes."""

    def __init__(self, words: np.ndarray) -> None:
        self.sums, self.powers = [], []
        value = np.random.default_rng(7).integers(1, min(_PRIMES), int(words.max()) + 1, dtype=np.int64)
        for prime, base in zip(_PRIMES, _BASES):
            power = np.ones(1, np.int64)
            while len(power) <= len(words):
                power = np.concatenate([power, power * pow(base, len(power), prime) % prime])
            # each term is below 2^31, so sums of up to 2^32 words are exact
            self.sums.append(np.r_[0, np.cumsum(value[words] * power[: len(words)] % prime)])
            self.powers.append(power)

    def same(self, at: np.ndarray, length: np.ndarray, lag: np.ndarray) -> np.ndarray:
        equal = np.ones(len(at), dtype=bool)
        for prime, sums, powers in zip(_PRIMES, self.sums, self.powers):
            here = (sums[at + length] - sums[at]) % prime * powers[lag] % prime
            equal &= here == (sums[at + lag + length] - sums[at + lag]) % prime
        return equal

    def reach(self, at: np.ndarray, lag: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``at`` on (or back from it) equal the word ``lag`` further on."""
        low, high = np.zeros_like(at), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = self.same(at - middle if back else at, middle, lag)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.r_[False, equal, False].view(np.int8)))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= least
    return begin[long], end[long]


def _scan(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, lag) of all stretches that repeat with a lag; segments lie by size, largest first."""
    ends = np.cumsum(sizes)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lags = np.arange(1, int(sizes[0]) // 2 + 1)
    large = np.searchsorted(-sizes, -np.maximum(SHORTEST, 2 * lags), side="right")
    upto = np.where(large > 0, ends[large - 1], 0)  # words of the segments that a run of this period fits into
    for lag, stop in zip(lags[:SCANNED_LAGS].tolist(), upto.tolist()):
        begin, end = _stretches(words[lag:stop] == words[: stop - lag], max(lag, SHORTEST - lag))
        found.append((begin, end + lag, np.full(len(begin), lag)))
    lags, upto = lags[SCANNED_LAGS:], upto[SCANNED_LAGS:]
    block = (lags + 1) // 2
    blocks = np.maximum((upto - lags) // block, 0)
    through = np.cumsum(blocks)
    windows, first = None, 0
    while first < len(lags):
        before = through[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(through, before + BLOCKS_AT_ONCE, side="right")))
        part = slice(first, last)
        which = np.repeat(np.arange(first, last), blocks[part])
        number = np.arange(len(which)) - np.repeat(through[part] - blocks[part] - before, blocks[part])
        at = number * block[which]
        alike = np.flatnonzero(words[at] == words[at + lags[which]])
        first = last
        if not len(alike):
            continue
        windows = windows or _Windows(words)
        alike = alike[windows.same(at[alike], block[which[alike]], lags[which[alike]])]
        if not len(alike):
            continue
        which, number, at = which[alike], number[alike], at[alike]
        new = np.r_[True, (np.diff(which) != 0) | (np.diff(number) != 1)]  # blocks of one stretch follow one another
        head, tail = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(new)] - 1
        size, lag, limit = block[which[head]], lags[which[head]], upto[which[head]]
        begin, end = at[head], at[tail] + size
        begin = begin - windows.reach(begin, lag, np.minimum(size - 1, begin), back=True)
        end = end + windows.reach(end, lag, np.minimum(size - 1, limit - lag - end), back=False)
        long = end - begin >= lag
        found.append((begin[long], (end + lag)[long], lag[long]))
    return tuple(np.concatenate(c) for c in zip(*found))


def find_runs(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in texts of numbered words, by start and period.

    ``starts`` has the position at which each text begins, and the end of the last; a run lies in one text.
    """
    nothing = np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at, segment = _split(ids, text)
    if not len(at):
        return nothing, nothing, nothing
    size = np.bincount(segment)
    order = np.lexsort((at, segment, -size[segment]))
    at, segment = at[order], segment[order]
    # words are numbered anew by segment, so that no stretch goes on into the next one
    _, words = np.unique(segment * (int(ids.max()) + 1) + ids[at], return_inverse=True)
    begin, end, lag = _scan(words.astype(np.int64), np.sort(size[size > 0])[::-1])
    begin, end = at[begin], at[end - 1] + 1
    order = np.lexsort((lag, end, begin))
    begin, end, lag = begin[order], end[order], lag[order]
    smallest = np.r_[True, (np.diff(begin) != 0) | (np.diff(end) != 0)][: len(begin)]  # others are its multiples
    begin, end, lag = begin[smallest], end[smallest], lag[smallest]
    order = np.lexsort((lag, begin))
    return begin[order], end[order], lag[order]


def _find(rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            data, offsets = flat(as_strings(batch.column(1)))
            for first, last in slices(offsets):
                yield _batch(own[first:last], data, offsets[first : last + 1], rewrite)

    return run


def _batch(own: list[int | None], data: np.ndarray, offsets: np.ndarray, rewrite) -> pa.RecordBatch:
    texts = [data[a:b].tobytes().split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    if rewrite:
        texts = [rewrite(k, words) for k, words in zip(own, texts)]
    counts = np.array([len(words) for words in texts], np.int64)
    starts = np.r_[0, np.cumsum(counts)]
    every = pa.array([word for words in texts for word in words], pa.large_binary()).dictionary_encode()
    begin, end, period = find_runs(every.indices.to_numpy().astype(np.int64), starts)
    steps = np.zeros(starts[-1] + 1, np.int64)
    np.add.at(steps, begin + period, 1)
    np.add.at(steps, end, -1)
    dropped = np.cumsum(steps) > 0
    edges = np.searchsorted(begin, starts)
    collapsed = []
    for k, words in enumerate(texts):
        if edges[k] < edges[k + 1]:
            kept = ~dropped[starts[k] : starts[k + 1]]
            words = [words[i] for i in np.flatnonzero(kept).tolist()]
        collapsed.append(b" ".join(words))
    of_text = np.repeat(starts[:-1], np.diff(edges))
    runs = pa.StructArray.from_arrays([pa.array(begin - of_text), pa.array(end - begin), pa.array(period)], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [pa.array(own, pa.int64()), pa.array(counts), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are runs of bytes outside ``20 09-0D`` (hex), numbered from 0. A run is a stretch of words with
    smallest period q and at least max(12, 2 q) words that can be extended to neither side. ``collapsed``
    keeps the words that no run holds after its first q words, joined by one space. ``rewrite`` may change the
    words of a document (its id, its words) before they are searched.

    Null or empty text: no words, no runs, an empty ``collapsed``. A null id stays null. Repeated rows: each
    has its row. Empty table: no rows. Other columns are not read. A text of any length is searched as a
    whole, in time of about n log n. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(_find(rewrite), RUNS)
