"""Secrets: fixed patterns, and formats inferred from labelled credentials.

For each kind a prefix tree of its labelled credentials is built over classes of characters, and states
whose futures are statistically alike (Hoeffding's bound on stopping and on every next symbol,
recursively) are merged into a probabilistic automaton. A candidate's format likelihood is its mean
log-probability per character under the best automaton, less that under a model of ordinary long words.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.llm.tables import ship, stored

KINDS = ("assign", "access", "hex")
LEARNED = "learned"
SAMPLE_SECRETS = 600
LEAST_WORD = 8
CONFIDENCE = 0.05
#: A candidate must be this much likelier as a credential, per character, and at least as likely as this share of the labelled ones.
MARGIN = 0.5
QUANTILE = 0.05

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{6,}[A-Za-z0-9+/_=-]")
_WORD = re.compile(r"(?<!\S)[A-Za-z]{%d,}(?!\S)" % LEAST_WORD)


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the credential itself) of the fixed patterns, by start, then kind as listed."""
    found = []
    folded = text.lower()
    if any(name in folded for name in _NAMES):
        found += [("assign", m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int, int]]) -> Iterator[tuple[int, int]]:
    """Words of 8 or more characters that a credential may have, without dots around them, that touch no base span."""
    taken = iter(base)  # by start
    _, begin, end, _ = next(taken, _NO_SPAN)
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while end <= a:
            _, begin, end, _ = next(taken, _NO_SPAN)
        if b <= begin:
            yield a, b


# Grammar inference ------------------------------------------------------------------------------------

#: Character classes are the symbols: (name, characters).
CLASSES = (("0", "0123456789"), ("a", "abcdef"), ("g", "ghijklmnopqrstuvwxyz"), ("A", "ABCDEF"), ("G", "GHIJKLMNOPQRSTUVWXYZ"), ("_", "+/_=.-"))
_SYMBOL = {c: name for name, chars in CLASSES for c in chars}
_SPREAD = {name: math.log(len(chars)) for name, chars in CLASSES}
_FIXED_PREFIX = 4  # characters that stand for themselves, so that a fixed beginning is part of the format


def symbols(text: str) -> list[str]:
    """Classes of the characters; each of the first four is a symbol of its own."""
    return [f"={c}" if k < _FIXED_PREFIX else _SYMBOL.get(c, "?") for k, c in enumerate(text)]


def _spread(symbol: str) -> float:
    return _SPREAD.get(symbol, 0.0)


@dataclass
class Automaton:
    """States: number of strings that end there, and for each symbol (count, next state)."""

    ends: list[int] = field(default_factory=lambda: [0])
    steps: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])

    def add(self, string: list[str]) -> None:
        state = 0
        for symbol in string:
            step = self.steps[state].setdefault(symbol, [0, len(self.ends)])
            if step[1] == len(self.ends):
                self.ends.append(0)
                self.steps.append({})
            step[0] += 1
            state = step[1]
        self.ends[state] += 1

    def visits(self, state: int) -> int:
        return self.ends[state] + sum(n for n, _ in self.steps[state].values())

    def log_probability(self, string: list[str]) -> float:
        """Mean natural logarithm per character; unseen steps have the probability of half a visit."""
        state: int | None = 0
        total = 0.0
        for symbol in string:
            step = None if state is None else self.steps[state].get(symbol)
            if step:
                total += math.log(step[0] / (self.visits(state) + 1)) - _spread(symbol)
                state = step[1]
            else:
                seen = 0 if state is None else self.visits(state)
                total += math.log(0.5 / (seen + 1)) - math.log(65)
                state = None
        seen = 0 if state is None else self.visits(state)
        total += math.log(((self.ends[state] if state is not None else 0) + 0.5) / (seen + 1))
        return total / (len(string) + 1)


def _alike(a: int, n: int, b: int, m: int, confidence: float) -> bool:
    """Hoeffding's bound: two shares of n and m visits may come from one probability."""
    if not n or not m:
        return True
    return abs(a / n - b / m) < math.sqrt(0.5 * math.log(2 / confidence)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def _compatible(tree: Automaton, left: int, right: int, confidence: float) -> bool:
    todo = [(left, right)]
    while todo:
        a, b = todo.pop()
        n, m = tree.visits(a), tree.visits(b)
        if not _alike(tree.ends[a], n, tree.ends[b], m, confidence):
            return False
        for symbol in tree.steps[a].keys() | tree.steps[b].keys():
            x, y = tree.steps[a].get(symbol), tree.steps[b].get(symbol)
            if not _alike(x[0] if x else 0, n, y[0] if y else 0, m, confidence):
                return False
            if x and y and x[1] != y[1]:
                todo.append((x[1], y[1]))
    return True


def _fold(tree: Automaton, into: int, other: int) -> None:
    """Add the tree below ``other`` to the states below ``into``."""
    todo = [(into, other)]
    while todo:
        a, b = todo.pop()
        tree.ends[a] += tree.ends[b]
        for symbol, (count, target) in tree.steps[b].items():
            if symbol in tree.steps[a]:
                tree.steps[a][symbol][0] += count
                if tree.steps[a][symbol][1] != target:
                    todo.append((tree.steps[a][symbol][1], target))
            else:
                tree.steps[a][symbol] = [count, target]


def infer(strings: list[str], confidence: float = CONFIDENCE) -> Automaton:
    """A probabilistic automaton from a prefix tree, merging compatible states; kept states grow from the root."""
    tree = Automaton()
    for string in sorted(strings):
        tree.add(symbols(string))
    kept = [0]
    while border := next(((p, c) for p in kept for c in sorted(tree.steps[p]) if tree.steps[p][c][1] not in kept), None):
        parent, symbol = border
        state = tree.steps[parent][symbol][1]
        other = next((k for k in kept if _compatible(tree, k, state, confidence)), None)
        if other is None:
            kept.append(state)
        else:
            tree.steps[parent][symbol][1] = other
            _fold(tree, other, state)
    place = {state: k for k, state in enumerate(kept)}
    return Automaton(
        [tree.ends[s] for s in kept], [{c: [n, place[t]] for c, (n, t) in tree.steps[s].items()} for s in kept]
    )


@dataclass
class Formats:
    """Automata by kind with the least score a candidate needs, and character frequencies of ordinary long words."""

    automata: dict[str, tuple[Automaton, float]]
    ordinary: dict[str, float]

    def background(self, text: str) -> float:
        """Mean logarithm per character as an ordinary word or a plain number, whichever is likelier."""
        rare = min(self.ordinary.values(), default=math.log(1 / 65))
        word = sum(self.ordinary.get(c, rare) for c in text)
        number = sum(math.log(0.1) if c.isdigit() else math.log(0.001) for c in text)
        return max(word, number) / max(1, len(text))

    def score(self, text: str) -> tuple[str | None, float, bool]:
        """(kind, likelihood ratio per character, whether it passes) of the best automaton."""
        best: tuple[str | None, float, bool] = (None, -math.inf, False)
        string, background = symbols(text), self.background(text)
        for kind, (automaton, least) in self.automata.items():
            ratio = automaton.log_probability(string) - background
            if ratio > best[1]:
                best = kind, ratio, ratio >= least
        return best


def learn(credentials: dict[str, list[str]], words: list[str] | Counter[str], margin: float = MARGIN, quantile: float = QUANTILE) -> Formats:
    """Formats from labelled credentials by kind, and from ordinary words, or counts of their characters. A kind needs two credentials."""
    counts = Counter(words) if isinstance(words, Counter) else Counter(c for word in words for c in word)
    for chars in CLASSES:
        counts.update(chars[1])
    total = sum(counts.values())
    formats = Formats({}, {c: math.log(n / total) for c, n in counts.items()})
    for kind, strings in credentials.items():
        if len(strings) > 1:
            automaton = infer(strings)
            own = [automaton.log_probability(symbols(s)) - formats.background(s) for s in strings]
            formats.automata[kind] = automaton, max(margin, float(np.quantile(own, quantile)))
    return formats


# Documents --------------------------------------------------------------------------------------------

_LETTERS = np.frombuffer((string.ascii_uppercase + string.ascii_lowercase).encode(), np.uint8)
_FOUND = "array<struct<kind:string,text:string>>"
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
_NO_SPAN = ("", 2**62, 2**62, 0)
#: Words whose score a task keeps at once.
KEPT_SCORES = 200_000


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base credentials (kind, text) of the documents, and counts of characters in the ordinary long words of a part's texts."""
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            found, counts = [], np.zeros(256, np.int64)
            for text in batch.column(1).slice(first, 512).to_pylist():
                text = text or ""
                found += [dict(kind=k, text=text[c:b]) for k, a, b, c in base_spans(text)]
                counts += np.bincount(np.frombuffer("".join(_WORD.findall(text)).encode(), np.uint8), minlength=256)
            yield pa.RecordBatch.from_arrays(
                [pa.array([found], _FOUND_ARROW), pa.array([counts[_LETTERS].tolist()], pa.list_(pa.int64()))], names=["found", "letters"]
            )


def _bounded(df: DataFrame, column: str, rows: int) -> list[str]:
    """The ``rows`` distinct values with the smallest hash."""
    values = df.select(F.col(column).alias("v")).where("v is not null and v <> ''").distinct()
    return sorted(r.v for r in values.orderBy(F.xxhash64("v", F.lit(3)), "v").limit(rows).collect())


def _letters(scanned: DataFrame) -> Counter[str]:
    """Counts of characters in the ordinary long words of all texts."""
    each = scanned.select(F.posexplode("letters").alias("at", "n"))
    return Counter({chr(_LETTERS[r["at"]]): r.n for r in each.groupBy("at").agg(F.sum("n").alias("n")).collect()})


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", formats: Formats | None = None) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end in code points, base, format, score).

    Base spans come from the fixed patterns and carry their kind. Without ``formats``, automata are
    learned from the documents' own base credentials as labelled examples: at most 600 of each kind, those
    with the smallest hash, each whole. They are held against the frequencies of characters in all ordinary
    long words (8 or more ASCII letters between blanks) of all texts. Every candidate of every document is scored; those
    that pass are added as ``learned``, with the kind whose format they have. Spans go by start, then kind.

    Null or empty text: no spans. A null id stays null. Repeated rows: each is searched. Empty table: no
    rows. Other columns are not read. Whole texts are searched. Without two credentials of a kind, that
    kind has no format.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    if formats is None:
        scanned = stored(source.mapInArrow(_scan, f"found {_FOUND}, letters array<long>"), "credentials")
        each = scanned.select(F.explode("found").alias("f")).select("f.*")
        labelled = {kind: _bounded(each.where(F.col("kind") == kind), "text", SAMPLE_SECRETS) for kind in KINDS}
        formats = learn(labelled, _letters(scanned))
    return source.mapInArrow(_score(formats), f"doc_id long, spans {SPANS}")


def _score(formats: Formats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple] = {}

        def score(word: str) -> tuple:
            found = kept.get(word)
            if found is None:
                if len(kept) >= KEPT_SCORES:
                    kept.clear()
                found = formats.score(word)
                if len(word) <= 64:
                    kept[word] = found
            return found

        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = []
                for label, a, b, c in base:
                    kind, ratio, _ = formats.score(text[c:b])
                    spans.append(dict(kind=label, start=a, end=b, base=True, format=kind, score=ratio if kind else None))
                for a, b in candidates(text, base):
                    kind, ratio, passes = score(text[a:b])
                    if passes:
                        spans.append(dict(kind=LEARNED, start=a, end=b, base=False, format=kind, score=ratio))
                spans.sort(key=lambda s: (s["start"], (*KINDS, LEARNED).index(s["kind"])))
                rows.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS_ARROW)], names=["doc_id", "spans"])

    return run


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,format:string,score:double>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("format", pa.string()), ("score", pa.float64())]))
