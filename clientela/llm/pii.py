"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field labels words. Its features are counts and classes of a word's bytes and of its neighbours',
so equal shapes share one score. It is trained from a small labelled table by gradient ascent on the
likelihood (forward and backward sums in numpy), and decoded by Viterbi in batches of sentences.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.llm import texts
from clientela.llm.tables import ship

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", "email", "ip", "card", "card+", "phone", "phone+")  # + continues the span of the word before
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

#: The labelled table. [kind:text] marks personal data; every # of a sentence becomes a digit.
LABELLED = """
write to [email:ana.lima##@web#.example.org] today
contact: [email:j_smith+news@sub.example.org]. Thank you
[email:info@example.net] or [email:sales@shop.example.co.uk], whichever
mail <[email:karl-heinz.m##@firma.example.de]> soon
le courriel est [email:marie##@exemple.example.fr], merci
my address is [email:bob@example.com]!
the host [ip:##.###.##.#] answered
from [ip:10.##.1##.2##] to [ip:192.168.#.1##] in order
server ([ip:1##.##.2.1##]) is down.
la ip [ip:8#.1#.##.#] no responde
card [card:4#######7#######] was used
card [card:4### #### #### ####] expires soon
pay with [card:5###-####-####-####], please
Karte [card:37## ###### #####] ist gesperrt
numero [card:6###############] vencido
call [phone:+1 (###) ###-####] now
phone [phone:+49 30 #######] or [phone:+33 1 ## ## ## ##]
tel. [phone:(###) ###-####] after nine
ring [phone:###-###-####] today
Telefon [phone:+49-89-#####-##], bitte
appelle le [phone:+33 6 ## ## ## ##].
llama al [phone:+34 ### ### ###] ahora
[phone:+1.###.###.####] is my number
[email:x.y##@post#.example.org] [phone:+1 (###) ###-####] [card:4###############] and the rest
seen at [ip:42.1##.3#.2##] with [card:4###############] there.
either of them, [email:olga.##@office#.example.net] or nobody
era el [phone:+1 (###) ###-####] que di
"""
PLAIN = """
the licence is version #.# of the text
CC BY-NC #.# applies here
released on 20##-0#-1# at ##:##
on ##/##/20## we met
on ##.##.20## in Berlin
version #.##.# and build ####
chapter ## has ### pages, page ##
it costs #,###.## in total
in 19## there were #### people
the ratio is #.###### or so
order ######## was sent on 20##-##-##
hash ##ab#c#d##e#f#a##b#c##d#e##f is listed
token = "#b##e#a##cd##f#e#a##b#c#d##e#ff#" is set
password=b#db#aa#a#fcc##### here
key AKIA#SJD#WJNP#ZRYWK## here
rows #### #### #### in the table
section #.#.# says (see ##) nothing
a | b | ## | ### | #### | c
## + ## = ### and more
isbn ###-#-##-######-# in print
from ##:## to ##:## on day ##
the and of to in is was for
The quick words, they said; it was (so) done.
le la les de des et que pour dans
der die das und ist von zu mit
el la los de que y en por con
odd&&& signs*** between %%% words### here$$$
@someone wrote to @another about it
see https://www.example.com/en/#### for more
the % and the * and the + and the -
(and) [or] {not} "so" 'it'
I had ### or ## of them -- perhaps
temperature -## to +## degrees
"""

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_LONG_NUMBER = re.compile(r"(?:[0-9][\x20-]?){15}[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Local part, @, and at least two labels: found from the @ on, so that long runs without one cost nothing."""
    free, at = 0, text.find("@")  # what comes before ``free`` belongs to another match, or ends in another @
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = free + len(text[free:at].rstrip(_LOCAL)) if domain else at
        if start < at:
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _byte(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, by kind as listed, then start; a match that fails its check is dropped.

    Every pattern takes time in proportion to the text, whatever it holds.
    """
    found = [("email", a, b) for a, b in _emails(text)]
    if _DOTTED.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    if _LONG_NUMBER.search(text):
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


# Word shapes ---------------------------------------------------------------------------------------------

_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_EDGE = np.zeros(256, np.int64)  # class of a word's first or last byte
for _k, _chars in enumerate(("+", "(", ")", ".", ",;:!?", "\"'<>[]{}", "@#$%&*=|/\\^~`_-"), start=1):
    _EDGE[[ord(c) for c in _chars]] = _k
_EDGE[_DIGIT], _EDGE[_UPPER], _EDGE[_LOWER] = 8, 9, 10
#: Upper ends of the classes of counts.
_STEPS = {"length": [1, 2, 4, 8, 12, 15, 19, 30], "digits": [0, 1, 2, 3, 4, 7, 11, 14, 19]}
#: Pairs and singles of the base features that have weights of their own.
_CROSS = [(0,), (1,), (2,), (3,), (4,), (5,), (6,), (7,), (8,), (9,), (1, 4), (3, 4), (1, 5), (6, 7), (0, 1), (1, 6), (1, 2), (2, 3), (1, 9)]
_SIDE = [(1,), (2,), (3,), (6,), (7,), (1, 6)]
_WIDTH = (9, 10, 5, 3, 5, 5, 11, 11, 3, 5)


def _class(x: np.ndarray, steps: str) -> np.ndarray:
    return np.searchsorted(_STEPS[steps], x)


def word_shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One number per word that holds all its base features; words are data[start:end]."""
    def count(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=total[1:])
        return total[end] - total[start]

    one = np.zeros((6, 256), bool)
    for row, char in zip(one, "@.-(+:"):
        row[ord(char)] = True
    digits, upper, lower = count(_DIGIT), count(_UPPER), count(_LOWER)
    length = end - start
    case = np.select([upper + lower == 0, upper == 0, (upper == 1) & _UPPER[data[start]], lower == 0], [0, 1, 2, 3], 4)
    features = [
        _class(length, "length"), _class(digits, "digits"), case, np.minimum(count(one[0]), 2),
        np.minimum(count(one[1]), 4), np.minimum(count(one[2]), 4), _EDGE[data[start]], _EDGE[data[end - 1]],
        np.where(digits == 0, 0, np.where(digits == length, 2, 1)), np.minimum(count(one[3]) + count(one[4]) + 2 * (count(one[5]) > 0), 4),
    ]
    code = np.zeros(len(start), np.int64)
    for feature, width in zip(features, _WIDTH):
        code = code * width + np.minimum(feature, width - 1)
    return code


def _offsets(crosses: list[tuple[int, ...]]) -> tuple[np.ndarray, int]:
    sizes = [int(np.prod([_WIDTH[f] for f in c])) for c in crosses]
    return np.cumsum([0, *sizes[:-1]]), sum(sizes)


def _indices(codes: np.ndarray, crosses: list[tuple[int, ...]]) -> np.ndarray:
    """Weight rows of each code, one column per cross."""
    digits, rest = [], codes.copy()
    for width in reversed(_WIDTH):
        digits.append(rest % width)
        rest //= width
    digits = digits[::-1]
    out = np.empty((len(codes), len(crosses)), np.int64)
    for k, (cross, first) in enumerate(zip(crosses, _offsets(crosses)[0])):
        value = np.zeros(len(codes), np.int64)
        for f in cross:
            value = value * _WIDTH[f] + digits[f]
        out[:, k] = first + value
    return out


_N_OWN, _N_SIDE = _offsets(_CROSS)[1], _offsets(_SIDE)[1]


#: Words that a batch of sentences is padded to at most, unless one sentence alone is longer.
DECODED_CELLS = 1 << 18


@dataclass
class Field:
    """Weights: own, previous and next word's shape by label; transitions; start."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def scores(self, codes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        """Emission score of every word and label; neighbours count within a sentence only."""
        kinds, which = np.unique(codes, return_inverse=True)
        own = self.own[_indices(kinds, _CROSS)].sum(axis=1)
        side = _indices(kinds, _SIDE)
        before, after = self.before[side].sum(axis=1), self.after[side].sum(axis=1)
        total = own[which]
        joined = (sentence[1:] == sentence[:-1])[:, None]
        total[1:] += before[which[:-1]] * joined
        total[:-1] += after[which[1:]] * joined
        return total

    def decode(self, codes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        """The best labels (Viterbi), sentence by sentence; ``sentence`` ascends."""
        labels = np.zeros(len(codes), np.int8)
        if not len(codes):
            return labels
        scores = self.scores(codes, sentence)
        # A word may leave "O" only if its score makes up for it: no two transitions gain more than this.
        gain = 2 * max(0.0, float((self.step - self.step[0, 0]).max()), float((self.first - self.first[0]).max()))
        open_word = (scores[:, 1:].max(axis=1) - scores[:, 0] + gain) > 0
        edges = np.r_[np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]), len(sentence)]
        todo = np.flatnonzero(np.add.reduceat(open_word, edges[:-1]))
        begins, lengths = edges[todo], (edges[1:] - edges[:-1])[todo]
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):  # one sentence at least, and no more cells than a batch may have
            part = order[at : at + max(1, min(512, DECODED_CELLS // int(lengths[order[at]])))]
            self._decode_batch(scores, begins[part], lengths[part], labels)
            at += len(part)
        return labels

    def _decode_batch(self, scores: np.ndarray, begins: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> None:
        longest = int(lengths[0])
        back = np.zeros((longest, len(begins), len(LABELS)), np.int8)
        state = scores[begins] + self.first
        last = state.copy()
        for t in range(1, longest):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # sentences of more than t words come first
            through = state[:live, :, None] + self.step
            back[t, :live] = through.argmax(axis=1)
            state[:live] = through.max(axis=1) + scores[begins[:live] + t]
            last[:live] = state[:live]
        best = last.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            labels[begins[:live] + t] = best[:live]
            if t:
                best[:live] = back[t, np.arange(live), best[:live]]


def train(labelled: list[list[tuple[str, str]]], rounds: int = 150, decay: float = 0.02) -> Field:
    """Fit to sentences of (word, label), by Adam on the mean log-likelihood less a penalty on the weights."""
    k, n = len(LABELS), len(labelled)
    words = [w for s in labelled for w, _ in s]
    tags = np.array([LABELS.index(t) for s in labelled for _, t in s])
    sizes = np.array([len(s) for s in labelled])
    joined = " ".join(words).encode()
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    codes = word_shapes(data, starts, ends)
    sentence = np.repeat(np.arange(n), sizes)
    begins = np.cumsum(sizes) - sizes
    own, side = _indices(codes, _CROSS), _indices(codes, _SIDE)
    same = sentence[1:] == sentence[:-1]
    longest = int(sizes.max())
    at = begins[:, None] + np.minimum(np.arange(longest), sizes[:, None] - 1)
    live = np.arange(longest) < sizes[:, None]
    weights = [np.zeros((_N_OWN, k)), np.zeros((_N_SIDE, k)), np.zeros((_N_SIDE, k)), np.zeros((k, k)), np.zeros(k)]
    moment = [[np.zeros_like(w) for w in weights] for _ in range(2)]
    gold_step = np.zeros((k, k))
    np.add.at(gold_step, (tags[:-1][same], tags[1:][same]), 1)
    for turn in range(1, rounds + 1):
        field = Field(*weights)
        scores = field.scores(codes, sentence)[at]
        ahead, behind = np.empty((n, longest, k)), np.zeros((n, longest, k))
        ahead[:, 0] = scores[:, 0] + field.first
        for t in range(1, longest):
            ahead[:, t] = np.where(live[:, t, None], _log_sum(ahead[:, t - 1, :, None] + field.step, 1) + scores[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(live[:, t + 1, None], _log_sum(field.step + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
        whole = _log_sum(ahead[:, -1], 1)[:, None, None]
        chance = np.exp(ahead + behind - whole)[live]  # words in order
        miss = -chance
        miss[np.arange(len(tags)), tags] += 1
        grads = [np.zeros_like(w) for w in weights]
        for c in range(own.shape[1]):
            np.add.at(grads[0], own[:, c], miss)
        for c in range(side.shape[1]):
            np.add.at(grads[1], side[:-1][same][:, c], miss[1:][same])
            np.add.at(grads[2], side[1:][same][:, c], miss[:-1][same])
        pair = ahead[:, :-1, :, None] + field.step + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[..., None]
        grads[3] = gold_step - np.exp(pair)[live[:, 1:]].sum(axis=0)
        grads[4] = miss[begins].sum(axis=0)
        for w, g, m, v in zip(weights, grads, *moment):
            g = g / n - decay / n * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(*weights)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def labelled_table(copies: int = 8) -> list[list[tuple[str, str]]]:
    """The labelled sentences, each several times with other digits."""
    rng = np.random.default_rng(5)
    out = []
    for line in (LABELLED + PLAIN).strip().split("\n"):
        for _ in range(copies if line else 0):
            drawn = re.sub("#", lambda _: str(rng.integers(10)), line)
            sentence: list[tuple[str, str]] = []
            for part in re.split(r"(\[(?:email|ip|card|phone):[^\]]*\])", drawn):
                kind, _, inner = part[1:-1].partition(":") if part.startswith("[") and ":" in part else ("O", "", part)
                if kind not in KINDS:
                    kind, inner = "O", part
                pieces = inner.split(" ")
                for k, word in enumerate(pieces):
                    label = kind if kind == "O" or k == 0 or kind in ("email", "ip") else kind + "+"
                    if k == 0 and sentence and sentence[-1][0] != "":  # no blank before: the same word
                        word0, label0 = sentence.pop()
                        sentence.append((word0 + word, label0 if label0 != "O" else label))
                    elif k == 0 and sentence:
                        sentence[-1] = (word, label)
                    else:
                        sentence.append((word, label))
            out.append([(w, t) for w, t in sentence if w])
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


# Whole texts ----------------------------------------------------------------------------------------------


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and its sentence: cut at texts, line breaks and words that end in ``.!?``."""
    gap = texts._SEPARATOR[data]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[edge] = True
    after[edge[edge > 0] - 1] = True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    if not len(start):
        return start, end, start
    stop = np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8))
    lines = np.cumsum(data == 10)
    cut = np.zeros(len(start), bool)
    cut[1:] = stop[:-1] | (lines[start[1:]] > lines[start[:-1]])
    cut[np.searchsorted(start, edge)[np.searchsorted(start, edge) < len(start)]] = True
    return start, end, np.cumsum(cut)


_OPENING, _CLOSING = "\"'<[{", ".,;:!?\"'>]}"


def _plausible(kind: str, text: str) -> bool:
    """What every instance of a kind has; the field may err on shapes it has not seen."""
    digits = len(_NOT_DIGIT.sub("", text))
    if kind == "email":
        return re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", text) is not None
    if kind == "ip":
        return re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", text, re.ASCII) is not None
    low, high = (13, 19) if kind == "card" else (7, 15)
    return low <= digits <= high and re.fullmatch(r"[0-9 ().+-]+", text) is not None and (kind == "card" or not text.isdigit())


def field_spans(field: Field, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """Spans of the field by text number, in bytes of that text."""
    start, end, sentence = _words(data, offsets)
    labels = field.decode(word_shapes(data, start, end), sentence) if len(start) else np.zeros(0, np.int8)
    found: dict[int, list[tuple[str, int, int]]] = {}
    hits = np.flatnonzero(labels)
    k = 0
    while k < len(hits):
        first = last = hits[k]
        kind = LABELS[labels[first]]
        while kind in ("card", "phone") and k + 1 < len(hits) and hits[k + 1] == last + 1 and LABELS[labels[last + 1]] == kind + "+" and sentence[last + 1] == sentence[first]:
            k += 1
            last = hits[k]
        k += 1
        if kind.endswith("+"):  # a continuation of nothing
            continue
        text = int(np.searchsorted(offsets, start[first], side="right")) - 1
        found.setdefault(text, []).append((kind, int(start[first] - offsets[text]), int(end[last] - offsets[text])))
    return found


def _find(batch_texts: pa.Array, field: Field) -> Iterator[list[tuple[str, int, int, bool]]]:
    """For each text, its spans by kind as listed, then start."""
    column = texts.as_strings(batch_texts)
    data, offsets = texts.flat(column)
    for first, last in texts.slices(offsets):
        at = offsets[first : last + 1]
        more = field_spans(field, data[at[0] : at[-1]], at - at[0])
        for k, text in enumerate(column.slice(first, last - first).to_pylist()):
            spans = [(*s, True) for s in base_spans(text)]
            spans += _added(text, spans, more.get(k, []))
            spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
            yield spans


def _added(text: str, base: list[tuple], found: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, bool]]:
    """The field's spans (in bytes, in order) without signs around them, if plausible and apart from all others."""
    if not found:
        return
    taken: list[list[int]] = []  # base spans, united where they touch
    for _, a, b, _ in sorted(base, key=lambda s: s[1]):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    raw, at, chars, free = text.encode(), 0, 0, 0
    for kind, first, last in found:
        a = chars + len(raw[at:first].decode())
        at, chars = last, a + len(raw[first:last].decode())
        b = chars
        while a < b and text[a] in _OPENING:
            a += 1
        while a < b and text[b - 1] in _CLOSING:
            b -= 1
        before = bisect_right(starts, b - 1) - 1  # the last base span that begins before the end
        if a >= free and (before < 0 or taken[before][1] <= a) and _plausible(kind, text[a:b]):
            free = b
            yield kind, a, b, False


def find_personal_data(docs: DataFrame, field: Field | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end in code points, base), by kind as listed, then start.

    ``base`` spans are those of the fixed patterns; the field adds spans that overlap none of them.
    Null or empty text: no spans. A null id stays null. Repeated rows: each is searched. Empty table: no
    rows. Other columns are not read. Whole texts are searched; a very long sentence is decoded whole.
    """
    ship(docs.sparkSession)
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "base"), s)) for s in found] for found in _find(batch.column(1), field)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, spans {SPANS}")


def _masked(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    if not spans:
        return text
    parts, end = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: s[1:3]):
        if a >= end:
            parts += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*parts, text[end:]])


def mask_personal_data(docs: DataFrame, field: Field | None = None, text_column: str = "text") -> DataFrame:
    """The table with every span replaced by its kind, as in ``[EMAIL]``; overlapping spans count as the first.

    Every row stays, with all its columns; texts without spans, and nulls, are unchanged.
    """
    ship(docs.sparkSession)
    field = field or default_field()
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            new = [_masked(t, s) for t, s in zip(column.to_pylist(), _find(column, field))]
            columns = [*batch.columns]
            columns[place] = pa.array(new, column.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
