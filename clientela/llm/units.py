"""Token ids of whole texts, by units that no token crosses.

A unit is a stretch of text whose ids do not depend on what surrounds it. Texts repeat units, so each
distinct one is encoded once and kept, up to a bound, for the life of the Python worker.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

KEPT_UNITS = 200_000
KEPT_WORDS = 400_000
KEPT_LENGTH = 48
ENCODE_AT_ONCE = 20_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable in Latin-1, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_SPELLING = dict(enumerate(byte_characters()))
#: A word of Latin letters, and a full stop or comma after it. These letters are composed, and except for
#: the dotted I their small forms are letters that do not depend on their neighbours.
PLAIN = r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,]?)"
#: Signs that only join signs; the apostrophe begins short forms, and the opening angle bracket special tokens.
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<")


def spelled(text: str) -> str:
    """The text as byte-level models see it: one character for each byte."""
    return text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(_SPELLING)

_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


class UnitCache:
    """Packed ids (little-endian unsigned 32-bit) of texts, unit by unit."""

    def __init__(
        self, tokenizer, split: Callable[[str], list[str]], plain: str, model_word: Callable[[str], str],
        ascii_word: Callable[[str], str] | None = None, signs: str = "", kept_units: int = KEPT_UNITS, kept_words: int = KEPT_WORDS,
    ):
        """``plain``: units of one letter word and a sign, each a word of the library's model; ``model_word``: how it spells the former.

        ``ascii_word`` does the same for words of ASCII letters alone, and saves them the pattern; any run of ``signs``
        after such a word must be a word of the model as well. ``kept_units`` and ``kept_words``: how many of them stay from
        call to call.
        """
        self.kept_units = kept_units
        self.kept_words = kept_words
        self.tokenizer = tokenizer
        self.tokenize = tokenizer.model.tokenize
        self.split = split
        self.plain = re.compile(plain)
        self.model_word = model_word
        self.ascii_word = ascii_word
        self.kept: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.signs = signs

    def _model(self, word: str) -> bytes:
        ids = [token.id for token in self.tokenize(word)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _found(self, units: Iterable[str]) -> dict[str, bytes]:
        """Ids of units: plain ones by the library's model, all others by its whole pipeline."""
        found, others = {}, []
        match, words, signs, model_word, ascii_word, model = self.plain.fullmatch, self.words, self.signs, self.model_word, self.ascii_word, self._model
        for unit in units:
            word = unit.rstrip(signs)
            if ascii_word and word.isascii() and word.isalpha():
                sign = unit[len(word) :]
                word = ascii_word(word)
            else:
                plain = match(unit)
                if plain is None:
                    others.append(unit)
                    continue
                word, sign = model_word(plain[1]), plain[2]
            ids = words.get(word)
            if ids is None:
                ids = words[word] = model(word)
            if sign:
                tail = words.get(sign)
                if tail is None:
                    tail = words[sign] = model(sign)
                ids += tail
            found[unit] = ids
        found.update(self._encoded(others))
        return found

    def _encoded(self, units: list[str]) -> Iterable[tuple[str, bytes]]:
        for first in range(0, len(units), ENCODE_AT_ONCE):
            part = units[first : first + ENCODE_AT_ONCE]
            encoding = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(encoding.ids, dtype="<u4")
            words = np.array([-1 if w is None else w for w in encoding.word_ids], dtype=np.int64)
            edges = np.searchsorted(words, np.arange(len(part) + 1)) * 4
            raw = ids.tobytes()
            yield from ((unit, raw[a:b]) for unit, a, b in zip(part, edges[:-1].tolist(), edges[1:].tolist()))

    def pack(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self.kept) > self.kept_units:
            self.kept.clear()
        if len(self.words) > self.kept_words:
            self.words.clear()
        known = self.kept
        split = [self.split(text) for text in texts]
        missing: set[str] = set()
        for units in split:
            missing.update(units)
        missing.difference_update(known)
        if missing:
            known.update(self._found(missing))
        get = known.__getitem__
        packed = [b"".join(map(get, units)) for units in split]
        for unit in missing:
            if len(unit) > KEPT_LENGTH:
                del known[unit]
        return packed


def text_runs(column: pa.Array, most: int = 1 << 20) -> Iterable[tuple[int, list[str]]]:
    """(first row, texts) in runs of about ``most`` characters; null is the empty text."""
    first, run, size = 0, [], 0
    for k, text in enumerate(column.to_pylist()):
        text = text or ""
        if run and size + len(text) > most:
            yield first, run
            first, run, size = k, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield first, run
