"""Byte-level BPE by a rank file: encoding with the tokenizers library, offsets, and decoding.

The library works on characters, so each byte stands as one printable character (fixed table of
byte-level vocabularies). A rank file names tokens only; its merges are all ways to join two tokens
into a third, in the order of the third's rank.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.llm import texts
from clientela.llm.tables import ship
from clientela.llm.units import PLAIN, UnitCache, byte_characters, spelled, text_runs

UNKNOWN = "\ufffd".encode()
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_AMID_SPACES = re.compile(f"[{_SPACES}] [{_SPACES}]")
_UNIT_EDGE = re.compile(f"(?<![{_SPACES}])(?= )|(?= [^{_SPACES}])")


#: The pattern keeps a space with the letters after it, and matches a sign after them by itself.
_PLAIN = PLAIN.replace("(", "( ?", 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def build_tokenizer(ranks: dict[bytes, int], pattern: str):
    from tokenizers import Regex, Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

    table = byte_characters()
    spelling = {token: "".join([table[b] for b in token]) for token in ranks}
    merges = [
        (spelling[token[:k]], spelling[token[k:]])
        for token in sorted(ranks, key=ranks.get)
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    ]
    tokenizer = Tokenizer(BPE(vocab={spelling[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


def split_units(text: str) -> list[str]:
    """Cut before each space that begins a match of the pattern, so that the pattern matches within units only."""
    if _AMID_SPACES.search(text):
        return _UNIT_EDGE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + word for word in rest]]


class _Vocabulary:
    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.cache = UnitCache(build_tokenizer(ranks, pattern), split_units, _PLAIN if pattern == PATTERN else r"(?!)", spelled)
        size = max(ranks.values(), default=-1) + 1
        tokens = [UNKNOWN] * (size + 1)  # the last stands for every id without a token
        for token, rank in ranks.items():
            tokens[rank] = token
        self.unknown = size
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)


_vocabularies: dict[tuple[str, str], _Vocabulary] = {}


def _vocabulary(path: str, pattern: str) -> _Vocabulary:
    if (path, pattern) not in _vocabularies:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _vocabularies[path, pattern] = _Vocabulary(path, pattern)
    return _vocabularies[path, pattern]


def character_starts(text: bytes, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Character in which each token's first byte lies; tokens that split a character share its number."""
    data = np.frombuffer(text, np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths[ids])
    return character[ends - lengths[ids]].astype("<u4")


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, pattern)
        for batch in batches:
            for first, run_texts in text_runs(batch.column(1)):
                packed = vocabulary.cache.pack(run_texts)
                ids = np.frombuffer(b"".join(packed), "<u4")
                starts = character_starts("".join(run_texts).encode(), ids, vocabulary.lengths)
                ends = np.cumsum([len(p) // 4 for p in packed])
                before = np.cumsum([0, *[len(t) for t in run_texts[:-1]]])
                offsets = [(starts[e - len(p) // 4 : e] - np.uint32(b)).tobytes() for p, e, b in zip(packed, ends.tolist(), before.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(packed)), pa.array(packed, pa.binary()), pa.array(offsets, pa.binary())],
                    names=["doc_id", "ids", "starts"],
                )

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, starts (both little-endian unsigned 32-bit, one for each token).

    ``starts`` is the character, counted in code points, in which the token begins.

    Null or empty text: no ids. A null id stays null. Repeated rows: each is encoded. Empty table: no
    rows. Other columns are not read. Strings of special tokens are ordinary text. Very long texts are
    encoded whole.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(_encode(ranks_path, pattern), "doc_id long, ids binary, starts binary")


def decode_bytes(packed: bytes, vocabulary: _Vocabulary) -> bytes:
    ids = np.frombuffer(packed, "<u4").astype(np.int64)
    ids = np.minimum(ids, vocabulary.unknown)
    lengths = vocabulary.lengths[ids]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(vocabulary.begins[ids] - (ends - lengths), lengths)
    return vocabulary.bytes[at].tobytes()


def _decode(path: str, pattern: str, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                raw = [decode_bytes(x or b"", vocabulary) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*part.schema.names, "decoded"])

    return run


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, ids_column: str = "ids") -> DataFrame:
    """The table with ``decoded``: the bytes of its ids. An id without a token gives the bytes of U+FFFD; null ids give none."""
    ship(encoded.sparkSession)
    kept = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", decoded binary"
    return kept.mapInArrow(_decode(ranks_path, pattern, kept.columns.index(ids_column)), schema)


def decoded_text(packed: bytes, ranks_path: str, pattern: str) -> str:
    """Text of some ids; where a character is split at either end, U+FFFD stands for its part."""
    return decode_bytes(packed, _vocabulary(ranks_path, pattern)).decode("utf-8", errors="replace")
