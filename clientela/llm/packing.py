"""Packing by power-of-two decomposition: no sequence crosses documents, and none is padded.

A document's ids are cut into pieces of 2^k ids: as many pieces of the longest sequence length as fit,
then the binary digits of the rest, longest first. Each piece is a sequence. Pieces of one length make
a bucket, from which batches of one length are drawn; sequence ids are grouped by bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.llm.tables import ship
from clientela.llm.units import KEPT_UNITS, KEPT_WORDS, PLAIN, SIGNS, UnitCache, spelled, text_runs

LONGEST = 4096
END_ID = 2
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

_caches: dict[tuple[str, int, int], UnitCache] = {}


def _cache(vocabulary: str, kept_units: int = KEPT_UNITS, kept_words: int = KEPT_WORDS) -> UnitCache:
    own = (vocabulary, kept_units, kept_words)
    if own not in _caches:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # white space is dropped and case folded; a space or a line break parts units
        _caches[own] = UnitCache(
            Tokenizer.from_file(vocabulary), lambda text: text.replace("\n", " ").split(" "), PLAIN, lambda word: spelled(word.lower()), str.lower, SIGNS,
            kept_units, kept_words,
        )
    return _caches[own]


def piece_lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pack(vocabulary: str, end_id: int, longest: int, kept_units: int = KEPT_UNITS, kept_words: int = KEPT_WORDS):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(vocabulary, kept_units, kept_words)
        partition = TaskContext.get().partitionId()
        used = [0] * longest.bit_length()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in text_runs(batch.column(1)):
                rows: list[tuple] = []
                for own, packed in zip(ids[first:], cache.pack(texts)):
                    packed += end
                    tokens, start = len(packed) // 4, 0
                    for length in piece_lengths(tokens, longest):
                        k = length.bit_length() - 1
                        sequence = (k << 59) | (partition << 35) | used[k]
                        used[k] += 1
                        rows.append((own, start, length, packed[4 * start : 4 * (start + length)], tokens, sequence, 0))
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return run


def pack_documents(
    docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text",
    end_id: int = END_ID, longest: int = LONGEST, kept_units: int = KEPT_UNITS, kept_words: int = KEPT_WORDS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``longest`` is a power of two up to 4096; ``length`` is the piece's bucket. ``sequence_id`` holds the bucket,
    the partition and a running number, so ids of one bucket lie together and no counting pass is needed.

    A worker keeps the ids of ``kept_units`` units and ``kept_words`` words; fewer take less memory, and the same ids come out.

    Null or empty text: one piece with the end id. A null id stays null. Repeated rows: each is packed.
    Empty table: no rows. Other columns are not read. Very long texts give more pieces.
    """
    if longest & (longest - 1) or not 0 < longest <= LONGEST:
        raise ValueError("longest must be a power of two up to 4096")
    ship(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(_pack(vocabulary, end_id, longest, kept_units, kept_words), PIECES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, so that a reader draws batches of equal sequences."""
    pieces.write.partitionBy("length").parquet(path)
