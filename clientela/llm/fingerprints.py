"""Bottom-k sketches of word-shingle sets: the k smallest hashes of a text's distinct shingles.

A sketch of a whole follows from sketches of its parts: the k smallest of their union. From two
sketches follow resemblance, containment and the number of distinct shingles; sets of fewer than k
shingles are held whole, and then all three are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.llm import texts
from clientela.llm.tables import ship, shuffle_partitions

K = 128
HASH_BITS = 48  # the upper bits of a shingle's hash, so the order of hashes is kept
MERGE_AT = 20_000


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of some shingle hashes: distinct, ascending, the k smallest."""
    return np.unique(hashes >> np.uint64(64 - HASH_BITS))[:k]


def merge(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.zeros(0, np.uint64)


def _shared_below(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    """(hashes in both, hashes) among the k smallest of the union, all of which either sketch can vouch for."""
    joint = np.union1d(a, b)[:k]
    both = np.isin(joint, a, assume_unique=True) & np.isin(joint, b, assume_unique=True)
    return int(both.sum()), len(joint)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of two sets; two empty sets are alike."""
    both, size = _shared_below(a, b, k)
    return both / size if size else 1.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**HASH_BITS / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; an empty set is contained in all."""
    if not len(a):
        return 1.0
    both, size = _shared_below(a, b, k)
    return min(1.0, both / size * distinct(merge([a, b], k), k) / distinct(a, k))


def as_text(sketch: np.ndarray) -> str:
    """The sketch as base64 of its hashes, six bytes each, the highest first."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.hstack([np.zeros((len(raw), 2), np.uint8), raw]).view(">u8").ravel().astype(np.uint64)


def sketches(column: pa.Array, k: int = K) -> Iterator[np.ndarray]:
    """A sketch for each text."""
    for first, last, text, hashes in texts.shingle_sets(texts.as_strings(column)):
        edges = np.searchsorted(text, np.arange(last - first + 1))
        for a, b in zip(edges[:-1], edges[1:]):
            # hashes ascend; shingles that agree in the upper bits are one
            yield bottom(hashes[a : min(b, a + 2 * k)], k) if b - a > 2 * k else bottom(hashes[a:b], k)


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K) -> DataFrame:
    """One row per document: doc_id, fingerprint, n_shingles (estimated). Null or empty text: an empty sketch."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sketches(batch.column(1), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([as_text(s) for s in found], pa.string()), pa.array([distinct(s, k) for s in found], pa.float64())],
                names=["doc_id", "fingerprint", "n_shingles"],
            )

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def merge_fingerprints(parts: DataFrame, key: str, column: str = "fingerprint", k: int = K) -> DataFrame:
    """(key, fingerprint) of wholes from their parts: merged in each partition first, then by key."""
    ship(parts.sparkSession)

    source = parts.select(F.col(key).alias("key"), F.col(column).alias("fingerprint"))
    partial = source.mapInArrow(_merge_batches(k, MERGE_AT), source.schema)
    # each key is in one partition now; the keys of a partition come one after another
    whole = partial.repartition("key").sortWithinPartitions("key").mapInArrow(_merge_batches(k, 1), source.schema)
    return whole.select(F.col("key").alias(key), "fingerprint")


def _merge_batches(k: int, most: int):
    """Merge rows of one key; at most ``most`` keys are held, and the last one met is always held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            kind = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in held and len(held) >= most:
                    yield _merged(held, kind)
                    held.clear()
                sketch = from_text(text or "")
                held[name] = merge([held[name], sketch], k) if name in held else sketch
        if held:
            yield _merged(held, kind)

    return run


def _merged(held: dict, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([as_text(s) for s in held.values()], pa.string())], names=["key", "fingerprint"])


# Each document beside its successor -------------------------------------------------------------------


def _with_successors(docs: DataFrame) -> DataFrame:
    """Documents in runs of ascending id, each run followed by the first document of the next one.

    Columns: bucket, follows (the row only ends the run), key, doc_id, text; sorted within partitions.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    buckets = 4 * shuffle_partitions(spark)
    found = keyed.approxQuantile("key", [k / buckets for k in range(1, buckets)], 0.2 / buckets)
    bounds = np.unique(np.array(found, dtype=np.float64))

    @F.pandas_udf("int")
    def bucket_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy().astype(np.float64), side="right").astype(np.int32))

    least = keyed.select("key", bucket_of("key").alias("bucket")).groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").collect()
    before = {b.key: a.bucket for a, b in zip([*least[-1:], *least[:-1]], least)}  # the first document ends the last run

    @F.pandas_udf("array<int>")
    def runs_of(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, keys.to_numpy().astype(np.float64), side="right")
        return pd.Series([[b, before[k]] if k in before else [b] for b, k in zip(at.tolist(), keys.tolist())])

    rows = keyed.select("*", F.posexplode(runs_of("key")).alias("follows", "bucket"))
    return rows.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "follows", "key", "text")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []  # (bucket, follows, doc_id, text)
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
            held.append(row)
            size += len(row[3])
            if size > 1 << 20 and len(held) > 1:
                yield _pairs(held)
                held, size = held[-1:], len(row[3])
    if held:
        yield _pairs(held)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    own = list(sketches(pa.array([r[3] for r in rows], pa.string())))
    pairs = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][1]]
    changed = []
    for k in pairs:
        text, following = rows[k][3], rows[k + 1][3]
        half = len(text) // 2
        changed.append(text[: len(text) - half] + following[:half])
    new = list(sketches(pa.array(changed, pa.string())))
    columns = [
        pa.array([rows[k][2] for k in pairs], pa.int64()),
        pa.array([len(rows[k][3]) for k in pairs], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array([as_text(own[k]) for k in pairs], pa.string()),
        pa.array([as_text(s) for s in new], pa.string()),
        pa.array([resemblance(own[k], s) for k, s in zip(pairs, new)], pa.float64()),
        pa.array([resemblance(own[k], own[k + 1]) for k in pairs], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def compare_edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its sketch, its edited text's, and their likeness, and that to the next document's.

    The edited text has the last half of the code points (rounded down) replaced by the first as many of
    the next document by id; the first document follows the last. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text is empty. Empty sets are alike to each other and unlike others. Repeated ids go by text;
    null ids come first. A single document follows itself. Empty table: no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_successors(source).select("bucket", "follows", "doc_id", "text").mapInArrow(_edited, schema)
