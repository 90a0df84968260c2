"""Hard negatives by exact inner products in a residue number system.

Components are whole numbers. Their residues modulo several small primes are multiplied as float32
matrices; the primes are so small that every float32 sum is exact. The Chinese remainder theorem, in mixed
radix, gives back the signed product. The number of primes follows from the largest component.

Rows are dealt to blocks of bounded size, and every block of anchors (the stated query set) meets every
block of rows, twice: first for the anchors' positives, with rows of the same label only, then for the
negatives in the window below each positive's score. A block hands on its best few, never its scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientela.llm.tables import records_per_batch, ship, stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this share of the positive's, in fifths: 4 / 5.
WINDOW_FIFTHS = 4
ANCHOR_STEP = 100
BLOCK_BYTES = 2 << 20
ANCHORS_IN_BLOCK = 256
PAIRS_PER_BATCH = 4
COLUMNS_AT_ONCE = 256
_EXACT = 1 << 24  # whole numbers up to here are exact in float32
_LONG = 2**63 - 1


def scaled_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, v, top): floor(256 x) as doubles in bytes, and the batch's largest component; unusable rows are left out."""
    for batch in batches:
        ids, labels, vectors = batch.columns
        offsets = vectors.offsets.to_numpy().astype(np.int64)
        values = vectors.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(SCALE * values.to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
        unusable = np.r_[0, np.cumsum(~np.isfinite(x))]
        usable = (unusable[offsets[1:]] == unusable[offsets[:-1]]) & np.array(ids.is_valid()) & np.array(labels.is_valid()) & np.array(vectors.is_valid())
        rows = np.flatnonzero(usable)
        packed = [x[offsets[i] : offsets[i + 1]].tobytes() for i in rows.tolist()]
        top = np.abs(x[np.isfinite(x)]).max(initial=0)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows)), labels.take(pa.array(rows)), pa.array(packed, pa.binary()), pa.array(np.full(len(rows), top))],
            names=["vec_id", "label", "v", "top"],
        )


def _primes_to(most: int) -> list[int]:
    """Odd primes up to ``most``, largest first."""
    sieve = np.ones(most + 1, dtype=bool)
    sieve[:3] = False
    sieve[4::2] = False
    for p in range(3, isqrt(most) + 1, 2):
        if sieve[p]:
            sieve[p * p :: p] = False
    return np.flatnonzero(sieve)[::-1].tolist()


def moduli(top: int, width: int) -> tuple[list[int], int]:
    """Primes whose product exceeds twice any inner product, and how many columns one float32 sum may take."""
    wanted = 2 * top * top * max(width, 1) + 1
    columns = max(1, min(width, COLUMNS_AT_ONCE))
    while True:
        chosen, product = [], 1
        for p in _primes_to(2 * isqrt((_EXACT - 1) // columns) + 1):  # residues lie between -(p - 1) / 2 and (p - 1) / 2
            chosen.append(p)
            product *= p
            if product > wanted:
                return chosen, columns
        columns //= 2  # fewer columns a sum allow larger primes; one column is enough for any double


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Centred residues of whole numbers held as doubles (a remainder of doubles is exact), as float32."""
    out = []
    for p in primes:
        r = np.fmod(x, p)
        r = np.where(r > p // 2, r - p, np.where(r < -(p // 2), r + p, r))
        out.append(r.astype(np.float32))
    return out


def signed_products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int], columns: int) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, from their residues; held to the range of a long."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        total = np.zeros((len(a[k]), len(b[k])), np.int64)
        for first in range(0, a[k].shape[1], columns):
            part = slice(first, first + columns)
            total += (a[k][:, part] @ b[k][:, part].T).astype(np.int64)
        for earlier, digit in zip(primes, digits):
            total = (total - digit) % p * pow(earlier, -1, p)
        digits.append(total % p)
    product = 1
    for p in primes:
        product *= p
    small = product < 2**62
    value = digits[-1] if small else digits[-1].astype(object)
    for p, digit in zip(primes[-2::-1], digits[-2::-1]):
        value = value * p + digit
    value = np.where(value > product // 2, value - product, value)
    return value if small else np.minimum(np.maximum(value, -_LONG - 1), _LONG).astype(np.int64)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of one width; a shorter vector ends in zeros."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(part.ljust(8 * width, b"\0") for part in raw)).reshape(len(raw), width)


def _pairs(batches: Iterator[pa.RecordBatch], primes: list[int], width: int):
    """(anchors, their residues, rows, their residues) of every pair of blocks; rows are prepared once for pairs in a row."""
    held, rows, row_parts = None, None, None
    for batch in batches:
        for k in range(batch.num_rows):
            block = batch.column(0)[k].as_py()
            anchors = batch.column(1)[k].values
            if block != held:
                rows = batch.column(2)[k].values
                held, row_parts = block, residues(_matrix(rows.field("v"), width), primes)
            yield anchors, residues(_matrix(anchors.field("v"), width), primes), rows, row_parts


def _best(at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """By score, highest first, then id; rows of one id with one score count once."""
    at = at[np.lexsort((ids[at], ~scores[at]))]
    if len(at) > 1:
        at = at[np.r_[True, (scores[at][1:] != scores[at][:-1]) | (ids[at][1:] != ids[at][:-1])]]
    return at


def _positives(primes: list[int], columns: int, width: int, wanted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, a, rows, b in _pairs(batches, primes, width):
            anchor_ids, anchor_labels, keys = (_numbers(anchors.field(c)) for c in ("vec_id", "label", "key"))
            ids, labels = _numbers(rows.field("vec_id")), _numbers(rows.field("label"))
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for label in np.intersect1d(anchor_labels, labels):
                mine, theirs = np.flatnonzero(anchor_labels == label), np.flatnonzero(labels == label)
                scores = signed_products([r[mine] for r in a], [r[theirs] for r in b], primes, columns)
                for i, row in zip(mine.tolist(), scores):
                    at = np.flatnonzero(ids[theirs] != anchor_ids[i])
                    at = _best(at, row, ids[theirs])[:wanted]
                    own = np.full(len(at), anchor_ids[i]), np.full(len(at), keys[i])
                    for column, part in zip(out, (*own, ids[theirs][at], row[at])):
                        column.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["anchor_id", "key", "positive_id", "positive_score"])

    return run


def _negatives(primes: list[int], columns: int, width: int, wanted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, a, rows, b in _pairs(batches, primes, width):
            anchor_ids, anchor_labels, keys = (_numbers(anchors.field(c)) for c in ("vec_id", "label", "key"))
            ids, labels = _numbers(rows.field("vec_id")), _numbers(rows.field("label"))
            scores = signed_products(a, b, primes, columns)
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]
            for i, positives in enumerate(anchors.field("positives").to_pylist()):
                row, highs = scores[i], np.array([p["positive_score"] for p in positives], np.int64)
                lows = highs - highs // (5 // (5 - WINDOW_FIFTHS))  # 4 / 5 of it, rounded up, without overflow
                at = np.flatnonzero((labels != anchor_labels[i]) & (ids != anchor_ids[i]) & (row >= lows.min()) & (row <= highs.max()))
                if not len(at):
                    continue
                at = _best(at, row, ids)
                falling = row[at]
                first = np.searchsorted(~falling, ~highs)  # ~ turns the order round
                for positive, high, low, begin in zip(positives, highs.tolist(), lows.tolist(), first.tolist()):
                    found = at[begin : begin + wanted]
                    found = found[row[found] >= low]
                    own = (anchor_ids[i], keys[i], positive["positive_id"], high)
                    for column, part in zip(out, (*(np.full(len(found), x, np.int64) for x in own), ids[found], row[found])):
                        column.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in out], names=["anchor_id", "key", "positive_id", "positive_score", "negative_id", "negative_score"]
            )

    return run


def _blocks(rows: DataFrame, blocks: int, *columns: str) -> DataFrame:
    """One row per block; the block follows from the whole row, so that many rows of one id spread."""
    return rows.groupBy(F.pmod("key", F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(*columns)).alias("members"))


def _met(anchors: DataFrame, data: DataFrame, blocks: int) -> DataFrame:
    """Every block of anchors beside every block of rows."""
    everywhere = anchors.select(F.col("members").alias("anchors"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return everywhere.join(data.select(F.col("block").cast("int").alias("block"), "members").hint("merge"), "block").select("block", "anchors", "members")


def _first(rows: DataFrame, by: list[str], score: str, own: str, wanted: int, rank: str) -> DataFrame:
    """The first ``wanted`` rows of each group: by score, highest first, then id; repeats count once."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), own))
    return rows.repartition(*by).distinct().withColumn(rank, place).where(F.col(rank) <= wanted)


def hard_negatives(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    step: int = ANCHOR_STEP, positives: int = POSITIVES, negatives: int = NEGATIVES,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``step``. The score of a row is its inner product with
    the anchor, of the vectors floor(256 x); higher scores come first, ties by smaller id. An anchor's
    positives are its first rows of the same label. For each, the first rows of other labels are returned
    whose score s keeps 4/5 p <= s <= p, where p is the positive's score. Rows of the anchor's own id are neither.

    Rows with a null id, label or vector, or with a null or non-finite component (also after scaling), take
    no part. Rows repeated in full count once; an id with several vectors or labels is an anchor with each, and
    equal scores of one id count once. Vectors of different lengths are compared as if the shorter ended in
    zeros. Scores beyond a long are held at its ends. A positive without such rows, or an anchor without
    positives, gives no rows; an empty table gives none. Other columns are not read.
    """
    spark = ship(vectors.sparkSession)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    source = vectors.select(F.col(id_column).cast("long"), F.col(label_column).cast("long"), F.col(vector_column).cast("array<double>"))
    scaled = source.mapInArrow(scaled_vectors, "vec_id long, label long, v binary, top double")
    found = stored(scaled.groupBy("vec_id", "label", "v").agg(F.max("top").alias("top")).withColumn("key", F.xxhash64("vec_id", "label", "v")), "vectors")
    anchor = F.col("vec_id") % step == 0
    n, width, top, n_anchors = found.agg(F.count("*"), F.max(F.octet_length("v")), F.max("top"), F.count_if(anchor)).first()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    width = max(width // 8, 1)
    primes, columns = moduli(int(top), width)
    blocks = -(-n * 8 * width // BLOCK_BYTES)
    anchor_blocks = -(-n_anchors // max(1, min(ANCHORS_IN_BLOCK, BLOCK_BYTES // (8 * width))))
    data = stored(_blocks(found, blocks, "vec_id", "label", "v"), "blocks")
    anchors = found.where(anchor)
    of_anchor = ["anchor_id", "key"]
    with records_per_batch(spark, PAIRS_PER_BATCH):
        met = _met(_blocks(anchors, anchor_blocks, "vec_id", "label", "key", "v"), data, blocks)
        near = stored(met.mapInArrow(_positives(primes, columns, width, positives), "anchor_id long, key long, positive_id long, positive_score long"), "positives")
        chosen = _first(near, of_anchor, "positive_score", "positive_id", positives, "place")
        windows = chosen.groupBy(*of_anchor).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
        anchors = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "key"])
        met = _met(_blocks(anchors, anchor_blocks, "vec_id", "label", "key", "v", "positives"), data, blocks)
        fields = "anchor_id long, key long, positive_id long, positive_score long, negative_id long, negative_score long"
        below = stored(met.mapInArrow(_negatives(primes, columns, width, negatives), fields), "negatives")
    best = _first(below, [*of_anchor, "positive_id", "positive_score"], "negative_score", "negative_id", negatives, "rank")
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(label: Column, own: Column, every: int, labels: int) -> Column:
    """The next label for rows whose id is divisible by ``every``: planted label noise."""
    return F.when(own % every == 0, (label + 1) % labels).otherwise(label)
