"""Reading, shipping and storing tables for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientela.session import scratch_path

_shipped: set[str] = set()


#: Rows of an Arrow batch. Texts are long; Spark's own default would hold tens of megabytes in each task.
TEXTS_PER_BATCH = 2000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of an Arrow batch of packed rows, which the executor and its Python worker hold at the same time.
PACKED_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's code to the executors, once per application: their tasks import it.

    Where the session leaves the size of Arrow batches as Spark has it, it is made smaller.
    """
    app = spark.sparkContext.applicationId
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, str(TEXTS_PER_BATCH))
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix="clientela-code-"), "clientela_code.zip")
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table, written to the shared scratch folder and read back: lineage ends here."""
    return stored_at(df, label)[0]


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``stored``, and the folder, for whoever deletes it once nothing reads it."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{label}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def counters(df: DataFrame, sums: str = "sum") -> np.ndarray:
    """Add up (or, with ``or``, unite) blocks of counters: rows (block int, counts binary of uint32).

    The result has one fixed length whatever the input: number of blocks times block length.
    """

    def add(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(raw, np.uint32)
                if block not in total:
                    total[block] = part.copy()
                elif sums == "or":
                    total[block] |= part
                else:
                    total[block] = np.minimum(total[block].astype(np.uint64) + part, 2**32 - 1).astype(np.uint32)
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array(list(total), pa.int32()), "counts": pa.array([x.tobytes() for x in total.values()], pa.binary())}
        )

    schema = "block int, counts binary"
    parts = shuffle_partitions(df.sparkSession)
    summed = df.repartition(parts, "block").mapInArrow(add, schema)
    rows = {r.block: np.frombuffer(r.counts, np.uint32) for r in summed.collect()}
    if not rows:
        return np.zeros(0, np.uint32)
    empty = np.zeros(len(next(iter(rows.values()))), np.uint32)
    return np.concatenate([rows.get(k, empty) for k in range(max(rows) + 1)])


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: int, default: str):
    before = spark.conf.get(key, default)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def records_per_batch(spark: SparkSession, rows: int):
    """Fewer rows in an Arrow batch while tables of wide rows are stored."""
    return _set(spark, _BATCH_ROWS, rows, "10000")


def bytes_per_batch(spark: SparkSession, most: int = PACKED_BYTES):
    """Smaller Arrow batches while tables of packed rows are stored; a larger row is a batch of its own."""
    return _set(spark, _BATCH_BYTES, most, "67108864")
