"""Session settings and the shared scratch folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The cohorts gather a customer's months with an object-hash aggregate. The default of 128 groups makes
    # it fall back to sorting at once; a group here is a short list of month numbers, so many fit.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}

_local_scratch: dict[str, str] = {}


def build_session(name: str = "clientela", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    context = spark.sparkContext
    on_cluster = not context.master.startswith("local")
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        if on_cluster and configured.startswith("file:"):
            warnings.warn("spark.checkpoint.dir is a file: folder; it must be a mount that every executor shares", stacklevel=2)
        return configured.rstrip("/")
    if on_cluster:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_scratch:
        folder = tempfile.mkdtemp(prefix="clientela-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_scratch[app] = folder
    return _local_scratch[app]


_owners: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    owner = f"{_owners[-1]}/" if _owners else ""
    return f"{scratch_root(spark)}/clientela/{owner}{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end; results must have been written by then."""
    _owners.append(f"owner-{uuid.uuid4().hex}")
    folder = f"{scratch_root(spark)}/clientela/{_owners[-1]}"
    try:
        yield
    finally:
        _owners.pop()
        delete_folder(spark, folder)


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete_folder(spark: SparkSession, path: str) -> None:
    store, place = _hadoop(spark, path)
    store.delete(place, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder, or a file, is there."""
    store, place = _hadoop(spark, path)
    return store.exists(place)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    store, place = _hadoop(spark, path)
    return sorted(s.getPath().toString() for s in store.listStatus(place) if s.isDirectory()) if store.exists(place) else []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and return a scan of it.

    Unlike a cache, the table survives lost executors; unlike a checkpoint, later passes read only
    the columns they need and the planner knows the size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
