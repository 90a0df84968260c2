"""Folding the parts of a contact log into one table by day, so that its files follow the days, not the batches.

A fold reads the parts that are complete and the stored days they touch, writes these days anew under
``<log>/_closed/fold=<n>``, and then one manifest that names all days' folders and all folded parts. Readers go by the
newest manifest, so they see every row once before, while and after a fold runs, and a fold that breaks off
changes nothing. What a manifest replaces is deleted by the next fold: readers have one interval to finish.
Streams may go on writing: a batch that is retried after it was folded is known by its number and left out.
One fold runs at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from clientela.schemas import CONTACT_LOG
from clientela.session import delete_folder, folder_exists, list_folders

_CLOSED = "_closed"
#: The source whose parts have names of their own; those of streams are numbered in order.
_NAMED = "source=batch"
#: Days are UTC and numbered, so that a folder's name doesn't depend on the session.
_DAY = "CAST(floor(unix_micros(timestamp) / 86400000000) AS INT) AS day"


@dataclass
class _Manifest:
    number: int = 0
    days: dict[str, str] = field(default_factory=dict)  # folder below _closed -> day
    parts: set[str] = field(default_factory=set)  # folded parts with a name
    last: dict[str, int] = field(default_factory=dict)  # the last folded part of a stream

    def folded(self, part: str) -> bool:
        source, name = part.split("/")
        number = name.removeprefix("part=")
        if source != _NAMED and number.isdigit():
            return int(number) <= self.last.get(source, -1)
        return part in self.parts

    def note(self, part: str) -> None:
        source, name = part.split("/")
        number = name.removeprefix("part=")
        if source != _NAMED and number.isdigit():
            self.last[source] = max(int(number), self.last.get(source, -1))
        else:
            self.parts.add(part)

    def rows(self) -> list[tuple[str, str, str]]:
        kept = [("day", folder, day) for folder, day in self.days.items()] + [("part", part, "") for part in self.parts]
        return kept + [("last", source, str(number)) for source, number in self.last.items()]


def _below(folder: str, levels: int) -> str:
    return "/".join(folder.rstrip("/").rsplit("/", levels)[1:])


def _read_manifest(spark: SparkSession, path: str) -> _Manifest:
    numbers = [int(f.rsplit("=", 1)[1]) for f in list_folders(spark, f"{path}/{_CLOSED}") if _below(f, 1).startswith("manifest=")]
    for number in sorted(numbers, reverse=True):
        folder = f"{path}/{_CLOSED}/manifest={number}"
        if not folder_exists(spark, f"{folder}/_SUCCESS"):
            continue
        found = _Manifest(number)
        for kind, name, value in spark.read.schema("kind string, name string, value string").parquet(folder).collect():
            if kind == "day":
                found.days[name] = value
            elif kind == "part":
                found.parts.add(name)
            else:
                found.last[name] = int(value)
        return found
    return _Manifest()


def _parts(spark: SparkSession, path: str) -> list[str]:
    return [_below(part, 2) for source in list_folders(spark, path) if _below(source, 1).startswith("source=") for part in list_folders(spark, source)]


def _rows(spark: SparkSession, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], CONTACT_LOG)
    return spark.read.schema(CONTACT_LOG).option("recursiveFileLookup", "true").parquet(*folders)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log: the stored days, and the parts that no fold has taken yet."""
    path = path.rstrip("/")
    manifest = _read_manifest(spark, path)
    if not manifest.number:
        return _rows(spark, [path])
    waiting = [f"{path}/{part}" for part in _parts(spark, path) if not manifest.folded(part)]
    return _rows(spark, [f"{path}/{_CLOSED}/{folder}" for folder in manifest.days] + waiting)


def fold_log(spark: SparkSession, path: str) -> None:
    """Take all complete parts into the days. A hot day is split into several files by adaptive execution."""
    path = path.rstrip("/")
    manifest = _read_manifest(spark, path)
    _clear(spark, path, manifest)
    new = [p for p in _parts(spark, path) if not manifest.folded(p) and folder_exists(spark, f"{path}/{p}/_SUCCESS")]
    if not new:
        return
    parts = _rows(spark, [f"{path}/{p}" for p in new])
    touched = {str(row.day) for row in parts.selectExpr(_DAY).distinct().collect()}
    again = [folder for folder, day in manifest.days.items() if day in touched]
    rows = _rows(spark, [f"{path}/{p}" for p in new] + [f"{path}/{_CLOSED}/{folder}" for folder in again])
    number = manifest.number + 1
    ordered = rows.selectExpr("*", _DAY).hint("rebalance", "day").sortWithinPartitions("day", "customer_id", "timestamp")
    ordered.write.mode("overwrite").partitionBy("day").parquet(f"{path}/{_CLOSED}/fold={number}")
    for folder in again:
        del manifest.days[folder]
    manifest.days |= {f"fold={number}/day={day}": day for day in touched}
    for part in new:
        manifest.note(part)
    told = spark.createDataFrame(manifest.rows(), "kind string, name string, value string").coalesce(1)
    told.write.mode("overwrite").parquet(f"{path}/{_CLOSED}/manifest={number}")


def _clear(spark: SparkSession, path: str, manifest: _Manifest) -> None:
    """Delete what the manifest no longer needs."""
    for part in _parts(spark, path):
        if manifest.folded(part):
            delete_folder(spark, f"{path}/{part}")
    for folder in list_folders(spark, f"{path}/{_CLOSED}"):
        name = _below(folder, 1)
        if name.startswith("fold="):
            for day in list_folders(spark, folder):
                if _below(day, 2) not in manifest.days:
                    delete_folder(spark, day)
        elif name != f"manifest={manifest.number}":
            delete_folder(spark, folder)
