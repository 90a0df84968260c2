"""Contact events as a stream: into the log, and into a running table of last contacts.

Each micro-batch is written to a folder named by the stream and the number of the batch, and replaces
itself if it is retried. The stream's name is the id that Spark keeps in its checkpoint, so two streams,
or one started anew from another checkpoint, never write to the same folder.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clientela.plans.contacts import contact_rows, last_contact, read_parts, write_part
from clientela.schemas import CONTACT_LOG
from clientela.session import delete_folder, list_folders

LAST_CONTACT = "customer_id string, last_contact timestamp"


def contact_events(spark: SparkSession, folder: str, file_format: str = "json", files_per_batch: int = 1000) -> DataFrame:
    """Stream of contact events dropped as files into ``folder``."""
    reader = spark.readStream.schema(CONTACT_LOG).format(file_format)
    return reader.option("maxFilesPerTrigger", files_per_batch).load(folder)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def _each_batch(events: DataFrame, checkpoint: str, write) -> StreamingQuery:
    def handle(batch: DataFrame, number: int) -> None:
        write(batch, _stream_id(batch.sparkSession, checkpoint), number)

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def ingest_contacts(events: DataFrame, log_path: str, checkpoint: str, rejected_path: str | None = None) -> StreamingQuery:
    """Add all waiting events to the log folder, each exactly once, then stop.

    Events without a time, as malformed records are read, go to ``rejected_path`` (``<log_path>-rejected``)
    and the rest arrives.
    """
    rejected = rejected_path or f"{log_path.rstrip('/')}-rejected"

    def write(batch: DataFrame, stream: str, number: int) -> None:
        timed = F.col("timestamp").isNotNull()
        write_part(contact_rows(batch.where(timed)), log_path, stream, number)
        write_part(batch.where(~timed), rejected, stream, number)

    return _each_batch(events, checkpoint, write)


def track_last_contact(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the last contact per customer current.

    Each batch is reduced to its own maxima. ``max`` merges, so no state is kept between batches and late
    or repeated events do no harm; :func:`current_last_contact` merges the batches when read.
    """

    def write(batch: DataFrame, stream: str, number: int) -> None:
        write_part(last_contact(batch.where("timestamp IS NOT NULL")), path, stream, number)

    return _each_batch(events, checkpoint, write)


def current_last_contact(spark: SparkSession, path: str) -> DataFrame:
    partial = read_parts(spark, path, LAST_CONTACT)
    return partial.groupBy("customer_id").agg(F.max("last_contact").alias("last_contact"))


def compact_last_contact(spark: SparkSession, path: str, name: str) -> None:
    """Fold all batches written so far into one part called ``name``, and delete them.

    The part is complete before any batch is deleted, and maxima may be counted twice, so readers see the
    right table throughout and a compaction that breaks off can be run again under another name. Run it
    while no stream writes to ``path``: a batch that is retried later would only repeat itself.
    """
    old = [folder for source in list_folders(spark, path) for folder in list_folders(spark, source)]
    write_part(current_last_contact(spark, path), path, "compacted", name)
    for folder in old:
        if not folder.endswith(f"/source=compacted/part={name}"):
            delete_folder(spark, folder)
