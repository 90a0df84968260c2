"""Contact log: creation, batch append and the views of it."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientela.functions.text import headed
from clientela.functions.times import zone_text
from clientela.labels import HISTORY_HEADERS, MINUTE_TEXT
from clientela.schemas import CONTACT_LOG
from clientela.streaming.log_days import read_log

LATEST_EVENTS = 50
LATEST_SHOWN = 10


def ensure_contact_log(spark: SparkSession, table: str = "contact_log") -> DataFrame:
    """Create the log table with its schema unless it exists; return it."""
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in CONTACT_LOG.fields
    )
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet")
    return spark.table(table)


def contact_rows(contacts: DataFrame, fixed: Mapping[str, Column] | None = None) -> DataFrame:
    """The seven log columns of a batch; ids and phones become text, a missing time column means now.

    A row whose time is null is refused, as the column is required.
    """
    values = {name: F.col(name) for name in contacts.columns} | dict(fixed or {})
    time = values.get("timestamp", F.current_timestamp()).cast("timestamp")
    required = F.when(time.isNull(), F.raise_error(F.lit("a contact needs a timestamp"))).otherwise(time)
    texts = [
        values.get(field.name, F.lit(None)).cast("string").alias(field.name)
        for field in CONTACT_LOG.fields
        if field.name != "timestamp"
    ]
    return contacts.select(required.alias("timestamp"), *texts)


def append_to_table(contacts: DataFrame, table: str = "contact_log") -> None:
    """Append a batch to the catalog table made by :func:`ensure_contact_log`."""
    ensure_contact_log(contacts.sparkSession, table)
    contact_rows(contacts).write.insertInto(table)


def append_contacts(contacts: DataFrame, path: str, batch: str | None = None) -> None:
    """Add a batch of contacts to the log folder, in a folder of its own.

    A batch written again under its name replaces itself; without a name it gets a new one.
    """
    write_part(contact_rows(contacts), path, "batch", batch or uuid.uuid4().hex)


def write_part(rows: DataFrame, path: str, source: str, part: str | int) -> None:
    """One part of a log folder: ``<path>/source=<source>/part=<part>``. Readers see the parts of all sources."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/source={source}/part={part}")


def read_parts(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def read_contact_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a log folder, whoever wrote them, folded into days or not."""
    return read_log(spark, path)


def last_contact(log: DataFrame) -> DataFrame:
    return log.groupBy("customer_id").agg(F.max("timestamp").alias("last_contact"))


def contact_history(log: DataFrame, customer_id: str) -> DataFrame:
    """Contacts of one customer, newest first."""
    chosen = log.where(F.col("customer_id") == customer_id)
    ordered = chosen.orderBy(F.desc("timestamp"), "message_type", "message_body")
    return ordered.selectExpr(f"{zone_text(log, 'timestamp', MINUTE_TEXT)} AS timestamp", "message_type", "message_body")


def headed_history(history: DataFrame) -> DataFrame:
    return headed(history, HISTORY_HEADERS)


def latest_events(log: DataFrame, n: int = LATEST_EVENTS) -> DataFrame:
    """The newest ``n`` contacts of all customers."""
    newest = log.orderBy(F.desc("timestamp"), "customer_name", "segment", "message_type").limit(n)
    text = zone_text(log, "timestamp", MINUTE_TEXT)
    return newest.selectExpr(f"{text} AS timestamp", "customer_name", "segment", "message_type")
