"""Campaign queue: whom to contact, when they were last contacted, and the message to send."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela import labels
from clientela.functions.text import clean_phone, fill, first_word, headed, percent_encode
from clientela.functions.times import zone_text
from clientela.operators.joins import join_unique
from clientela.plans.rfm import in_segment

SHORTEST_PHONE = 6


def campaign_audience(
    segments: DataFrame,
    last_contact: DataFrame,
    segment: str = labels.ALL_SEGMENTS,
    name: str | None = None,
    phone_only: bool = True,
) -> DataFrame:
    """Segmented customers with their last contact (null if never). ``name`` is a pattern, case-blind in all alphabets."""
    chosen = in_segment(segments, segment)
    if name:
        chosen = chosen.where(F.coalesce(F.col("name").rlike(f"(?iU){name}"), F.lit(False)))
    if phone_only:
        chosen = chosen.where(F.length("phone_number") >= SHORTEST_PHONE)
    contacted = last_contact.select(F.col("customer_id").cast("string").alias("id"), "last_contact")
    return join_unique(chosen, contacted, ["id"], "left")


def campaign_queue(audience: DataFrame) -> DataFrame:
    """The audience as shown to the person who sends the messages."""
    contacted = zone_text(audience, "last_contact", labels.MINUTE_TEXT)
    return audience.selectExpr(
        "id",
        "name",
        "phone_number",
        "sales_channel",
        "segmento",
        "frequency",
        f"date_format(first_purchase, '{labels.DATE_TEXT}') AS first_purchase",
        f"date_format(last_purchase, '{labels.DATE_TEXT}') AS last_purchase",
        f"coalesce({contacted}, '{labels.NEVER}') AS ultimo_contato",
    )


def headed_queue(queue: DataFrame) -> DataFrame:
    return headed(queue.drop("id"), labels.QUEUE_HEADERS)


def campaign_messages(audience: DataFrame, purpose: str, shop_name: str) -> DataFrame:
    """Message, cleaned phone and click-to-chat link for every customer of the audience."""
    values = {
        "name": first_word(F.col("name")),
        "segment": F.col("segmento"),
        "recency": F.col("recency"),
        "shop": F.lit(shop_name),
    }
    messages = audience.select(
        "id",
        "name",
        "segmento",
        clean_phone(F.col("phone_number")).alias("phone_clean"),
        F.lit(purpose).alias("message_type"),
        fill(labels.MESSAGES[purpose], values).alias("message_body"),
    )
    link = F.concat(F.lit(labels.CHAT_LINK), "phone_clean", F.lit("?text="), percent_encode(F.col("message_body")))
    return messages.withColumn("wa_link", link)


def message_log(messages: DataFrame) -> DataFrame:
    """Sent messages under the column names of the contact log, ready to append."""
    return messages.select(
        F.col("id").alias("customer_id"),
        F.col("name").alias("customer_name"),
        F.col("phone_clean").alias("phone"),
        F.col("segmento").alias("segment"),
        "message_type",
        "message_body",
    )
