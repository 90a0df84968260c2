"""Purchase-frequency listing: filters, paging, counting and export."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from clientela.functions.money import UNITS_PER_ONE, from_units, mean_rounded_to_cents, ratio_rounded, to_units
from clientela.functions.text import headed
from clientela.labels import DATE_TEXT, FREQUENCY_HEADERS
from clientela.operators.identity import FULL_NAME
from clientela.operators.joins import join_unique
from clientela.operators.ordered import rows_after, rows_between
from clientela.operators.sales import SALE_KEY, channel_flags, channels_text, daily_totals, of_keys, selling_keys, summed_sales

LISTING_ORDER = ("id", "name", "document_number", "phone_number")


def customer_summary(shop, chosen: DataFrame | None = None) -> DataFrame:
    """Per ``id``: sales, totals, first and last day, gap statistics and channel text; of ``chosen`` ids or all.

    Only the sums per key and day are ordered by customer, so the calendar bounds the window of one
    customer, however many sales it has. The gaps between consecutive purchases add up to
    last day - first day; the largest one lies between two of the days.
    """
    links, sales = _of_ids(shop.links(), summed_sales(shop), chosen)
    by_day = Window.partitionBy("id").orderBy("day")
    per_id = (
        links.join(daily_totals(sales), SALE_KEY)
        .withColumn("previous", F.lag("day").over(by_day))
        .groupBy("id")
        .agg(
            F.expr("sum(sales * copies) AS sales"),
            F.expr("sum(IF(day IS NULL, 0, sales * copies)) AS dated"),
            F.expr("sum(units * copies) AS units"),
            F.expr("min(day) AS first_day"),
            F.expr("max(day) AS last_day"),
            F.expr("max(day - previous) AS largest_step"),
            *channel_flags(),
        )
    )
    return per_id.selectExpr(
        "id",
        "sales",
        "units",
        channels_text(),
        "first_day",
        "last_day",
        f"IF(dated > 1, {ratio_rounded('last_day - first_day', 'dated - 1')}, NULL) AS mean_gap",
        "IF(dated > 1, CAST(coalesce(largest_step, 0) AS BIGINT), NULL) AS max_gap",
    )


def _of_ids(links: DataFrame, sales: DataFrame, chosen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Links of the chosen ids, and only the sales of their keys."""
    if chosen is None:
        return links, sales
    links = join_unique(links, chosen, ["id"], "left_semi")
    return links, of_keys(sales, links)


def _chosen_ids(shop, name: str | None, phone_number: str | None, document_number: str | None) -> DataFrame | None:
    if not (name or phone_number or document_number):
        return None
    return shop.identity.where(identity_filters(name, phone_number, document_number)).select("id").distinct()


def normalized_channels(sales_channel: str) -> str:
    """Channel text of a filter in the order listings use, whatever order it was given in."""
    return "/".join(sorted(sales_channel.split("/")))


def identity_filters(name: str | None, phone_number: str | None, document_number: str | None) -> Column:
    chosen = F.lit(True)
    if name:
        chosen = chosen & F.expr(FULL_NAME).like(f"%{name}%")
    if phone_number:
        chosen = chosen & (F.col("phone_number") == phone_number)
    if document_number:
        chosen = chosen & (F.col("document_number") == document_number)
    return chosen


def customer_frequency(
    shop,
    sales_channel: str | None = None,
    name: str | None = None,
    phone_number: str | None = None,
    document_number: str | None = None,
) -> DataFrame:
    """One row per identity row with at least one purchase. Empty filters select everything."""
    summary = customer_summary(shop, _chosen_ids(shop, name, phone_number, document_number))
    if sales_channel:
        summary = summary.where(F.col("sales_channel") == normalized_channels(sales_channel))
    customers = shop.identity.where(identity_filters(name, phone_number, document_number)).selectExpr(
        "id", f"{FULL_NAME} AS name", "document_number", "phone_number"
    )
    return join_unique(customers, summary, ["id"]).selectExpr(
        "name",
        f"date_format(date_from_unix_date(first_day), '{DATE_TEXT}') AS primeira_compra",
        f"date_format(date_from_unix_date(last_day), '{DATE_TEXT}') AS ultima_compra",
        "sales AS num_compras",
        f"{from_units('units')} AS total_gasto",
        f"{mean_rounded_to_cents('units', 'sales')} AS ticket_medio",
        "IF(sales > 1, mean_gap, 0D) AS media_frequencia_compra",
        "IF(sales > 1, max_gap, 0L) AS max_dias_sem_recompra",
        "sales_channel",
        "document_number",
        "phone_number",
        "id",
    )


def listing_order() -> list[Column]:
    return [F.desc_nulls_last("total_gasto"), *[F.asc_nulls_first(c) for c in LISTING_ORDER]]


def page(listing: DataFrame, page_number: int = 1, rows_per_page: int = 20) -> DataFrame:
    """One page of the listing, highest total first; equal rows are rows of their own.

    The listing is counted by bins of its totals, and only the rows of the bins that the page lies in are put in order.
    """
    skipped = (page_number - 1) * rows_per_page
    return rows_between(listing, to_units("total_gasto"), LISTING_ORDER, skipped, skipped + rows_per_page)


@dataclass(frozen=True)
class Continuation:
    """Where a page ended: the key of its last row, and how many rows equal to it have been shown."""

    key: tuple
    shown: int


def continuation(rows: Sequence[Row], before: Continuation | None = None) -> Continuation | None:
    """The end of a page that was read as ``rows``, after the one that ended at ``before``."""
    if not rows:
        return before
    keys = [(None if r["total_gasto"] is None else round(r["total_gasto"] * UNITS_PER_ONE), *[r[c] for c in LISTING_ORDER]) for r in rows]
    equal = keys.count(keys[-1])
    return Continuation(keys[-1], equal + (before.shown if before and before.key == keys[-1] else 0))


def next_page(listing: DataFrame, after: Continuation | None = None, rows_per_page: int = 20) -> DataFrame:
    """The page after another one, without counting: one evaluation of the listing."""
    key, shown = (after.key, after.shown) if after else (None, 0)
    return rows_after(listing, to_units("total_gasto"), LISTING_ORDER, key, shown, rows_per_page)


def customer_frequency_export(listing: DataFrame) -> DataFrame:
    """The whole listing in order, without ids, under its display headers."""
    return headed(listing.orderBy(*listing_order()).drop("id"), FREQUENCY_HEADERS)


def customer_count(
    shop,
    sales_channel: str | None = None,
    name: str | None = None,
    phone_number: str | None = None,
    document_number: str | None = None,
) -> DataFrame:
    """Distinct customers behind the listing with the same filters. Reads keys only, no dates or totals."""
    chosen = _chosen_ids(shop, name, phone_number, document_number)
    links, sales = _of_ids(shop.links().select("id", *SALE_KEY).distinct(), summed_sales(shop), chosen)
    selling = (
        join_unique(links, selling_keys(sales), SALE_KEY)
        .groupBy("id")
        .agg(*channel_flags())
        .selectExpr("id", channels_text())
    )
    if sales_channel:
        selling = selling.where(F.col("sales_channel") == normalized_channels(sales_channel))
    return selling.agg(F.count(F.lit(1)).alias("n"))


def customer_page_count(count: DataFrame, rows_per_page: int = 25) -> DataFrame:
    return count.selectExpr("n AS total", f"(n + {rows_per_page - 1}) div {rows_per_page} AS total_pages")
