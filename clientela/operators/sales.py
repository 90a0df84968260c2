"""Sales of all channels, and the rollups the analyses per customer are built on.

A sale is addressed by ``(channel, native_key)``. No analysis moves single sales more than once:
they are first summed per key (or per key and day, or month), with map-side combine, so that a key
that holds a third of all sales shrinks to a row per task. Only the sums are joined to identities.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.functions.money import to_units
from clientela.functions.times import before_day_after, day_date, day_number, month_number, reference_date
from clientela.labels import CHANNELS, FOOD99, IFOOD, STORE
from clientela.operators.identity import stacked
from clientela.operators.joins import join_unique

SALE_KEY = ["channel", "native_key"]

#: Columns of a stored rollup, which stands for the sales it sums; its folders are the months.
ROLLUP = "channel string, native_key string, sales bigint, units bigint, least double, blank boolean, day int, month int"


def selected_channels(channel: str | None) -> tuple[str, ...]:
    """One known channel selects itself; anything else selects all."""
    return (channel,) if channel in CHANNELS else CHANNELS


def channel_sales(
    shop, channels: Sequence[str] = CHANNELS, keys: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """``(channel, native_key, created_at, total)`` of the chosen channels; each fact table is read once.

    ``keys`` keeps only the listed native keys per channel, by filters on the fact tables themselves,
    which reach the file scans. A shop with sales stored by key reads these instead.
    """
    if shop.sales_by_key is not None:
        return shop.sales_by_key(channels, keys)
    app = {label: key for label, key in ((IFOOD, "customer_id"), (FOOD99, "c_uid")) if label in channels}

    def chosen(label: str, key: str) -> Column:
        return F.col(key).isNotNull() if keys is None else F.col(key).isin(list(keys.get(label, ())))

    branches = []
    if app:
        known = reduce(or_, [chosen(label, key) for label, key in app.items()])
        orders = shop.app_orders.where(known).selectExpr(
            stacked(app), "created_at", "CAST(total_bag_detail AS DOUBLE) AS total"
        )
        branches.append(orders.where("native_key IS NOT NULL"))
    if STORE in channels:
        branches.append(
            shop.store_sales.where(chosen(STORE, "client_cpf")).selectExpr(
                f"'{STORE}' AS channel", "client_cpf AS native_key", "created_at", "CAST(total AS DOUBLE) AS total"
            )
        )
    kinds = {branch.schema["created_at"].dataType for branch in branches}
    if len(kinds) > 1:
        raise TypeError("the times of all sales must have one type: instants, or zoneless UTC times")
    return reduce(DataFrame.unionByName, branches)


def summed_sales(shop, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """What analyses by day sum up: rows of the shop's stored rollup, or where it has none, :func:`channel_sales`."""
    if shop.rollup_table is None:
        return channel_sales(shop, channels)
    return shop.rollup_table.where(F.col("channel").isin(list(channels)))


def _rolled_up(sales: DataFrame) -> bool:
    return "created_at" not in sales.columns


def up_to(sales: DataFrame, as_of: dt.date | None) -> DataFrame:
    """Drop sales after ``as_of`` (today if None), so that a reference date sees no later sale."""
    if _rolled_up(sales):
        last = reference_date(as_of)
        return sales.where(f"month IS NULL OR (month <= {month_number(last)} AND day <= unix_date({last}))")
    return sales.where(f"created_at IS NULL OR {before_day_after(sales, 'created_at', as_of)}")


def _measured(sales: DataFrame) -> DataFrame:
    return sales.selectExpr(*SALE_KEY, f"{day_number(sales, 'created_at')} AS day", f"{to_units('total')} AS units")


def key_totals(sales: DataFrame) -> DataFrame:
    """One row per ``(channel, native_key)``: ``sales``, ``dated`` sales, ``units``, first and last day."""
    return _measured(sales).groupBy(*SALE_KEY).agg(
        F.expr("count(1) AS sales"),
        F.expr("count(day) AS dated"),
        F.expr("sum(units) AS units"),
        F.expr("min(day) AS first_day"),
        F.expr("max(day) AS last_day"),
    )


def daily_totals(sales: DataFrame) -> DataFrame:
    """One row per ``(channel, native_key, day)``: ``sales`` and ``units``."""
    if _rolled_up(sales):
        return sales.select(*SALE_KEY, "day", "sales", "units")
    return _measured(sales).groupBy(*SALE_KEY, "day").agg(F.expr("count(1) AS sales"), F.expr("sum(units) AS units"))


def daily_leads(sales: DataFrame) -> DataFrame:
    """:func:`daily_totals` with the least total of the day, and whether it has a sale without a total."""
    if _rolled_up(sales):
        return sales.select(*SALE_KEY, "day", "sales", "units", "least", "blank")
    measured = sales.selectExpr(*SALE_KEY, f"{day_number(sales, 'created_at')} AS day", f"{to_units('total')} AS units", "total")
    return measured.groupBy(*SALE_KEY, "day").agg(
        F.expr("count(1) AS sales"),
        F.expr("sum(units) AS units"),
        F.expr("min(total) AS least"),
        F.expr("bool_or(total IS NULL) AS blank"),
    )


def sale_dates(sales: DataFrame) -> DataFrame:
    """``(channel, native_key, day)`` of all sales with a time, the day as a date; rows repeat."""
    if _rolled_up(sales):
        return sales.where("day IS NOT NULL").selectExpr(*SALE_KEY, "date_from_unix_date(day) AS day")
    return sales.where("created_at IS NOT NULL").selectExpr(*SALE_KEY, f"{day_date(sales, 'created_at')} AS day")


def of_keys(sales: DataFrame, keys: DataFrame) -> DataFrame:
    """Sales of some keys only, before they are summed or moved."""
    return join_unique(sales, keys.select(*SALE_KEY).distinct(), SALE_KEY, "left_semi")


def selling_keys(sales: DataFrame) -> DataFrame:
    """Distinct ``(channel, native_key)`` that sold anything."""
    return sales.select(*SALE_KEY).distinct()


def _flag(channel: str) -> str:
    return f"sells_{CHANNELS.index(channel)}"


def channel_flags() -> list[Column]:
    """Aggregates that note which channels occur: three booleans, so the aggregate stays fixed-width."""
    return [F.expr(f"bool_or(channel = '{channel}') AS {_flag(channel)}") for channel in CHANNELS]


def channels_text() -> str:
    """The channels noted by :func:`channel_flags` in text order, separated by ``/``."""
    parts = ", ".join(f"IF({_flag(channel)}, '{channel}', NULL)" for channel in sorted(CHANNELS))
    return f"concat_ws('/', {parts}) AS sales_channel"
