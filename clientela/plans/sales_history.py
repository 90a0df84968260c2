"""Sales by identity: all rows, days between purchases, and the drill-down of one customer."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientela.functions.text import headed
from clientela.functions.times import day_date, zone_text
from clientela.labels import CHANNELS, DISPLAY_ZONE, MINUTE_TEXT, TRANSACTION_HEADERS
from clientela.operators.identity import identity_links
from clientela.operators.sales import SALE_KEY, channel_sales

#: Equal sales expanded from one row; larger groups are split into blocks of this size.
COPIES_PER_BLOCK = 10_000


def transactions(shop) -> DataFrame:
    """``id, sales_date, total, channel``: each sale once per identity row that owns its key."""
    sales = channel_sales(shop)
    dated = sales.selectExpr(*SALE_KEY, f"{day_date(sales, 'created_at')} AS sales_date", "total")
    return dated.join(identity_links(shop.identity), SALE_KEY).select("id", "sales_date", "total", "channel")


def _leading_sale() -> tuple[list[Column], str, str]:
    """The first sale of a group by channel and total (nulls first).

    Returns fixed-width aggregates (so that a hash aggregate can hold them) and, over their results,
    the channel and the total of that sale.
    """
    noted, channel, total = [], "NULL", "NULL"
    for i, name in reversed(list(enumerate(sorted(CHANNELS)))):
        noted += [
            F.expr(f"bool_or(channel = '{name}') AS has_{i}"),
            F.expr(f"bool_or(channel = '{name}' AND total IS NULL) AS blank_{i}"),
            F.expr(f"min(IF(channel = '{name}', total, NULL)) AS least_{i}"),
        ]
        channel = f"IF(has_{i}, '{name}', {channel})"
        total = f"IF(has_{i}, IF(blank_{i}, NULL, least_{i}), {total})"
    return noted, f"{channel} AS lead_channel", f"{total} AS lead_total"


def purchase_gaps(shop) -> DataFrame:
    """Each sale with the days since the customer's previous one (order: date, channel, total).

    Only the first sale of a day can have a gap above 0. So equal sales are folded into one row with
    a count, the gaps are taken between the distinct days of a customer (the calendar bounds that
    list), and the folded rows are expanded again in blocks, each with its own join key.
    """
    # An id is never null; saying so keeps both uses of the folded rows equal, so that they share one exchange.
    sales = transactions(shop).withColumn("id", F.coalesce("id", F.lit("")))
    folded = sales.groupBy("id", "sales_date", "channel", "total").agg(F.expr("count(1) AS copies"))
    last_block = f"(copies - 1) div {COPIES_PER_BLOCK}"
    noted, lead_channel, lead_total = _leading_sale()
    by_day = Window.partitionBy("id").orderBy(F.asc_nulls_first("sales_date"))
    days = (
        folded.groupBy("id", "sales_date")
        .agg(*noted, F.expr(f"max({last_block}) AS blocks"))
        .withColumn("previous", F.lag("sales_date").over(by_day))
        .selectExpr(
            "id AS day_id", "sales_date AS day_date", lead_channel, lead_total,
            "CAST(datediff(sales_date, previous) AS BIGINT) AS days", "explode(sequence(0L, blocks)) AS day_block",
        )
    )
    blocks = folded.selectExpr("*", f"explode(sequence(0L, {last_block})) AS block")
    first, last = f"block * {COPIES_PER_BLOCK} + 1", f"least((block + 1) * {COPIES_PER_BLOCK}, copies)"
    leads = "copy = 1 AND channel = lead_channel AND total <=> lead_total"
    return (
        blocks.join(days, F.expr("id = day_id AND sales_date <=> day_date AND block = day_block"))
        .selectExpr("*", f"explode(sequence({first}, {last})) AS copy")
        .selectExpr(
            "id",
            "sales_date",
            "channel",
            "total",
            f"CASE WHEN {leads} THEN days WHEN sales_date IS NOT NULL THEN 0L END AS days_between",
        )
    )


def customer_transactions(shop, customer_id: str | None = None, zone: str = DISPLAY_ZONE) -> DataFrame:
    """Sales newest first, as local text; of one customer, or of all.

    For one customer the few native keys of the id (pieces of the id text, so their number is bounded
    by its length) are looked up first and pushed into the fact scans as ``IN`` filters.
    """
    links, keys = identity_links(shop.identity), None
    if customer_id is not None:
        links = links.where(F.col("id") == customer_id)
        keys = defaultdict(list)
        for row in links.select(*SALE_KEY).distinct().collect():
            keys[row["channel"]].append(row["native_key"])
    owned = channel_sales(shop, keys=keys).join(links, SALE_KEY)
    newest = [F.desc("created_at"), "id", "channel", "total"]
    text = zone_text(owned, "created_at", MINUTE_TEXT, zone)
    return owned.orderBy(*newest).selectExpr("id", "channel AS canal", f"{text} AS data_venda", "total")


def headed_transactions(sales: DataFrame) -> DataFrame:
    return headed(sales, TRANSACTION_HEADERS).drop(TRANSACTION_HEADERS["id"])
