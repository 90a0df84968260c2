"""Recency, frequency and monetary value per customer, and the segments made from their quartiles."""

from __future__ import annotations

import datetime as dt
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from clientela import labels
from clientela.functions.money import UNITS_PER_ONE, from_units, to_units
from clientela.functions.text import headed
from clientela.functions.times import reference_date
from clientela.labels import CHANNELS
from clientela.operators.ordered import At, Bracket, bracket, keys_at, sketch, values_at
from clientela.operators.sales import (
    SALE_KEY,
    channel_flags,
    channels_text,
    daily_leads,
    selected_channels,
    summed_sales,
    up_to,
)
from clientela.session import materialize

CUSTOMER_KEY = ["id", "name"]


def _customer_days(links: DataFrame, sales: DataFrame) -> DataFrame:
    """One row per ``(id, name, day)``: sums, channels, and channel and total of its first sale.

    The first sale is the one with the first channel in text order, then the least total (none comes
    first). Its aggregates are fixed-width, so that a hash aggregate can hold them.
    """
    noted, channel, total = [], "NULL", "NULL"
    for i, name in reversed(list(enumerate(sorted(CHANNELS)))):
        here = f"channel = '{name}'"
        noted += [F.expr(f"bool_or({here}) AS has_{i}"), F.expr(f"bool_or({here} AND blank) AS blank_{i}"), F.expr(f"min(IF({here}, least, NULL)) AS least_{i}")]
        channel = f"IF(has_{i}, {i}, {channel})"
        total = f"IF(has_{i}, IF(blank_{i}, NULL, least_{i}), {total})"
    days = links.join(daily_leads(sales), SALE_KEY).groupBy(*CUSTOMER_KEY, "day").agg(
        F.expr("max(phone_number) AS phone_number"),
        F.expr("sum(units * copies) AS units"),
        F.expr("sum(sales * copies) AS sales"),
        *channel_flags(),
        *noted,
    )
    return days.withColumns({"lead_channel": F.expr(channel), "lead_total": F.expr(total)})


def rfm_base(shop, as_of: dt.date | None = None, channel: str | None = None) -> DataFrame:
    """One row per ``(id, name)`` with a purchase.

    All names of an id share one purchase history. Sales of a day go by channel, total and name, and the
    first one carries the days since the purchase before; the others of the day carry none. So only the
    sums per day are put in order, and the calendar bounds the days of an id.
    """
    channels = selected_channels(channel)
    links = shop.links("name", "phone_number").where(F.col("channel").isin(list(channels)))
    days = _customer_days(links, up_to(summed_sales(shop, channels), as_of))
    order = [F.asc_nulls_first("day"), "lead_channel", F.asc_nulls_first("lead_total"), "name"]
    stepped = days.withColumn("previous", F.lag("day").over(Window.partitionBy("id").orderBy(*order)))
    customers = stepped.groupBy(*CUSTOMER_KEY).agg(
        F.expr("max(phone_number) AS phone_number"),
        F.expr("sum(units) AS units"),
        F.expr("sum(sales) AS frequency"),
        F.expr("sum(IF(day IS NULL, 0, sales)) AS dated"),
        F.expr("min(day) AS first_day"),
        F.expr("max(day) AS last_day"),
        F.expr("sum(day - previous) AS steps"),
        F.expr("count_if(day IS NOT NULL AND previous IS NULL) AS starts"),
        *[F.expr(f"bool_or(sells_{i}) AS sells_{i}") for i in range(len(CHANNELS))],
    )
    last = "date_from_unix_date(last_day)"
    return customers.selectExpr(
        "id",
        "name",
        "phone_number",
        f"{from_units('units')} AS monetary",
        "frequency",
        "date_from_unix_date(first_day) AS first_purchase",
        f"{last} AS last_purchase",
        f"CAST(datediff({reference_date(as_of)}, {last}) AS BIGINT) AS recency",
        "IF(dated > starts, CAST(coalesce(steps, 0) AS DOUBLE) / (dated - starts), NULL) AS avg_cycle",
        channels_text(),
    )


class QuartileError(ValueError):
    """The customers cannot be cut into four groups: a value is missing or two edges coincide."""


def _edge_positions(rows: int) -> list[tuple[int, int, Fraction]]:
    """Positions around each of the five edges of four equal parts, and the share between them."""
    positions = []
    for quarter in range(5):
        exact = Fraction((rows - 1) * quarter, 4)
        low = exact.numerator // exact.denominator
        positions.append((low, low + (exact > low), exact - low))
    return positions


def _edges(values: dict[int, int], rows: int) -> list[Fraction]:
    """Linearly interpolated edges, computed without rounding."""
    return [values[low] + (values[high] - values[low]) * share for low, high, share in _edge_positions(rows)]


def _require_distinct(edges: list, column: str) -> None:
    if len(set(edges)) < len(edges):
        raise QuartileError(f"quartile edges of {column} coincide: {[float(e) for e in edges]}")


#: The columns whose quartiles are cut, as whole numbers; the inner quartiles.
MEASURES = {"recency": "recency", "frequency": "frequency", "units": to_units("monetary")}
QUARTILES = (0.25, 0.5, 0.75)


def _facts(table: DataFrame) -> Row:
    """One pass: rows, missing values, and for each measure its limits and the values around its quartiles."""
    measures = [
        f"{what} AS {name}_{part}"
        for name, measure in MEASURES.items()
        for part, what in (("least", f"min({measure})"), ("most", f"max({measure})"), ("sketch", sketch(measure, QUARTILES)))
    ]
    counts = "count(1) AS rows", "count_if(recency IS NULL OR monetary IS NULL) AS incomplete"
    return table.agg(*[F.expr(e) for e in (*counts, *measures)]).first()


def _around_edges(table: DataFrame, facts: Row) -> dict[str, dict[int, At]]:
    """What stands at the positions next to the quartile edges of each measure."""
    positions = _edge_positions(facts["rows"])
    wanted, limits = {}, {}
    for name, measure in MEASURES.items():
        limits[measure] = low, high = facts[f"{name}_least"], facts[f"{name}_most"]
        inner = {p: bracket(facts[f"{name}_sketch"], k, facts["rows"], low, high) for k, pair in enumerate(positions[1:4]) for p in pair[:2]}
        wanted[measure] = {0: (low, low, 0), facts["rows"] - 1: (high, high, 0)} | inner
    found = values_at(table, wanted, limits)
    return {name: found[measure] for name, measure in MEASURES.items()}


def _with_scores(table: DataFrame, facts: Row) -> DataFrame:
    rows, around = facts["rows"], _around_edges(table, facts)
    for name, shown in (("recency", "recency"), ("units", "monetary")):
        _require_distinct(_edges({p: at.value for p, at in around[name].items()}, rows), shown)
    # No value lies strictly between the two neighbours of an edge, so "above the edge" is the same
    # as "above its lower neighbour".
    cuts = [low for low, _, _ in _edge_positions(rows)[1:4]]

    # The frequency score cuts ranks, not values; ties rank by id, then name. Only the customers whose
    # frequency lies at a cut are put in order.
    tied = {cut: Bracket(F.col("frequency") == at.value, at.below, at.count) for cut in cuts for at in [around["frequency"][cut]]}
    ranked = ["frequency", *CUSTOMER_KEY]
    f_score = F.lit(1)
    for key, _ in keys_at(table.select(*ranked), ranked, tied).values():
        limit = F.struct(*[F.lit(v).cast(table.schema[c].dataType) for c, v in zip(ranked, key)])
        f_score = f_score + (F.struct(*ranked) > limit).cast("int")
    recent = " + ".join(f"int(recency > {around['recency'][cut].value}L)" for cut in cuts)
    spent = " + ".join(f"int(monetary > {around['units'][cut].value / UNITS_PER_ONE!r}D)" for cut in cuts)
    scored = table.select("*", F.expr(f"4 - ({recent}) AS r_score"), f_score.alias("f_score"), F.expr(f"1 + {spent} AS m_score"))
    return scored.selectExpr("*", "r_score + f_score + m_score AS rfm_score")


def segment_label(score: str) -> Column:
    *floors, (_, lowest) = labels.SEGMENTS
    whens = " ".join(f"WHEN {score} >= {floor} THEN '{name}'" for floor, name in floors)
    return F.expr(f"CASE {whens} ELSE '{lowest}' END")


def rfm_segments(base: DataFrame, on_ties: str = "raise") -> DataFrame:
    """Add ``r_score, f_score, m_score, rfm_score, segmento``.

    The base is stored once; the quartile cuts come from a few small jobs over it and enter the result as
    literals. Below ten customers there are no scores. Coinciding edges raise ``QuartileError``;
    ``on_ties="empty"`` returns no rows instead.
    """
    if on_ties not in ("raise", "empty"):
        raise ValueError("on_ties is 'raise' or 'empty'")
    table = materialize(base, "rfm")
    facts = _facts(table)
    unscored = [f"CAST(NULL AS INT) AS {c}" for c in ("r_score", "f_score", "m_score", "rfm_score")]
    if facts["rows"] < labels.MIN_SCORED_CUSTOMERS:
        return table.selectExpr("*", *unscored, f"'{labels.BEGINNER}' AS segmento")
    try:
        if facts["incomplete"]:
            raise QuartileError(f"{facts['incomplete']} customers have no recency or no monetary value")
        scored = _with_scores(table, facts)
    except QuartileError:
        if on_ties == "raise":
            raise
        return table.limit(0).selectExpr("*", *unscored, "CAST(NULL AS STRING) AS segmento")
    return scored.withColumn("segmento", segment_label("rfm_score"))


def segment_counts(segments: DataFrame) -> DataFrame:
    """Customers per segment, most frequent first; the four segments always appear."""
    names = ", ".join(f"('{label}', 0L)" for label in labels.SEGMENT_LABELS)
    named = segments.sparkSession.sql(f"SELECT * FROM VALUES {names} AS names(segmento, n)")
    counted = segments.groupBy("segmento").agg(F.count(F.lit(1)).alias("n"))
    return (
        named.unionByName(counted)
        .groupBy("segmento")
        .agg(F.sum("n").alias("quantidade"))
        .orderBy(F.desc("quantidade"), "segmento")
    )


def segment_labels(segments: DataFrame) -> DataFrame:
    return segments.select("segmento").distinct().orderBy("segmento")


def in_segment(segments: DataFrame, segment: str = labels.ALL_SEGMENTS) -> DataFrame:
    return segments if segment == labels.ALL_SEGMENTS else segments.where(F.col("segmento") == segment)


def segment_listing(segments: DataFrame, segment: str = labels.ALL_SEGMENTS) -> DataFrame:
    listed = in_segment(segments, segment).orderBy(F.desc_nulls_last("monetary"), *CUSTOMER_KEY)
    return listed.select("name", "phone_number", "monetary", "frequency", "recency", "segmento", "sales_channel")


def headed_segment_listing(listing: DataFrame) -> DataFrame:
    return headed(listing, labels.LISTING_HEADERS)
