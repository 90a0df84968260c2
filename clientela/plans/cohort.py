"""Monthly retention of customers grouped by the month of their first purchase."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.functions.times import month_number, reference_date
from clientela.labels import MONTH_TEXT
from clientela.operators.identity import identity_links
from clientela.operators.sales import SALE_KEY, sale_dates, selected_channels, summed_sales, up_to

LOOK_BACK_MONTHS = 12


def cohort_counts(shop, as_of: dt.date | None = None, channel: str | None = None) -> DataFrame:
    """Customers per cohort month and month index (1 = first month), for first purchases in the look-back.

    Sales shrink to one row per key and month before they meet the identities; a customer is then one
    row with its first day and its months, a list the calendar bounds.
    """
    channels = selected_channels(channel)
    dates = sale_dates(up_to(summed_sales(shop, channels), as_of))
    monthly = (
        dates.selectExpr(*SALE_KEY, "day", f"{month_number('day')} AS month")
        .groupBy(*SALE_KEY, "month")
        .agg(F.min("day").alias("first_day"))
    )
    links = identity_links(shop.identity, channels=channels).distinct()
    customers = (
        links.join(monthly, SALE_KEY)
        .groupBy("id")
        .agg(F.min("first_day").alias("first_day"), F.collect_set("month").alias("months"))
        .where(f"first_day >= add_months({reference_date(as_of)}, -{LOOK_BACK_MONTHS})")
    )
    return (
        customers.selectExpr("first_day", "explode(months) AS month")
        .selectExpr(
            "CAST(trunc(first_day, 'MM') AS DATE) AS cohort_month",
            f"CAST(month - {month_number('first_day')} + 1 AS BIGINT) AS cohort_index",
        )
        .groupBy("cohort_month", "cohort_index")
        .agg(F.expr("count(1) AS customers"))
    )


def cohort_matrix(counts: DataFrame, width: int = LOOK_BACK_MONTHS + 1) -> DataFrame:
    """Columns ``m1 .. m<width>``; a month without customers is null. A cell beyond them is an error."""
    indexes = list(range(1, width + 1))
    beyond = f"raise_error(concat('month index beyond m{width}: ', cohort_index))"
    counts = counts.withColumn("cohort_index", F.expr(f"IF(cohort_index > {width}, CAST({beyond} AS BIGINT), cohort_index)"))
    wide = counts.groupBy("cohort_month").pivot("cohort_index", indexes).agg(F.first("customers"))
    return wide.toDF("cohort_month", *[f"m{i}" for i in indexes]).orderBy("cohort_month")


def _months(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "cohort_month"]


def cohort_retention(matrix: DataFrame) -> DataFrame:
    """Each month as a share of the cohort's first month."""
    shares = [f"{m} / m1 AS {m}" for m in _months(matrix)]
    return matrix.selectExpr(f"date_format(cohort_month, '{MONTH_TEXT}') AS cohort_month", *shares)


def _tenths(percent: str) -> str:
    """A percentage from 0 to 200 in tenths: the exact value of the double, halves to the even tenth.

    As a multiple of 2^-52, or below 1 of 2^-58, it is a whole number wherever a half is near, and ten times
    that fits a long.
    """

    def at(bits: int) -> str:
        whole = f"(CAST({percent} * {2**bits}D AS BIGINT) * 10L)"
        half, one = f"{2**(bits - 1)}L", f"{2**bits}L"
        rest, down = f"({whole} % {one})", f"({whole} div {one})"
        return f"({down} + IF({rest} > {half} OR ({rest} = {half} AND {down} % 2 = 1), 1L, 0L))"

    return f"IF({percent} < 1, {at(58)}, {at(52)})"


def percent_text(retention: DataFrame) -> DataFrame:
    """Retention as text with one decimal; blank where there is none."""
    shown = []
    for m in _months(retention):
        tenths = _tenths(f"({m} * 100D)")
        shown.append(f"IF({m} IS NULL, '', concat({tenths} div 10, '.', {tenths} % 10, '%')) AS {m}")
    return retention.selectExpr("cohort_month", *shown)
