"""The stored daily rollup: sales of all channels summed per key and day, one folder per month.

Frequency, RFM, cohorts and counts all start from sums per key and day. Stored once, they read these
and no fact again, and only the months of days that changed are written anew. Folders per day would
leave a few thousand of them, each with files too small to be worth opening.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientela.functions.times import before_day_after, day_date, from_day, month_number
from clientela.operators.sales import ROLLUP, SALE_KEY, channel_sales, daily_leads
from clientela.session import delete_folder, list_folders

#: Files of a month at most; keys are dealt to them by hash, so a busy month is written by as many tasks.
FILES_PER_MONTH = 8
_MONTH = month_number("date_from_unix_date(day)")


def _write(sales: DataFrame, path: str, files_per_month: int) -> None:
    """Replace the months that ``sales`` has sales in, and no others."""
    rows = daily_leads(sales).selectExpr("channel", "native_key", "sales", "units", "least", "blank", "day", f"{_MONTH} AS month")
    dealt = rows.repartition("month", F.pmod(F.xxhash64(*SALE_KEY), F.lit(files_per_month)))
    ordered = dealt.sortWithinPartitions("month", *SALE_KEY)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def store_rollup(shop, path: str, files_per_month: int = FILES_PER_MONTH) -> None:
    """Write the rollup of all sales; a rollup that stands there is replaced.

    Sales without a time make a part of their own, without day and month.
    """
    delete_folder(shop.app_orders.sparkSession, path)
    _write(channel_sales(shop), path, files_per_month)


def refresh_rollup(shop, path: str, days: Collection[dt.date], files_per_month: int = FILES_PER_MONTH) -> None:
    """Bring the months of some days up to date from the facts; the others stay. A month without a sale any more goes.

    The facts are filtered by time in their scans. Run again, also after a break, it gives the same table.
    """
    if not days:
        return
    sales = channel_sales(shop)
    months = sorted({day.year * 12 + day.month - 1 for day in days})
    last = (max(days).replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
    near = f"{from_day(sales, 'created_at', min(days).replace(day=1))} AND {before_day_after(sales, 'created_at', last)}"
    month = F.expr(month_number(day_date(sales, "created_at")))
    chosen = sales.where(near).where(month.isin(months))
    _write(chosen, path, files_per_month)
    spark = sales.sparkSession
    held = {row.month for row in chosen.select(month.alias("month")).distinct().collect()}
    gone = {f"month={number}" for number in months if number not in held}
    for folder in list_folders(spark, path):
        if folder.rsplit("/", 1)[-1] in gone:
            delete_folder(spark, folder)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The stored rollup; a condition on ``month`` chooses folders."""
    return spark.read.schema(ROLLUP).parquet(path)
