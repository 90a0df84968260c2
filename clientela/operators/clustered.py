"""Sales stored by customer key: one folder per bucket of keys, sorted by key, with Bloom filters.

The facts arrive by time, so every file of theirs holds every key, and the sales of one customer are a
scan of all. Here they lie in the few folders of the customer's keys.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientela.operators.sales import SALE_KEY, channel_sales
from clientela.session import delete_folder, list_folders

#: Folders by default; choose so many that one is a few files.
BUCKETS = 256
#: The folder that holds the buckets is named by their number, which readers need to find a key's bucket.
_COUNT = "of"


def _bucket(channel: Column, key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(channel, key), F.lit(buckets)).cast("int")


def _write(sales: DataFrame, path: str, buckets: int, mode: str) -> None:
    """Rebalancing deals rows by bucket and lets adaptive execution split one that holds a hot key."""
    rows = sales.select("*", _bucket(F.col("channel"), F.col("native_key"), buckets).alias("bucket"))
    ordered = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *SALE_KEY, "created_at")
    bloom = ordered.write.option("parquet.bloom.filter.enabled#native_key", "true")
    bloom.partitionBy("bucket").mode(mode).parquet(f"{path.rstrip('/')}/{_COUNT}={buckets}")


def store_clustered(shop, path: str, buckets: int = BUCKETS) -> None:
    """Write all sales of the shop's facts by key; what stands at ``path`` is replaced."""
    delete_folder(shop.app_orders.sparkSession, path)
    _write(channel_sales(replace(shop, sales_by_key=None)), path, buckets, "overwrite")


def add_clustered(shop, path: str) -> None:
    """Add the sales of a shop that holds new facts only. A run that breaks off adds none of them."""
    _write(channel_sales(replace(shop, sales_by_key=None)), path, _buckets(shop.app_orders.sparkSession, path), "append")


def _buckets(spark: SparkSession, path: str) -> int:
    found = [name for name in (folder.rsplit("/", 1)[-1] for folder in list_folders(spark, path)) if name.startswith(f"{_COUNT}=")]
    if len(found) != 1:
        raise FileNotFoundError(f"no sales by key at {path}")
    return int(found[0].split("=")[1])


def sales_reader(spark: SparkSession, path: str, time_type: str) -> Callable[..., DataFrame]:
    """A reader of the stored sales for chosen channels and keys; ``time_type`` is that of the facts' times."""
    buckets = _buckets(spark, path)
    columns = f"channel string, native_key string, created_at {time_type}, total double, bucket int"
    table = spark.read.schema(columns).parquet(f"{path.rstrip('/')}/{_COUNT}={buckets}")
    return partial(clustered_sales, table, buckets)


def clustered_sales(
    table: DataFrame, buckets: int, channels: Sequence[str], keys: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """What :func:`channel_sales` gives, from the stored table. ``keys`` choose folders, then row groups within."""
    chosen = table.where(F.col("channel").isin(list(channels)))
    if keys is not None:
        sought = [(channel, key) for channel in channels for key in keys.get(channel, ())]
        if not sought:
            return table.where(F.lit(False)).select(*SALE_KEY, "created_at", "total")
        folders = [_bucket(F.lit(channel), F.lit(key), buckets) for channel, key in sought]
        pairs = [(F.col("channel") == channel) & (F.col("native_key") == key) for channel, key in sought]
        # The list of plain keys is what Parquet's Bloom filters and row group bounds are asked.
        listed = F.col("native_key").isin(sorted({key for _, key in sought}))
        chosen = chosen.where(F.col("bucket").isin(folders)).where(listed).where(reduce(or_, pairs))
    return chosen.select(*SALE_KEY, "created_at", "total")
