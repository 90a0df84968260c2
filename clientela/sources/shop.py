"""The input tables of one business, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from clientela import schemas
from clientela.operators.clustered import sales_reader
from clientela.operators.identity import CARRIED, LINK_KEY, identity_links, resolve_identity, weighted_links
from clientela.operators.rollup import read_rollup
from clientela.session import materialize


@dataclass(frozen=True)
class Shop:
    ifood_customer: DataFrame
    store_customer: DataFrame
    food99_customer: DataFrame
    app_orders: DataFrame
    store_sales: DataFrame
    contact_log: DataFrame | None = None
    process_last_run: DataFrame | None = None
    identity_table: DataFrame | None = None
    link_table: DataFrame | None = None
    rollup_table: DataFrame | None = None
    sales_by_key: Callable[..., DataFrame] | None = None

    @cached_property
    def identity(self) -> DataFrame:
        """The stored identity table if there is one, else its lazy plan."""
        if self.identity_table is not None:
            return self.identity_table
        return resolve_identity(self.ifood_customer, self.store_customer, self.food99_customer)

    def links(self, *carried: str) -> DataFrame:
        """``(channel, native_key, id, copies)`` and the ``carried`` of ``name`` and ``phone_number``.

        One row for each way an identity owns a key, with the number of times it does. Stored links keep
        name and phone number, so without them a row can come in parts, whose copies add up.
        """
        if self.link_table is not None:
            return self.link_table.select("id", *carried, *LINK_KEY, "copies")
        return weighted_links(identity_links(self.identity, [CARRIED[name] for name in carried]))

    def with_stored_identity(self) -> Shop:
        """Resolve identities and their links once and read them back from storage in every later analysis."""
        stored = replace(self, identity_table=materialize(self.identity, "identity"))
        return replace(stored, link_table=materialize(stored.links(*CARRIED), "links"))

    def with_rollup(self, path: str) -> Shop:
        """Listing, counts, RFM and cohorts start from the rollup stored at ``path`` (``operators.rollup``), not from the facts."""
        return replace(self, rollup_table=read_rollup(self.app_orders.sparkSession, path))

    def with_clustered(self, path: str) -> Shop:
        """Sales are read from the copy stored by key at ``path`` (``operators.clustered``), not from the facts."""
        spark = self.app_orders.sparkSession
        return replace(self, sales_by_key=sales_reader(spark, path, self.app_orders.schema["created_at"].dataType.simpleString()))


def parquet_shop(spark: SparkSession, folder: str) -> Shop:
    """A shop whose tables are Parquet folders ``folder/<table>`` with the schemas of this package."""
    return Shop(
        **{
            name: spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}")
            for name, schema in schemas.TABLES.items()
        }
    )


def catalog_shop(spark: SparkSession, database: str) -> Shop:
    """A shop whose tables are registered in the catalog."""
    return Shop(**{name: spark.table(f"{database}.{name}") for name in schemas.TABLES})
