from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clientela.session import build_session
from clientela.sources.shop import Shop

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def text_columns(names: str) -> str:
    return ", ".join(f"{name} string" for name in names.split())


REGISTRIES = {
    "ifood_customer": "id document_number first_name last_name",
    "store_customer": "document_number phone_number first_name last_name",
    "food99_customer": "c_uid phone_number first_name last_name",
}


def stamp(moment) -> dt.datetime | None:
    """``'2024-01-05'`` or ``'2024-01-05 10:30'`` as a zoneless time."""
    return None if moment is None else dt.datetime.fromisoformat(moment)


def local_frame(spark, rows, schema: str):
    """A small DataFrame held as a local relation, which needs no Python process to scan."""
    kinds = {
        "string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "date": pa.date32(),
        "timestamp_ntz": pa.timestamp("us"), "timestamp": pa.timestamp("us", "UTC"),
    }
    fields = [part.split() for part in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(list(column), kinds[kind]) for column, (_, kind) in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=[name for name, _ in fields]), schema)


@pytest.fixture
def make_shop(spark):
    """Build a shop from plain tuples; sales are ``(key, total, time text)`` per channel."""

    def build(ifood=(), store=(), food99=(), ifood_sales=(), food99_sales=(), store_sales=(), kind="timestamp_ntz", orders=()):
        rows = {"ifood_customer": ifood, "store_customer": store, "food99_customer": food99}
        frames = {
            name: local_frame(spark, list(rows[name]), text_columns(columns)) for name, columns in REGISTRIES.items()
        }
        app = [(key, None, float(total) if total is not None else None, stamp(t)) for key, total, t in ifood_sales]
        app += [(None, key, float(total) if total is not None else None, stamp(t)) for key, total, t in food99_sales]
        app += [(a, b, float(total), stamp(t)) for a, b, total, t in orders]
        shop_sales = [(key, float(total) if total is not None else None, stamp(t)) for key, total, t in store_sales]
        if kind == "timestamp":
            app = [(*r[:-1], r[-1] and r[-1].replace(tzinfo=UTC)) for r in app]
            shop_sales = [(*r[:-1], r[-1] and r[-1].replace(tzinfo=UTC)) for r in shop_sales]
        return Shop(
            **frames,
            app_orders=local_frame(spark, app, f"customer_id string, c_uid string, total_bag_detail double, created_at {kind}"),
            store_sales=local_frame(spark, shop_sales, f"client_cpf string, total double, created_at {kind}"),
        )

    return build


def tuples(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in chosen.collect()), key=repr)


@pytest.fixture
def settings(spark):
    """Set session settings for one test."""
    changed: dict[str, str | None] = {}

    def apply(**values: str) -> None:
        for key, value in values.items():
            name = "spark.sql." + key.replace("__", ".")
            changed.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield apply
    for name, value in changed.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Shuffle joins only, with every sizeable partition treated as skewed.
FORCED_SKEW = {
    "autoBroadcastJoinThreshold": "-1",
    "adaptive__skewJoin__skewedPartitionThresholdInBytes": "1b",
    "adaptive__skewJoin__skewedPartitionFactor": "1.0",
    "adaptive__advisoryPartitionSizeInBytes": "256b",
    "adaptive__coalescePartitions__minPartitionSize": "1b",
}
