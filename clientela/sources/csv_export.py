"""CSV sink of a listing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType


def export_name(now: dt.datetime) -> str:
    return f"clientes_{now:%Y%m%d_%H%M%S}.csv"


def _field(df: DataFrame, name: str) -> Column:
    """A value as CSV text: numbers in plain digits, quotes doubled, text quoted where it must be."""
    value = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType, DecimalType)):
        # at least one decimal, no more than needed
        plain = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
        return F.coalesce(plain, F.lit(""))
    text = value.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\\r\\n]'), quoted).otherwise(text), F.lit(""))


def csv_lines(df: DataFrame) -> DataFrame:
    """A header line, then a line for each row in its order."""
    heads = [name.replace('"', '""') for name in df.columns]
    header = ",".join(f'"{head}"' if any(c in head for c in '",\r\n') else head for head in heads)
    first = df.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("line"))
    return first.union(df.select(F.concat_ws(",", *[_field(df, name) for name in df.columns]).alias("line")))


def write_csv(df: DataFrame, folder: str, now: dt.datetime | None = None) -> str:
    """Write ``df`` as UTF-8 part files, in row order; return the folder written.

    Nothing passes through the driver or a single task: the parts, joined in name order, are the file, with
    one header in front.
    """
    path = f"{folder.rstrip('/')}/{export_name(now or dt.datetime.now())}"
    csv_lines(df).write.text(path)
    return path
