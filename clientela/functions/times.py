"""UTC calendar handling that does not depend on the zone of the session.

Times come as zoneless timestamps that hold UTC, or as instants. Both give the same UTC days. The
functions return SQL expressions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, TimestampNTZType, TimestampType

_MICROS_PER_DAY = 86_400_000_000


def _kind(df: DataFrame, name: str) -> DataType:
    kind = df.schema[name].dataType
    if not isinstance(kind, (TimestampNTZType, TimestampType)):
        raise TypeError(f"{name} must be a timestamp, not {kind.simpleString()}")
    return kind


def day_number(df: DataFrame, name: str) -> str:
    """Days from 1970-01-01 to the UTC day of a time column."""
    if isinstance(_kind(df, name), TimestampNTZType):
        return f"unix_date(CAST({name} AS DATE))"
    micros = f"unix_micros({name})"
    return f"CAST(({micros} - pmod({micros}, {_MICROS_PER_DAY})) div {_MICROS_PER_DAY} AS INT)"


def day_date(df: DataFrame, name: str) -> str:
    return f"date_from_unix_date({day_number(df, name)})"


def before_day_after(df: DataFrame, name: str, day: dt.date | None) -> str:
    """True up to the end of the UTC day ``day`` (today if None). A plain comparison, so it reaches the file scan."""
    if day is None:
        if isinstance(_kind(df, name), TimestampNTZType):
            return f"{name} < CAST(date_from_unix_date({_TODAY} + 1) AS TIMESTAMP_NTZ)"
        return f"{name} < timestamp_micros(({_TODAY} + 1L) * {_MICROS_PER_DAY}L)"
    end = day + dt.timedelta(days=1)
    if isinstance(_kind(df, name), TimestampNTZType):
        return f"{name} < TIMESTAMP_NTZ '{end} 00:00:00'"
    return f"{name} < TIMESTAMP_LTZ '{end} 00:00:00Z'"


def from_day(df: DataFrame, name: str, day: dt.date) -> str:
    """True from the start of the UTC day ``day``; reaches the file scan as well."""
    if isinstance(_kind(df, name), TimestampNTZType):
        return f"{name} >= TIMESTAMP_NTZ '{day} 00:00:00'"
    return f"{name} >= TIMESTAMP_LTZ '{day} 00:00:00Z'"


def zone_text(df: DataFrame, name: str, pattern: str, zone: str = "UTC") -> str:
    """A time column as text on the clocks of ``zone``."""
    stored = "'UTC'" if isinstance(_kind(df, name), TimestampNTZType) else "current_timezone()"
    return f"date_format(convert_timezone({stored}, '{zone}', CAST({name} AS TIMESTAMP_NTZ)), '{pattern}')"


def month_number(date: str) -> str:
    return f"(year({date}) * 12 + month({date}) - 1)"


#: The UTC day now, in any session zone.
_TODAY = f"CAST(unix_micros(current_timestamp()) div {_MICROS_PER_DAY} AS INT)"


def reference_date(as_of: dt.date | None) -> str:
    return f"date_from_unix_date({_TODAY})" if as_of is None else f"DATE '{as_of}'"
