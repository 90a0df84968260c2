"""When each data-loading process last ran."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.functions.times import zone_text

SECOND_TEXT = "dd/MM/yyyy HH:mm:ss"


def process_last_run(runs: DataFrame, process_keys: Sequence[str]) -> DataFrame:
    """Runs of the given processes; no keys select no rows. On a JDBC scan the filter runs in the database."""
    wanted = F.col("process_key").isin(list(process_keys)) if process_keys else F.lit(False)
    return runs.where(wanted).select("last_run_date", "process_key", "name")


def run_text(runs: DataFrame) -> DataFrame:
    return runs.selectExpr("name", f"{zone_text(runs, 'last_run_date', SECOND_TEXT)} AS last_run")
