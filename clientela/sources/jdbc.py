"""Process-run table of a relational database, read over JDBC."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

PROCESS_RUN_QUERY_TABLE = "process_last_run"


def postgres_options(host: str, port: int, database: str, user: str, password: str) -> dict[str, str]:
    return {
        "url": f"jdbc:postgresql://{host}:{port}/{database}",
        "user": user,
        "password": password,
        "driver": "org.postgresql.Driver",
    }


def process_runs(spark: SparkSession, options: Mapping[str, str], table: str = PROCESS_RUN_QUERY_TABLE) -> DataFrame:
    """Lazy scan; column selection and ``IN`` filters on it run inside the database."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    return reader.option("pushDownPredicate", "true").load().select("last_run_date", "process_key", "name")
