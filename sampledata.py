"""A shop seen through the TPC-H-like test tables. The view texts run unchanged in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clientela.sources.shop import Shop


def _phone(key: str) -> str:
    """Four phone styles: punctuated, already prefixed, trailing ``.0``, too short."""
    eight = f"lpad(CAST({key} AS STRING), 8, '0')"
    return (
        f"CASE {key} % 4 WHEN 0 THEN '(11) 9' || {eight} WHEN 1 THEN '55119' || {eight} "
        f"WHEN 2 THEN '119' || {eight} || '.0' ELSE CAST({key} AS STRING) END"
    )


_SHARED = "(CASE WHEN c_custkey % 30 = 3 THEN c_custkey - 3 ELSE c_custkey END)"

VIEWS = {
    "ifood_customer": """
        SELECT CAST(c_custkey AS STRING) AS id,
               CASE WHEN c_custkey % 14 <> 0 THEN 'D' || CAST(c_custkey AS STRING) END AS document_number,
               'Cliente' || CAST(c_custkey AS STRING) AS first_name, c_mktsegment AS last_name
        FROM {customer} WHERE c_custkey % 2 = 0""",
    "store_customer": f"""
        SELECT 'D' || CAST(c_custkey AS STRING) AS document_number,
               CASE WHEN c_custkey % 21 <> 0 THEN {_phone(_SHARED)} END AS phone_number,
               CASE WHEN c_custkey % 9 <> 0 THEN 'Loja' || CAST(c_custkey AS STRING) END AS first_name,
               CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS last_name
        FROM {{customer}} WHERE c_custkey % 3 = 0""",
    "food99_customer": f"""
        SELECT 'U' || CAST(c_custkey AS STRING) AS c_uid, {_phone("c_custkey")} AS phone_number,
               'Noventa' || CAST(c_custkey AS STRING) AS first_name, c_mktsegment AS last_name
        FROM {{customer}} WHERE c_custkey % 5 = 0""",
    "app_orders": """
        SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS STRING) END AS customer_id,
               CASE WHEN o_orderkey % 3 = 1 THEN 'U' || CAST(o_custkey AS STRING) END AS c_uid,
               o_totalprice AS total_bag_detail, o_orderdate AS created_at
        FROM {orders} WHERE o_orderkey % 3 <> 2""",
    "store_sales": """
        SELECT 'D' || CAST(o_custkey AS STRING) AS client_cpf, o_totalprice AS total, o_orderdate AS created_at
        FROM {orders} WHERE o_orderkey % 3 = 2""",
    "contact_log": """
        SELECT ts AS timestamp, CAST(user_id AS STRING) AS customer_id,
               'Cliente' || CAST(user_id AS STRING) AS customer_name, CAST(user_id AS STRING) AS phone,
               CASE WHEN value >= 10 THEN 'A' ELSE 'B' END AS segment,
               CASE event_type WHEN 'purchase' THEN 'Promoção' WHEN 'view' THEN 'Saudades'
                               WHEN 'click' THEN 'Agradecimento' ELSE 'Feedback' END AS message_type,
               props AS message_body
        FROM {events}""",
    "process_last_run": """
        SELECT max(ts) AS last_run_date, event_type AS process_key, upper(event_type) AS name
        FROM {events} GROUP BY event_type""",
}

#: Views that replace some of the above: ids under two names, and sales of one day in two channels.
SHARED_IDS = {
    "ifood_customer": VIEWS["ifood_customer"]
    + """
        UNION ALL
        SELECT CAST(c_custkey AS STRING), CASE WHEN c_custkey % 14 <> 0 THEN 'D' || CAST(c_custkey AS STRING) END,
               'Outra' || CAST(c_custkey AS STRING), c_mktsegment
        FROM {customer} WHERE c_custkey % 8 = 4""",
    "store_sales": """
        SELECT 'D' || CAST(o_custkey AS STRING) AS client_cpf, o_totalprice AS total, o_orderdate AS created_at
        FROM {orders} WHERE o_orderkey % 3 <> 1""",
}
#: Names with accents, in capitals and in small letters.
ACCENTED = {
    "ifood_customer": """
        SELECT CAST(c_custkey AS STRING) AS id,
               CASE WHEN c_custkey % 14 <> 0 THEN 'D' || CAST(c_custkey AS STRING) END AS document_number,
               CASE c_custkey % 3 WHEN 0 THEN 'JOÃO' WHEN 1 THEN 'Zélia' ELSE 'Ana' END AS first_name,
               CASE WHEN c_custkey % 4 = 0 THEN 'ÁVILA' ELSE 'Conceição' END AS last_name
        FROM {customer} WHERE c_custkey % 2 = 0""",
}

_TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def sample_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") for name, schema in _TABLES.items()}


def sample_view(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    return spark.sql(text, **{table: df for table, df in tables.items() if "{" + table + "}" in text})


def sample_shop(spark: SparkSession, folder: str, changed: dict[str, str] | None = None) -> Shop:
    tables = sample_tables(spark, folder)
    return Shop(**{name: sample_view(spark, text, tables) for name, text in (VIEWS | (changed or {})).items()})


def streamed_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """The contact log as a stream of the events file."""
    events = spark.readStream.schema(_TABLES["events"]).parquet(f"{folder}/events*.parquet")
    return sample_view(spark, VIEWS["contact_log"], {"events": events})


def view_text(name: str, changed: dict[str, str] | None = None) -> str:
    """The same view for an engine that has the test tables registered under their own names."""
    return (VIEWS | (changed or {}))[name].format(**{table: table for table in _TABLES})
