"""Schemas of the input tables. Reading with them avoids inference and keeps types stable."""

from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType


def _strings(*names: str) -> list[StructField]:
    return [StructField(name, StringType()) for name in names]


IFOOD_CUSTOMER = StructType(_strings("id", "document_number", "first_name", "last_name"))
STORE_CUSTOMER = StructType(_strings("document_number", "phone_number", "first_name", "last_name"))
FOOD99_CUSTOMER = StructType(_strings("c_uid", "phone_number", "first_name", "last_name"))

APP_ORDERS = StructType(
    _strings("customer_id", "c_uid")
    + [StructField("total_bag_detail", DoubleType()), StructField("created_at", TimestampType())]
)
STORE_SALES = StructType(
    _strings("client_cpf") + [StructField("total", DoubleType()), StructField("created_at", TimestampType())]
)

CONTACT_LOG = StructType(
    [StructField("timestamp", TimestampType(), nullable=False)]
    + _strings("customer_id", "customer_name", "phone", "segment", "message_type", "message_body")
)
PROCESS_LAST_RUN = StructType([StructField("last_run_date", TimestampType())] + _strings("process_key", "name"))

TABLES = {
    "ifood_customer": IFOOD_CUSTOMER,
    "store_customer": STORE_CUSTOMER,
    "food99_customer": FOOD99_CUSTOMER,
    "app_orders": APP_ORDERS,
    "store_sales": STORE_SALES,
    "contact_log": CONTACT_LOG,
    "process_last_run": PROCESS_LAST_RUN,
}
