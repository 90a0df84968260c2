"""Data quality of the registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The keys that registries are matched by: (registry, column).
MATCHED_KEYS = (
    ("ifood_customer", "document_number"),
    ("store_customer", "document_number"),
    ("store_customer", "phone_number"),
    ("food99_customer", "phone_number"),
)


def duplicate_keys(shop) -> DataFrame:
    """For each matched key: values held by several registry rows, and the rows that hold them.

    Such rows fan out: one registry row gives several ids, and its sales count once for each.
    """

    def counted(registry: str, column: str) -> DataFrame:
        values = getattr(shop, registry).where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        found = values.agg(F.expr("count_if(n > 1) AS repeated_values"), F.expr("coalesce(sum(IF(n > 1, n, 0)), 0) AS rows_in_them"))
        return found.selectExpr(f"'{registry}' AS registry", f"'{column}' AS key", "repeated_values", "rows_in_them")

    return reduce(DataFrame.unionByName, [counted(*pair) for pair in MATCHED_KEYS])
