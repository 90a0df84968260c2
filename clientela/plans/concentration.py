"""ABC (Pareto) curve of revenue, and the repurchase cycle of returning customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.functions.money import to_units
from clientela.operators.ordered import with_global_order

VIP_SHARE = 80
CYCLE_DAYS = 7
CYCLE_BARS = 10


def abc_curve(base: DataFrame) -> DataFrame:
    """``position, id, monetary, cum_perc``: customers by value, highest first, with the running share."""
    table = base.selectExpr("id", "name", "monetary", f"{to_units('monetary')} AS units")
    ordered = with_global_order(table, "units", ["id", "name"], {"running": "units"})
    share = "try_divide(100D * CAST(running AS DOUBLE), CAST(running_total AS DOUBLE))"
    return ordered.selectExpr("position", "id", "monetary", f"IF(monetary IS NULL, NULL, {share}) AS cum_perc")


def abc_summary(curve: DataFrame, cut: float = VIP_SHARE) -> DataFrame:
    """How many customers lie within the first ``cut`` percent of revenue."""
    counts = curve.agg(F.expr(f"count_if(cum_perc <= {cut}) AS vip_count"), F.expr("count(1) AS total_count"))
    return counts.selectExpr("*", "try_divide(100D * vip_count, total_count) AS vip_percent")


def _returning(base: DataFrame) -> DataFrame:
    return base.where("avg_cycle > 0")


def repurchase_cycle(base: DataFrame, top: int = CYCLE_BARS, order: str = "text") -> DataFrame:
    """Customers per seven-day band of their mean gap: the first ``top`` bands by label.

    Bands sort as text (``105-112`` before ``14-21``); ``order="numeric"`` sorts by days.
    """
    if order not in ("text", "numeric"):
        raise ValueError("order is 'text' or 'numeric'")
    start = f"CAST(floor(avg_cycle / {CYCLE_DAYS}) * {CYCLE_DAYS} AS BIGINT) AS start"
    bands = _returning(base).selectExpr(start).groupBy("start").agg(F.expr("count(1) AS customers"))
    named = bands.selectExpr("start", f"concat(start, '-', start + {CYCLE_DAYS}, ' dias') AS faixa", "customers")
    return named.orderBy("faixa" if order == "text" else "start").limit(top).select("faixa", "customers")


def repurchase_cycle_mean(base: DataFrame) -> DataFrame:
    return _returning(base).agg(F.avg("avg_cycle").alias("mean_days"))
