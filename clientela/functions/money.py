"""Money as whole numbers of 1/10000, so that sums are exact and do not depend on partitioning.

The functions return SQL expressions over the names or expressions they are given.
"""

from __future__ import annotations

UNITS_PER_ONE = 10_000
UNITS_PER_CENT = UNITS_PER_ONE // 100


def to_units(total: str) -> str:
    """Whole units of a total; a total with a finer part is refused, as its sums would be wrong."""
    scaled = f"({total} * {UNITS_PER_ONE}D)"
    finer = f"abs({scaled} - rint({scaled})) > greatest(1e-4, abs({scaled}) * 1e-12)"
    refused = f"CAST(raise_error(concat('total has more than 4 decimals: ', {total})) AS BIGINT)"
    return f"IF({finer}, {refused}, CAST(rint({scaled}) AS BIGINT))"


def from_units(units: str) -> str:
    return f"CAST({units} AS DOUBLE) / {UNITS_PER_ONE}D"


def mean_rounded_to_cents(units: str, rows: str) -> str:
    """``round(sum / rows, 2)``, halves away from zero, computed on whole numbers."""
    cents = f"(abs({units}) + {rows} * {UNITS_PER_CENT // 2}) div ({rows} * {UNITS_PER_CENT})"
    return f"signum({units}) * ({cents}) / 100D"


def ratio_rounded(numerator: str, denominator: str) -> str:
    """``round(numerator / denominator, 2)`` of non-negative whole numbers, halves up."""
    return f"(({numerator}) * 200L + ({denominator})) div (({denominator}) * 2L) / 100D"
