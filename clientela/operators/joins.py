"""Joins to a relation with one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def join_unique(left: DataFrame, unique: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``left`` to ``unique``, an aggregate by ``keys``, so that a hot key of ``left`` can be split.

    Joined by the same keys, the aggregate would go without a shuffle of its own, and adaptive
    execution splits a hot partition only where both inputs of a join come from a shuffle. So the join
    uses a marked copy of the last key. That shuffles the aggregate once more, which is small beside
    what it summarises, and nothing at all when the planner finds it small enough to broadcast.
    """
    *others, last = keys
    marked = f"{last}_mark"
    mark = f"'=' || {last} AS {marked}"
    right = unique.selectExpr("*", mark).drop(last)
    return left.selectExpr("*", mark).join(right, [*others, marked], how).drop(marked)
