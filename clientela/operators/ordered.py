"""Positions, running totals, quartiles and pages over one global order, without a single-task sort.

Whole numbers are counted in bins of fixed borders. Counts of bins narrow a position down to its value, or to
a few rows that are then put in order by themselves. Where many rows tie in the number, the rest of the
order decides between them: a bounded sample, drawn by hash, gives the borders for the next count. No table
is range-partitioned, and nothing is written but where a result needs its input twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from math import sqrt

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from clientela.session import materialize

#: Bins an interval is cut into in one pass of :func:`values_at`; a pass gathers this many counts per interval.
BINS = 1 << 14
#: Accuracy of the quantile sketch: ranks are off by one in this many rows at most.
ACCURACY = 10_000
#: Distances, in shares of all rows, at which the sketch notes values around a quantile.
MARGINS = (0.0005, 0.005, 0.05)
#: Rows a sample brings to the driver, on average.
SAMPLE = 4096
#: Rows that are put in order by one task.
TASK_ROWS = 1_000_000
#: Bins per power of two in :func:`log_bin`; a bin's values differ by a thousandth at most.
STEPS = 1024
_HASHES = 1 << 32


def log_bin(value: str) -> str:
    """A bin number that never falls as the whole number rises, for any long: about 129,000 bins in all."""

    def above(x: str) -> str:
        exponent = f"floor(log2(CAST({x} AS DOUBLE)))"
        return f"CAST(floor(({exponent} + CAST({x} AS DOUBLE) / pow(2D, {exponent}) - 1) * {STEPS}) + 1 AS BIGINT)"

    return f"CASE WHEN {value} > 0 THEN {above(value)} WHEN {value} < 0 THEN -{above(f'(-({value}))')} ELSE 0L END"


def sketch(value: str, quantiles: Sequence[float]) -> str:
    """Aggregate for :func:`bracket`: values at some distances around each quantile, from Spark's mergeable sketch."""
    around = [min(max(q + side * m, 0.0), 1.0) for q in quantiles for m in MARGINS for side in (-1, 1)]
    return f"approx_percentile({value}, array({', '.join(f'{x!r}D' for x in around)}), {ACCURACY})"


def bracket(sketched: Sequence[int], which: int, rows: int, low: int, high: int) -> tuple[int, int, int]:
    """An interval that should hold the values at the ``which``-th quantile, and about how many rows lie strictly inside; :func:`values_at` checks that it does."""
    for k, margin in enumerate(MARGINS):
        if margin * rows >= rows / ACCURACY + 2:
            first = 2 * (which * len(MARGINS) + k)
            return sketched[first], sketched[first + 1], int(2 * rows * (margin + 1 / ACCURACY)) + 1
    return low, high, rows


@dataclass(frozen=True)
class _Interval:
    low: int
    high: int
    width: int  # of a bin


def _disjoint(intervals: Sequence[tuple[int, int, int]]) -> list[_Interval]:
    """Intervals in order; those that overlap become one. Where few rows lie inside, each value is a bin of its own."""
    joined: list[list[int]] = []
    for low, high, rows in sorted(set(intervals)):
        if joined and low <= joined[-1][1]:
            joined[-1] = [joined[-1][0], max(joined[-1][1], high), joined[-1][2] + rows]
        else:
            joined.append([low, high, rows])
    return [_Interval(low, high, 1 if rows <= BINS else (high - low) // BINS + 1) for low, high, rows in joined]


def _zone(value: str, number: int, intervals: Sequence[_Interval]) -> str:
    """Where a value lies: in a bin of one of the intervals (odd zones), or between them (even zones)."""

    def place(zone: int, at: str = "0L") -> str:
        return f"named_struct('number', {number}, 'zone', {zone}, 'bin', {at})"

    whens = []
    for j, i in enumerate(intervals):
        whens.append(f"WHEN {value} < {i.low}L THEN {place(2 * j)}")
        whens.append(f"WHEN {value} <= {i.high}L THEN {place(2 * j + 1, f'({value} - {i.low}L) div {i.width}L')}")
    return f"CASE {' '.join(whens)} ELSE {place(2 * len(intervals))} END"


def _range(zone: int, at: int, intervals: Sequence[_Interval], least: int, most: int) -> tuple[int, int]:
    """Values that a bin or a gap spans."""
    j, inside = divmod(zone, 2)
    if inside:
        i = intervals[j]
        return i.low + at * i.width, min(i.low + (at + 1) * i.width - 1, i.high)
    return (intervals[j - 1].high + 1 if j else least), (intervals[j].low - 1 if j < len(intervals) else most)


@dataclass(frozen=True)
class At:
    """What stands at a position: the value, the rows below it, and the rows that have it."""

    value: int
    below: int
    count: int


def values_at(
    df: DataFrame, wanted: Mapping[str, Mapping[int, tuple[int, int, int]]], limits: Mapping[str, tuple[int, int]]
) -> dict[str, dict[int, At]]:
    """For each whole-number expression, what stands at 0-based positions in ascending order.

    ``wanted`` gives an interval to look in for each position, and about how many rows lie strictly inside; ``limits``
    the least and greatest value. A pass counts all expressions' rows by bin and goes on with the bin that holds
    the position, or with the gap between intervals where the interval did not hold it: one or two passes from
    good intervals, six at most without.
    """
    open_now = {value: dict(positions) for value, positions in wanted.items()}
    found: dict[str, dict[int, At]] = {value: {} for value in wanted}
    while any(open_now.values()):
        values = [value for value in open_now if open_now[value]]
        intervals = {value: _disjoint(list(open_now[value].values())) for value in values}
        zones = ", ".join(_zone(value, k, intervals[value]) for k, value in enumerate(values))
        counted = df.selectExpr(f"inline(array({zones}))").groupBy("number", "zone", "bin").count().collect()
        for k, value in enumerate(values):
            below = 0
            for _, zone, at, count in sorted(tuple(row) for row in counted if row["number"] == k):
                low, high = _range(zone, at, intervals[value], *limits[value])
                for position in [p for p in open_now[value] if below <= p < below + count]:
                    if low == high:
                        del open_now[value][position]
                        found[value][position] = At(low, below, count)
                    else:
                        open_now[value][position] = (low, high, count)
                below += count
    return found


def _literal(df: DataFrame, columns: Sequence[str], values: Sequence) -> Column:
    return F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(columns, values)])


def _ascending(row: Sequence) -> tuple:
    """Sorts as Spark sorts structs: nulls first, texts by their bytes."""
    return tuple((v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0) for v in row)


def _drawn(hashed: Sequence[str], share: float) -> Column:
    """A share of the rows, chosen by hash: the same ones in every run."""
    return F.pmod(F.xxhash64(*hashed), F.lit(_HASHES)) < F.lit(int(min(share, 1.0) * _HASHES))


@dataclass(frozen=True)
class Bracket:
    """Rows that meet a condition; they are consecutive in the order, ``below`` rows come before them."""

    condition: Column
    below: int
    rows: int
    #: How many times as many keys to draw as usual: more where a sample came out empty, as few keys have many rows.
    draw: int = 1

    @property
    def share(self) -> float:
        return SAMPLE * self.draw / self.rows


def _place_in(counted: Sequence[tuple[tuple, int]], place: int) -> tuple[int, int]:
    """(number of the key that holds a place, rows before that key) among keys in order with their rows."""
    before = 0
    for k, (_, rows) in enumerate(counted):
        if place < before + rows:
            return k, before
        before += rows
    return len(counted) - 1, before - counted[-1][1]


def keys_at(df: DataFrame, columns: Sequence[str], brackets: Mapping[int, Bracket]) -> dict[int, tuple[tuple, int]]:
    """(values of the columns, rows below) at 0-based positions of ``df`` in ascending order by ``columns``.

    Each position comes with a bracket that holds it. Of a bracket's keys a sample is drawn by hash, with the rows of
    each; a small bracket is drawn whole. Two borders close around the position come from the sample, the rows
    before and between them are counted, and the search goes on there, in about a fifteenth of the rows.
    """
    key, found, left = F.struct(*columns), {}, dict(brackets)
    while left:
        places = sorted(left)
        # a row may lie in the brackets of several positions
        tags = F.array_compact(F.array(*[F.when(left[p].condition & _drawn(columns, left[p].share), F.lit(p)) for p in places]))
        drawn = df.select(*columns, F.explode(tags).alias("_place")).groupBy("_place", *columns).count().collect()
        borders = {}
        for place in places:
            here = left[place]
            counted = sorted(((tuple(row)[1:-1], row["count"]) for row in drawn if row["_place"] == place), key=lambda c: _ascending(c[0]))
            if here.share >= 1:  # the whole bracket
                k, before = _place_in(counted, place - here.below)
                found[place] = (counted[k][0], here.below + before)
                del left[place]
            elif not counted:
                left[place] = replace(here, draw=16 * here.draw)
            else:
                k, _ = _place_in(counted, int((place - here.below) / here.rows * sum(rows for _, rows in counted)))
                margin = int(2.5 * sqrt(len(counted))) + 1
                low, high = max(0, k - margin), min(len(counted) - 1, k + margin)
                if high - low > len(counted) // 2:  # too few keys to close in on both sides: halve
                    low = high = len(counted) // 2
                borders[place] = counted[low][0], counted[high][0]
        if not borders:
            continue
        counts = []
        for place, edges in borders.items():
            condition, (first, last) = left[place].condition, (_literal(df, columns, edge) for edge in edges)
            counts += [F.count_if(condition & (key < first)).alias(f"before_{place}"), F.count_if(condition & (key >= first) & (key <= last)).alias(f"inside_{place}")]
        counted = df.agg(*counts).first()
        for place, (low, high) in borders.items():
            here, before, inside = left[place], counted[f"before_{place}"], counted[f"inside_{place}"]
            first, last = _literal(df, columns, low), _literal(df, columns, high)
            if place < here.below + before:
                left[place] = Bracket(here.condition & (key < first), here.below, before)
            elif place >= here.below + before + inside:
                left[place] = Bracket(here.condition & (key > last), here.below + before + inside, here.rows - before - inside)
            elif low == high:
                found[place] = (low, here.below + before)
                del left[place]
            else:
                left[place] = Bracket(here.condition & (key >= first) & (key <= last), here.below + before, inside)
    return found


def rows_between(df: DataFrame, value: str, ties: Sequence[str], first: int, last: int) -> DataFrame:
    """Rows at positions ``first`` (from 0) to ``last`` (exclusive), in order: by a whole number, largest first and null last, then ``ties`` ascending.

    Rows are counted by bin of the number first; only those in the bins that hold the positions are put in
    order. Where these are too many, because rows tie, they are narrowed down by the whole key.
    """
    keyed = df.selectExpr("*", f"{value} IS NULL AS _blank", f"-({value}) AS _less").selectExpr("*", f"{log_bin('_less')} AS _bin")
    below, inside, span = 0, 0, []
    for row in sorted(keyed.groupBy("_blank", "_bin").count().collect(), key=lambda r: (r["_blank"], r["_bin"])):
        if below + inside + row["count"] <= first:
            below += row["count"]
        elif below + inside < last:
            inside += row["count"]
            span.append((row["_blank"], row["_bin"]))
    if not span:
        return df.limit(0)
    place, (low, high) = F.struct("_blank", "_bin"), (_literal(keyed, ["_blank", "_bin"], edge) for edge in (span[0], span[-1]))
    condition, last = (place >= low) & (place <= high), min(last, below + inside)
    order = ["_blank", "_less", *ties]
    if inside > TASK_ROWS + last - first:
        held = Bracket(condition, below, inside)
        edges = keys_at(keyed, order, {first: held, last - 1: held})
        key, below = F.struct(*order), edges[first][1]
        condition = condition & (key >= _literal(keyed, order, edges[first][0])) & (key <= _literal(keyed, order, edges[last - 1][0]))
    ordered = keyed.where(condition).orderBy(*[F.asc_nulls_first(c) for c in order])
    return ordered.offset(first - below).limit(last - first).select(*df.columns)


def rows_after(df: DataFrame, value: str, ties: Sequence[str], key: Sequence | None, shown: int, rows: int) -> DataFrame:
    """The next rows of the same order: those at or after ``key`` (value, then ties), less the ``shown`` rows equal to it.

    One evaluation of ``df``, in which every task keeps no more rows than are asked for and shown.
    """
    keyed = df.selectExpr("*", f"{value} IS NULL AS _blank", f"-({value}) AS _less")
    order = ["_blank", "_less", *ties]
    if key is not None:
        at = (key[0] is None, None if key[0] is None else -key[0], *key[1:])
        keyed = keyed.where(F.struct(*order) >= _literal(keyed, order, at))
    return keyed.orderBy(*[F.asc_nulls_first(c) for c in order]).offset(shown).limit(rows).select(*df.columns)


def _decimal_sum(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(28,0)"))


def _parts(stored: DataFrame, order: Sequence[str]) -> Column:
    """Number of a row's part within its bin: bins that are too large for one task are cut by borders from a sample."""
    large = stored.groupBy("_bin").count().where(F.col("count") > TASK_ROWS).collect()
    if not large:
        return F.lit(0)
    wanted = {row["_bin"]: -(-row["count"] // TASK_ROWS) for row in large}
    rows = {row["_bin"]: row["count"] for row in large}
    drawn = F.coalesce(*[F.when((F.col("_bin") == b), _drawn(order, 64 * parts / rows[b])) for b, parts in wanted.items()], F.lit(False))
    sample: dict[int, list[tuple]] = {}
    for row in stored.where(drawn).select("_bin", *order).collect():
        sample.setdefault(row["_bin"], []).append(tuple(row)[1:])
    part = F.lit(0)
    for b, keys in sample.items():
        ranked = sorted(keys, key=_ascending)
        borders = F.array(*[_literal(stored, order, ranked[len(ranked) * k // wanted[b]]) for k in range(1, wanted[b])])
        part = F.when(F.col("_bin") == b, F.size(F.filter(borders, lambda border: border <= F.struct(*order)))).otherwise(part)
    return part


def with_global_order(df: DataFrame, value: str, ties: Sequence[str], running: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``position`` (from 1) by a whole number, largest first and null last, then ``ties`` (a unique key).

    For each ``running`` name the running total of a whole-number column is added, and its whole total as
    ``<name>_total``: decimals, which cannot overflow and do not depend on the slicing. The table is stored once;
    its slices are the bins of the number, cut further where many rows tie. Slice totals give each slice its offset.
    """
    running = dict(running or {})
    keyed = df.selectExpr("*", f"{value} IS NULL AS _blank", f"-({value}) AS _less")
    stored = materialize(keyed.selectExpr("*", f"IF(_blank, {1 << 40}L, {log_bin('_less')}) AS _bin"), "binned")
    order = ["_blank", "_less", *ties]
    sliced = stored.withColumn("_part", _parts(stored, order))
    slice_key = ["_bin", "_part"]
    totals = sliced.groupBy(*slice_key).agg(
        F.count(F.lit(1)).alias("rows_here"),
        *[_decimal_sum(c).cast("decimal(38,0)").alias(f"{name}_here") for name, c in running.items()],
    )
    # One row per slice: as many as there are bins, whatever the size of the table.
    all_slices = Window.orderBy(*slice_key)
    earlier = all_slices.rowsBetween(Window.unboundedPreceding, -1)
    every = all_slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        F.struct(*slice_key).alias("_slice"),
        F.coalesce(F.sum("rows_here").over(earlier), F.lit(0)).alias("rows_before"),
        *[F.coalesce(F.sum(f"{name}_here").over(earlier), F.lit(0)).alias(f"{name}_before") for name in running],
        *[F.coalesce(F.sum(f"{name}_here").over(every), F.lit(0)).alias(f"{name}_total") for name in running],
    )
    inside = Window.partitionBy(*slice_key).orderBy(*[F.asc_nulls_first(c) for c in order])
    to_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = sliced.select(
        "*",
        F.struct(*slice_key).alias("_slice"),
        F.row_number().over(inside).alias("row_here"),
        *[_decimal_sum(c).over(to_here).alias(f"{name}_run") for name, c in running.items()],
    )
    return numbered.join(F.broadcast(offsets), "_slice").select(
        *df.columns,
        (F.col("rows_before") + F.col("row_here")).cast("bigint").alias("position"),
        *[(F.col(f"{name}_before") + F.col(f"{name}_run")).cast("decimal(38,0)").alias(name) for name in running],
        *[F.col(f"{name}_total").cast("decimal(38,0)").alias(f"{name}_total") for name in running],
    )
