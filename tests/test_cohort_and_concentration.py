import datetime as dt
from decimal import Decimal

import pandas as pd
import pytest

from clientela.plans.rfm import rfm_base
from clientela.plans import cohort, concentration
from conftest import local_frame, tuples
from test_rfm import BASE, DAY

PEOPLE = [(str(i), None, f"N{i}", "x") for i in range(1, 7)]


def test_cut_off_is_twelve_months_before_by_day(make_shop):
    sales = [("1", 1, "2023-02-27"), ("2", 1, "2023-02-28"), ("2", 1, "2024-02-29 23:59"), ("3", 1, "2024-03-01"), ("4", 1, None)]
    shop = make_shop(PEOPLE, ifood_sales=sales)
    rows = tuples(cohort.cohort_counts(shop, dt.date(2024, 2, 29)))
    assert rows == [(dt.date(2023, 2, 1), 1, 1), (dt.date(2023, 2, 1), 13, 1)]


def test_matrix_and_retention(make_shop):
    sales = [("1", 1, "2024-01-05"), ("1", 1, "2024-01-06"), ("2", 1, "2024-01-31"), ("2", 1, "2024-03-01"), ("3", 1, "2024-02-01")]
    counts = cohort.cohort_counts(make_shop(PEOPLE, ifood_sales=sales), dt.date(2024, 12, 31))
    matrix = cohort.cohort_matrix(counts)
    assert matrix.columns == ["cohort_month", *[f"m{i}" for i in range(1, 14)]]
    january, february = matrix.collect()
    assert (january["m1"], january["m2"], january["m3"], february["m1"]) == (2, None, 1, 1)
    retention = cohort.cohort_retention(matrix)
    first = retention.collect()[0]
    assert (first["cohort_month"], first["m1"], first["m2"], first["m3"]) == ("2024-01", 1.0, None, 0.5)
    shown = cohort.percent_text(retention).collect()[0]
    assert (shown["m1"], shown["m2"], shown["m3"]) == ("100.0%", "", "50.0%")


def test_first_purchase_is_taken_within_the_channel(make_shop):
    shop = make_shop(
        [("1", "d", "A", "a")], [("d", None, None, None)],
        ifood_sales=[("1", 1, "2023-01-01")], store_sales=[("d", 1, "2024-05-01")],
    )
    assert tuples(cohort.cohort_counts(shop, dt.date(2024, 6, 1))) == []
    assert tuples(cohort.cohort_counts(shop, dt.date(2024, 6, 1), "Loja")) == [(dt.date(2024, 5, 1), 1, 1)]


def test_empty_cohort(make_shop):
    counts = cohort.cohort_counts(make_shop())
    assert cohort.cohort_retention(cohort.cohort_matrix(counts)).count() == 0


def base(spark, values):
    rows = [(f"c{i:03d}", f"N{i}", "", m, 1, DAY, DAY, 1, c, "Loja") for i, (m, c) in enumerate(values)]
    return local_frame(spark, rows, BASE)


def test_curve_equals_a_running_sum(spark, settings):
    settings(adaptive__coalescePartitions__enabled="false")
    money = [round((i * 37 % 50) + i / 100, 2) for i in range(1, 200)] + [10.0] * 100
    curve = concentration.abc_curve(base(spark, [(m, None) for m in money]))
    rows = curve.orderBy("position").collect()
    ordered = pd.Series(sorted(map(lambda m: Decimal(str(m)), money), reverse=True))
    expected = [float(100 * x / ordered.sum()) for x in ordered.cumsum()]
    assert [r["position"] for r in rows] == list(range(1, len(money) + 1))
    assert [r["cum_perc"] for r in rows] == pytest.approx(expected, abs=1e-9)
    assert rows[-1]["cum_perc"] == 100.0
    summary = concentration.abc_summary(curve).first()
    assert summary["total_count"] == len(money)
    assert summary["vip_count"] == sum(e <= 80 for e in expected)


def test_curve_of_nobody_and_of_no_revenue(spark):
    assert tuple(concentration.abc_summary(concentration.abc_curve(base(spark, []))).first()) == (0, 0, None)
    assert [r["cum_perc"] for r in concentration.abc_curve(base(spark, [(0.0, None)])).collect()] == [None]


def test_cycle_bands(spark):
    frame = base(spark, [(1.0, c) for c in (0.0, None, 6.9, 7.0, 13.99, 14.0, 106.5)])
    by_text = [tuple(r) for r in concentration.repurchase_cycle(frame).collect()]
    assert by_text == [("0-7 dias", 1), ("105-112 dias", 1), ("14-21 dias", 1), ("7-14 dias", 2)]
    by_days = [r["faixa"] for r in concentration.repurchase_cycle(frame, top=2, order="numeric").collect()]
    assert by_days == ["0-7 dias", "7-14 dias"]
    mean = concentration.repurchase_cycle_mean(frame).first()["mean_days"]
    assert mean == pytest.approx((6.9 + 7.0 + 13.99 + 14.0 + 106.5) / 5)
    with pytest.raises(ValueError):
        concentration.repurchase_cycle(frame, order="size")


def test_percent_text_equals_python(spark):
    shares = [1 / 16, 1 / 8, 3 / 16, 0.0015, 0.0005, 0.00049, 1 / 3, 2 / 3, 1.0, 0.0, 0.0625 / 2, 0.9995, 0.99949, 5 / 2000, 7 / 2000, 0.12345] + [a / b for b in (7, 16, 40, 80, 2000) for a in range(1, b, max(1, b // 40))]
    wide = local_frame(spark, [(str(k), share) for k, share in enumerate(shares)], "cohort_month string, m1 double")
    shown = {r["cohort_month"]: r["m1"] for r in cohort.percent_text(wide).collect()}
    assert shown == {str(k): f"{share:.1%}" for k, share in enumerate(shares)}


def test_sales_after_today_are_dropped_and_cells_beyond_the_matrix_raise(spark, make_shop):
    today = dt.datetime.now(dt.timezone.utc).date()
    days = [str(today - dt.timedelta(days=40)), str(today), str(today + dt.timedelta(days=3)), str(today + dt.timedelta(days=500))]
    for kind in ("timestamp_ntz", "timestamp"):
        shop = make_shop([("1", None, "A", "a")], ifood_sales=[("1", 1, day) for day in days], kind=kind)
        assert rfm_base(shop).first()["recency"] == 0 and rfm_base(shop).first()["frequency"] == 2
        assert {r["cohort_index"] for r in cohort.cohort_counts(shop).collect()} <= {1, 2, 3}
    late = local_frame(spark, [(DAY, 14, 1)], "cohort_month date, cohort_index bigint, customers bigint")
    with pytest.raises(Exception, match="beyond m13"):
        cohort.cohort_matrix(late).collect()


@pytest.mark.parametrize("zone", ["Pacific/Kiritimati", "Pacific/Pago_Pago"])
def test_the_default_day_is_utc(spark, settings, zone):
    from clientela.functions.times import reference_date

    settings(session__timeZone=zone)
    before = dt.datetime.now(dt.timezone.utc).date()
    day = spark.sql(f"SELECT {reference_date(None)}").first()[0]
    assert before <= day <= dt.datetime.now(dt.timezone.utc).date()
