"""The stored rollup against the facts it stands for."""

import datetime as dt
import os
import re

import pytest

from clientela.operators import rollup
from clientela.plans import cohort, frequency, rfm
from conftest import tuples

IFOOD = [("1", "D1", "Ana", "Lima"), ("2", None, "Rui", "Reis")]
STORE = [("D1", "(11) 900000001", "Ana", "L")]
FIRST = [("1", 10.5, "2024-01-05 10:00"), ("1", 3, "2024-01-05 23:59"), ("1", None, "2024-02-29 00:00"), ("2", 7, None)]
SHOP = {"ifood": IFOOD, "store": STORE, "store_sales": [("D1", 4, "2024-03-31 12:00")]}
DAY = dt.date(2024, 6, 30)
ANALYSES = {
    "listing": frequency.customer_frequency,
    "one document": lambda shop: frequency.customer_frequency(shop, document_number="D1"),
    "count": frequency.customer_count,
    "rfm": lambda shop: rfm.rfm_base(shop, DAY),
    "rfm of one channel": lambda shop: rfm.rfm_base(shop, DAY, "iFood"),
    "rfm before": lambda shop: rfm.rfm_base(shop, dt.date(2024, 2, 28)),
    "cohort": lambda shop: cohort.cohort_counts(shop, DAY),
}


def same(shop, path):
    stored = shop.with_rollup(path)
    for name, analysis in ANALYSES.items():
        assert tuples(analysis(stored)) == tuples(analysis(shop)), name


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_analyses_are_the_same(make_shop, tmp_path, kind):
    shop = make_shop(**SHOP, ifood_sales=FIRST, kind=kind)
    rollup.store_rollup(shop, str(tmp_path / "r"))
    same(shop, str(tmp_path / "r"))


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_refresh_writes_only_the_months_of_the_days(make_shop, tmp_path, kind):
    path = str(tmp_path / "r")
    rollup.store_rollup(make_shop(**SHOP, ifood_sales=FIRST, kind=kind), path)
    before = {folder: sorted(os.listdir(f"{path}/{folder}")) for folder in os.listdir(path) if "month" in folder}
    # a late sale in January, all of February taken back, a new month
    sales = [FIRST[0], FIRST[1], ("2", 8, "2024-01-31 23:59"), FIRST[3], ("2", 1, "2024-12-31 23:59")]
    shop = make_shop(**SHOP, ifood_sales=sales, kind=kind)
    days = [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 12, 31)]
    for _ in range(2):  # twice is the same as once
        rollup.refresh_rollup(shop, path, days)
        same(shop, path)
    after = {folder: sorted(os.listdir(f"{path}/{folder}")) for folder in os.listdir(path) if "month" in folder}
    january, february, march, december = (f"month={2024 * 12 + month}" for month in (0, 1, 2, 11))
    assert february in before and february not in after and december in after
    assert before[january] != after[january] and before[march] == after[march]
    assert [before[f] == after[f] for f in before if "HIVE" in f] == [True]


def test_no_days_no_sales(make_shop, spark, tmp_path):
    path = str(tmp_path / "r")
    shop = make_shop(**SHOP, ifood_sales=FIRST)
    rollup.store_rollup(shop, path)
    rollup.refresh_rollup(shop, path, [])
    assert rollup.read_rollup(spark, path).count() == 4
    empty = make_shop(ifood=IFOOD)
    rollup.store_rollup(empty, path)
    assert tuples(frequency.customer_count(empty.with_rollup(path))) == [(0,)]


def test_a_hot_key_is_one_row_a_day(make_shop, spark, tmp_path):
    path = str(tmp_path / "r")
    shop = make_shop(**SHOP, ifood_sales=[("1", 1, "2024-01-05")] * 5000 + FIRST)
    rollup.store_rollup(shop, path)
    assert rollup.read_rollup(spark, path).count() == 4
    same(shop, path)


def test_four_analyses_read_no_fact_and_only_the_months_before_the_day(make_shop, tmp_path):
    shop = make_shop(**SHOP, ifood_sales=FIRST)
    rollup.store_rollup(shop, str(tmp_path / "r"))
    stored = shop.with_rollup(str(tmp_path / "r"))
    for name in ("listing", "count", "rfm", "cohort"):
        plan = ANALYSES[name](stored)._jdf.queryExecution().optimizedPlan().toString()
        assert "total_bag_detail" not in plan and "client_cpf" not in plan, name
    plan = ANALYSES["rfm before"](stored)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ <= 24289", plan)
