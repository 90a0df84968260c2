"""Sales stored by key against the facts they copy."""

import datetime as dt
import re
from dataclasses import replace

import pytest

from clientela.operators import clustered, sales
from clientela.plans import frequency, rfm, sales_history
from conftest import tuples

IFOOD = [("1", "D1", "Ana", "Lima"), ("2", None, "Rui", "Reis"), ("D1", None, "Eva", "Dias")]
STORE = [("D1", "(11) 900000001", "Ana", "L")]
FIRST = [("1", 10.5, "2024-01-05 10:00"), ("1", None, "2024-02-29 00:00"), ("2", 7, None), ("D1", 9, "2024-02-01"), ("9", 1, "2024-01-01")]
SHOP = {"ifood": IFOOD, "store": STORE, "ifood_sales": FIRST, "store_sales": [("D1", 4, "2024-03-31 12:00")]}
ANALYSES = {
    "all": sales_history.transactions,
    "gaps": sales_history.purchase_gaps,
    "one": lambda shop: sales_history.customer_transactions(shop, "1D1"),
    "nobody": lambda shop: sales_history.customer_transactions(shop, "nobody"),
    "listing": frequency.customer_frequency,
    "rfm": lambda shop: rfm.rfm_base(shop, dt.date(2024, 6, 30), "iFood"),
}


def same(shop, path):
    for name, analysis in ANALYSES.items():
        assert tuples(analysis(shop.with_clustered(path))) == tuples(analysis(shop)), name


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_analyses_are_the_same_also_when_sales_are_added(make_shop, tmp_path, kind):
    path, shop = str(tmp_path / "c"), make_shop(**SHOP, kind=kind)
    clustered.store_clustered(shop, path, 8)
    same(shop, path)
    new = make_shop(ifood_sales=[("1", 3, "2024-05-01"), ("2", 3, "2024-05-01")], store_sales=[("D1", 3, None)], kind=kind)
    clustered.add_clustered(new, path)
    both = {name: getattr(shop, name).union(getattr(new, name)) for name in ("app_orders", "store_sales")}
    same(replace(shop, **both), path)
    clustered.store_clustered(shop.with_clustered(path), path, 4)  # from the facts, in place of what stands there
    same(shop, path)


def test_no_sales_and_no_table(make_shop, tmp_path):
    path, empty = str(tmp_path / "c"), make_shop(ifood=IFOOD)
    clustered.store_clustered(empty, path)
    same(empty, path)
    with pytest.raises(FileNotFoundError):
        empty.with_clustered(str(tmp_path / "none"))


def test_keys_choose_few_files(make_shop, tmp_path):
    path = str(tmp_path / "c")
    many = [(str(k), k, "2024-01-05 10:00") for k in range(2000)]
    shop = make_shop(ifood=[(str(k), None, "A", "B") for k in range(2000)], ifood_sales=many)
    clustered.store_clustered(shop, path, 64)
    stored = shop.with_clustered(path)
    found = sales.channel_sales(stored, keys={"iFood": ["17", "1999"]})
    assert tuples(found, "native_key", "total") == [("17", 17.0), ("1999", 1999.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    folders = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(([\d,]+)\)", plan).group(1).split(",")
    assert len(folders) == 2 and "In(native_key, [17,1999])" in plan
    assert len(list(tmp_path.glob("c/of=64/bucket=*"))) == 64


def test_a_hot_key_is_split(make_shop, tmp_path, settings):
    settings(adaptive__advisoryPartitionSizeInBytes="4k", adaptive__rebalancePartitionsSmallPartitionFactor="0.1")
    path = str(tmp_path / "c")
    hot = [("1", k, "2024-01-05 10:00") for k in range(6000)]
    shop = make_shop(ifood=IFOOD, ifood_sales=FIRST + hot)
    shop = replace(shop, app_orders=shop.app_orders.repartition(4))
    clustered.store_clustered(shop, path, 8)
    same(shop, path)
    most = max(len(list(folder.glob("*.parquet"))) for folder in tmp_path.glob("c/of=8/bucket=*"))
    assert most > 1
