import pytest

from clientela.plans import frequency
from clientela.plans.sales_history import customer_transactions, headed_transactions, purchase_gaps, transactions
from clientela.sources.csv_export import export_name, write_csv
from conftest import FORCED_SKEW, tuples

ANA, BIA = ("1", None, "Ana", "Lima"), ("2", None, "Bia", "Souza")


def one(df):
    return df.first().asDict()


def test_half_cents_round_up(make_shop):
    shop = make_shop([ANA], ifood_sales=[("1", 50.00, "2024-01-01"), ("1", 50.01, "2024-01-04")])
    row = one(frequency.customer_frequency(shop))
    assert row["ticket_medio"] == 50.01 and row["total_gasto"] == 100.01
    assert row["media_frequencia_compra"] == 3.0 and row["max_dias_sem_recompra"] == 3


def test_refunds_round_away_from_zero(make_shop):
    shop = make_shop([ANA], ifood_sales=[("1", -50.00, "2024-01-01"), ("1", -50.01, "2024-01-04")])
    assert one(frequency.customer_frequency(shop))["ticket_medio"] == -50.01


def test_gap_statistics(make_shop):
    days = ["2024-01-01", "2024-01-01 23:00", "2024-01-02", "2024-01-12", "2024-02-12"]
    row = one(frequency.customer_frequency(make_shop([ANA], ifood_sales=[("1", 1, d) for d in days])))
    assert row["media_frequencia_compra"] == 10.5 and row["max_dias_sem_recompra"] == 31
    assert (row["primeira_compra"], row["ultima_compra"], row["num_compras"]) == ("01/01/2024", "12/02/2024", 5)


def test_one_purchase_and_same_day_purchases_have_no_gap(make_shop):
    shop = make_shop([ANA, BIA], ifood_sales=[("1", 1, "2024-01-01"), ("2", 1, "2024-01-01"), ("2", 1, "2024-01-01")])
    rows = tuples(frequency.customer_frequency(shop), "id", "media_frequencia_compra", "max_dias_sem_recompra")
    assert rows == [("1", 0.0, 0), ("2", 0.0, 0)]


def test_sales_without_time_or_total(make_shop):
    shop = make_shop([ANA], ifood_sales=[("1", None, None), ("1", 2, "2024-01-01"), ("1", 4, "2024-01-05")])
    row = one(frequency.customer_frequency(shop))
    assert (row["num_compras"], row["total_gasto"], row["ticket_medio"]) == (3, 6.0, 2.0)
    assert (row["media_frequencia_compra"], row["max_dias_sem_recompra"]) == (4.0, 4)
    gaps = {str(day): gap for day, gap in tuples(purchase_gaps(shop), "sales_date", "days_between")}
    assert gaps == {"None": None, "2024-01-01": None, "2024-01-05": 4}


def test_an_order_with_both_keys_counts_in_both_channels(make_shop):
    shop = make_shop([ANA], food99=[("u", None, "Ana", "Lima")], orders=[("1", "u", 5, "2024-01-01")])
    assert tuples(transactions(shop), "id", "channel") == [("1", "iFood"), ("u", "99food")]


def test_shared_phone_counts_sales_once_per_identity(make_shop):
    shop = make_shop(
        store=[("d1", "p", "A", "a"), ("d2", "p", "B", "b")],
        food99=[("u", "p", "N", "n")],
        food99_sales=[("u", 7, "2024-01-01")],
    )
    assert tuples(frequency.customer_frequency(shop), "id", "total_gasto") == [("ud1", 7.0), ("ud2", 7.0)]


def test_listing_has_identity_rows_and_count_has_ids(make_shop):
    shop = make_shop([ANA, ANA], ifood_sales=[("1", 1, "2024-01-01")])
    listing = frequency.customer_frequency(shop)
    assert tuples(listing, "id", "num_compras") == [("1", 2), ("1", 2)]
    assert one(frequency.customer_count(shop)) == {"n": 1}


@pytest.fixture
def two_channel_shop(make_shop):
    return make_shop(
        [("1", "d", "Ana", "Lima"), BIA],
        [("d", "9", None, None)],
        ifood_sales=[("1", 1, "2024-01-01"), ("2", 5, "2024-01-01")],
        store_sales=[("d", 2, "2024-01-01")],
    )


@pytest.mark.parametrize("text", ["Loja/iFood", "iFood/Loja"])
def test_channel_filter_ignores_order(two_channel_shop, text):
    assert tuples(frequency.customer_frequency(two_channel_shop, sales_channel=text), "id") == [("1d",)]
    assert one(frequency.customer_count(two_channel_shop, sales_channel=text)) == {"n": 1}


@pytest.mark.parametrize(
    "filters,ids",
    [
        ({}, ["1d", "2"]),
        ({"sales_channel": "", "name": ""}, ["1d", "2"]),
        ({"name": "na Li"}, ["1d"]),
        ({"name": "ana"}, []),
        ({"name": "B_a"}, ["2"]),
        ({"name": "o' OR '1'='1"}, []),
        ({"phone_number": "9"}, ["1d"]),
        ({"document_number": "d"}, ["1d"]),
        ({"document_number": "d", "sales_channel": "iFood"}, []),
    ],
)
def test_filters(two_channel_shop, filters, ids):
    listing = frequency.customer_frequency(two_channel_shop, **filters)
    assert [i for (i,) in tuples(listing, "id")] == ids
    assert one(frequency.customer_count(two_channel_shop, **filters)) == {"n": len(ids)}


def test_page_count(spark):
    for customers, pages in ((0, 0), (25, 1), (26, 2)):
        counted = spark.sql(f"SELECT {customers}L AS n")
        assert one(frequency.customer_page_count(counted, 25)) == {"total": customers, "total_pages": pages}


def test_pages_add_up_to_the_listing(make_shop):
    people = [(str(i), None, f"N{i}", "x") for i in range(23)] + [("5", None, "N5", "x")] * 6
    sales = [(str(i), i % 4, "2024-01-01") for i in range(23)]
    listing = frequency.customer_frequency(make_shop(people, ifood_sales=sales))
    whole = [tuple(r) for r in listing.orderBy(*frequency.listing_order()).collect()]
    assert len(whole) == 29

    def pages():
        return [tuple(r) for n in range(1, 6) for r in frequency.page(listing, n, 7).collect()]

    assert pages() == whole
    assert frequency.page(listing, 99, 7).collect() == []


def test_export_writes_utf8_csv_with_headers(spark, make_shop, tmp_path):
    shop = make_shop([("1", None, "João", "Açaí")], ifood_sales=[("1", 1, "2024-01-01")])
    path = write_csv(frequency.customer_frequency_export(frequency.customer_frequency(shop)), str(tmp_path))
    lines = "".join(p.read_text("utf-8") for p in sorted((tmp_path / path.split("/")[-1]).glob("part-*"))).splitlines()
    assert lines[0].startswith("Cliente,1ª Compra,Última Compra") and "Id" not in lines[0].split(",")
    assert lines[1].startswith("João Açaí,01/01/2024")


def test_export_joined_parts_keep_every_value(spark, tmp_path):
    import csv
    import io

    rows = [("Ana ", 12345678.9, 3), ('Zé "Rei"', 0.5, 1), (" a,b\nc\r\nd", 1e7, 2), (None, None, None), ("", -0.25, 0), ("plain", 1234.5678, 4)]
    df = spark.createDataFrame(rows, "Cliente string, `Total, \"Gasto\"` double, n bigint").coalesce(1)
    path = write_csv(df, str(tmp_path))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / path.split("/")[-1]).glob("part-*"))).decode()
    read = list(csv.reader(io.StringIO(text, newline="")))
    assert read[0] == df.columns and text.count("Cliente") == 1
    shown = ["12345678.9", "0.5", "10000000.0", "", "-0.25", "1234.5678"]
    assert read[1:] == [[name or "", total, "" if n is None else str(n)] for (name, _, n), total in zip(rows, shown)]


def test_totals_finer_than_the_unit_are_refused(make_shop):
    shop = make_shop([ANA], ifood_sales=[("1", 0.00004, "2024-01-01"), ("1", 0.12345, "2024-01-02")])
    with pytest.raises(Exception, match="more than 4 decimals"):
        frequency.customer_frequency(shop).collect()
    exact = make_shop([ANA], ifood_sales=[("1", 0.1234, "2024-01-01"), ("1", 123456789012.3456, "2024-01-02"), ("1", None, "2024-01-03")])
    assert one(frequency.customer_frequency(exact))["total_gasto"] == 123456789012.469


def test_export_name():
    import datetime as dt

    assert export_name(dt.datetime(2024, 5, 6, 7, 8, 9)) == "clientes_20240506_070809.csv"


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_days_are_utc_and_texts_are_local(make_shop, settings, kind):
    settings(session__timeZone="Asia/Tokyo")
    shop = make_shop([ANA], ifood_sales=[("1", 1, "2024-01-01 01:30"), ("1", 2, "2024-03-01 23:30")], kind=kind)
    assert [str(d) for (d,) in tuples(transactions(shop), "sales_date")] == ["2024-01-01", "2024-03-01"]
    shown = [row["data_venda"] for row in customer_transactions(shop, "1").collect()]
    assert shown == ["01/03/2024 20:30", "31/12/2023 22:30"]
    assert one(frequency.customer_frequency(shop))["max_dias_sem_recompra"] == 60


def test_mixed_time_kinds_are_refused(make_shop):
    naive, instants = make_shop(), make_shop(kind="timestamp")
    from dataclasses import replace

    with pytest.raises(TypeError):
        transactions(replace(naive, store_sales=instants.store_sales))


def test_drill_down_of_one_customer(two_channel_shop):
    rows = customer_transactions(two_channel_shop, "1d")
    assert tuples(rows, "canal", "total") == [("Loja", 2.0), ("iFood", 1.0)]
    assert headed_transactions(rows).columns == ["Canal", "Data Venda", "Total"]
    assert customer_transactions(two_channel_shop, "nobody").count() == 0


def plain_gaps(rows):
    """LAG over all sales of an id in the order date, channel, total (nulls first)."""
    def rank(value):
        return (value is not None, value)

    out, last = [], {}
    for i, day, channel, total in sorted(rows, key=lambda r: (r[0], rank(r[1]), r[2], rank(r[3]))):
        previous = last.get(i)
        out.append((i, day, channel, total, (day - previous).days if day and previous else None))
        last[i] = day
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_purchase_gaps_with_a_hot_customer_and_many_copies(make_shop, settings, monkeypatch, block):
    from clientela.plans import sales_history

    monkeypatch.setattr(sales_history, "COPIES_PER_BLOCK", block)
    settings(**FORCED_SKEW)
    hot = [("1", 5, "2024-01-01")] * 7 + [("1", None, "2024-01-01")] * 2 + [("1", 3, "2024-01-09"), ("1", 4, None)]
    shop = make_shop(
        [("1", "d", "A", "a"), BIA],
        [("d", None, "S", "s")],
        ifood_sales=hot + [("2", 1, "2024-01-03"), ("2", 1, "2024-01-05")],
        store_sales=[("d", 9, "2024-01-01"), ("d", 9, "2024-01-09"), ("d", 1, "2024-01-09")],
    )
    rows = tuples(transactions(shop).select("id", "sales_date", "channel", "total"))
    got = tuples(purchase_gaps(shop), "id", "sales_date", "channel", "total", "days_between")
    assert got == plain_gaps(rows)


def test_empty_shop(make_shop):
    shop = make_shop()
    assert frequency.customer_frequency(shop).count() == 0
    assert one(frequency.customer_count(shop)) == {"n": 0}
    assert purchase_gaps(shop).count() == 0
    assert customer_transactions(shop, "x").count() == 0
