import random

import duckdb
import pandas as pd
import pytest

from clientela.operators.identity import identity_links, resolve_identity, weighted_links
from clientela.plans.overlap import channel_overlap
from conftest import FORCED_SKEW, REGISTRIES, tuples

from oracle import _IDENTITY, _OVERLAP


def expected(registries, final):
    connection = duckdb.connect()
    for name, columns in REGISTRIES.items():
        frame = pd.DataFrame(list(registries[name]), columns=columns.split(), dtype="object")
        connection.register(f"{name}_frame", frame)
        casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns.split())
        connection.execute(f"CREATE VIEW {name} AS SELECT {casts} FROM {name}_frame")
    return sorted(connection.sql(f"WITH {_IDENTITY} {final}").fetchall(), key=repr)


def random_registries(seed, hot=0.0):
    rng = random.Random(seed)

    def pick(values):
        if rng.random() < hot:
            return "hot"
        return rng.choice(values)

    documents, phones = [None, "", *map(str, range(6))], [None, "", *"abcdef"]
    names = [None, "Ana", "Bia"]
    return {
        "ifood_customer": [(pick([None, "1", "2", "12"]), pick(documents), rng.choice(names), "x") for _ in range(25)],
        "store_customer": [(pick(documents), pick(phones), rng.choice(names), None) for _ in range(25)],
        "food99_customer": [(pick([None, "3", "23"]), pick(phones), rng.choice(names), "z") for _ in range(25)],
    }


def shop_of(make_shop, registries):
    return make_shop(registries["ifood_customer"], registries["store_customer"], registries["food99_customer"])


@pytest.mark.parametrize("seed,hot", [(1, 0.0), (2, 0.0), (3, 0.35), (4, 0.35)])
def test_equals_full_outer_joins(make_shop, settings, seed, hot):
    if seed % 2 == 0:
        settings(**FORCED_SKEW)
    registries = random_registries(seed, hot)
    shop = shop_of(make_shop, registries)
    assert tuples(shop.identity) == expected(registries, "SELECT * FROM identity")
    assert tuples(channel_overlap(shop)) == expected(registries, _OVERLAP)


def test_ids_can_collide_unless_separated(spark, make_shop):
    shop = make_shop([("1", "23", "A", "a"), ("12", "3", "B", "b")], [("23", None, "S", "s"), ("3", None, "T", "t")])
    assert [row["id"] for row in shop.identity.collect()] == ["123", "123"]
    separated = resolve_identity(shop.ifood_customer, shop.store_customer, shop.food99_customer, id_sep="|")
    assert {row["id"] for row in separated.collect()} == {"1||23", "12||3"}


def test_all_keys_missing_gives_an_empty_id(make_shop):
    row = make_shop(food99=[(None, None, "N", "n")]).identity.first()
    assert row["id"] == "" and row["first_name"] == "N" and row["customer_id"] is None


def test_rows_without_a_key_never_match_each_other(make_shop):
    same = ("u", None, "Ana", "x")
    shop = make_shop(store=[("u", None, "Ana", "x")], food99=[same])
    assert sorted(row["id"] for row in shop.identity.collect()) == ["u", "u"]


def test_name_phone_and_document_precedence(make_shop):
    shop = make_shop(
        [("7", "d", "App", None)], [("d", "p", "Store", "Lastname")], [("u", "p", None, None)]
    )
    row = shop.identity.first()
    assert (row["id"], row["first_name"], row["last_name"]) == ("7ud", "App", "Lastname")
    assert (row["document_number"], row["phone_number"], row["customer_id"]) == ("d", "p", "7")


def test_repeated_links_fold_into_copies(make_shop):
    shop = make_shop(ifood=[("1", None, "A", "a"), ("1", None, "A", "a"), ("2", None, "B", "b")])
    links = weighted_links(identity_links(shop.identity))
    assert tuples(links, "native_key", "copies") == [("1", 2), ("2", 1)]


def test_app_and_food99_pairs_are_always_triples(make_shop):
    registries = random_registries(9)
    row = channel_overlap(shop_of(make_shop, registries)).first()
    assert row["clientes_ifood_99food"] == row["clientes_loja_ifood_99food"]


def test_overlap_of_nothing_is_zero(make_shop):
    assert tuple(channel_overlap(make_shop()).first()) == (0,) * 8
