import datetime as dt
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from clientela import labels, schemas
from clientela.functions.text import clean_phone, first_word, percent_encode
from clientela.plans import campaign, contacts, freshness
from clientela.sources import jdbc, shop as shop_source
from clientela.streaming import contact_stream
from conftest import UTC, local_frame, tuples

LOG = (
    "timestamp timestamp, customer_id string, customer_name string, phone string, segment string, "
    "message_type string, message_body string"
)


def at(day, hour=12, minute=0):
    return dt.datetime(2024, 1, day, hour, minute, tzinfo=UTC)


def entry(moment, customer, kind="Feedback"):
    return (moment, customer, f"N{customer}", "11", "A", kind, "texto")


@pytest.mark.parametrize(
    "phone,cleaned",
    [
        ("(11) 98888-7777", "5511988887777"), ("5511988887777", "5511988887777"), ("11988887777.0", "5511988887777"),
        ("11.0988", "11988"), ("", ""), (None, None), ("123", "123"),
    ],
)
def test_clean_phone(spark, phone, cleaned):
    assert local_frame(spark, [(phone,)], "p string").select(clean_phone(F.col("p"))).first()[0] == cleaned


@pytest.mark.parametrize("name,word", [("Ana Lima", "Ana"), ("  Ana", "Ana"), (" ", ""), ("", ""), ("João Sá", "João")])
def test_first_word(spark, name, word):
    assert local_frame(spark, [(name,)], "n string").select(first_word(F.col("n"))).first()[0] == word


@pytest.mark.parametrize("text", ["Olá / x~*+_-. 💜!", "", "a&b=c?d#e%f", "\"<>'()[]{}|\\^`:;,@$\n"])
def test_percent_encoding_equals_quote(spark, text):
    got = local_frame(spark, [(text,)], "t string").select(percent_encode(F.col("t"))).first()[0]
    assert got == quote(text.encode("utf-8"))


SEGMENTS = (
    "id string, name string, phone_number string, frequency bigint, first_purchase date, last_purchase date, "
    "recency bigint, sales_channel string, segmento string"
)


@pytest.fixture
def audience_parts(spark):
    day = dt.date(2024, 1, 2)
    loyal, lost = labels.SEGMENT_LABELS[1], labels.SEGMENT_LABELS[3]
    people = [
        ("1", "Júlia Reis", "(11) 98888-7777", 3, day, day, 12, "Loja", loyal),
        ("2", "julio", "12345", 1, day, day, 2, "iFood", loyal),
        ("3", None, "11977776666", 1, day, day, 5, "iFood", lost),
    ]
    log = local_frame(spark, [entry(at(1), "1"), entry(at(3, 9, 5), "1"), entry(at(2), "8")], LOG)
    return local_frame(spark, people, SEGMENTS), contacts.last_contact(log)


@pytest.mark.parametrize(
    "filters,ids",
    [
        ({}, ["1", "3"]), ({"phone_only": False}, ["1", "2", "3"]), ({"name": "JÚL|jul", "phone_only": False}, ["1", "2"]),
        ({"name": "^jul", "phone_only": False}, ["2"]), ({"segment": labels.SEGMENT_LABELS[3]}, ["3"]),
        ({"segment": labels.ALL_SEGMENTS, "name": ""}, ["1", "3"]),
    ],
)
def test_audience_filters(audience_parts, filters, ids):
    assert [i for (i,) in tuples(campaign.campaign_audience(*audience_parts, **filters), "id")] == ids


def test_queue_texts(audience_parts):
    queue = campaign.campaign_queue(campaign.campaign_audience(*audience_parts))
    rows = {r["id"]: r for r in queue.collect()}
    assert rows["1"]["ultimo_contato"] == "03/01/2024 09:05" and rows["3"]["ultimo_contato"] == "Nunca"
    assert rows["1"]["first_purchase"] == "02/01/2024"
    assert campaign.headed_queue(queue).columns == list(labels.QUEUE_HEADERS.values())[:1] + [
        "Telefone", "Canais", "Tipo", "Qtd Compras", "Data 1ª Compra", "Data Ult. Compra", "Último Contato",
    ]


@pytest.mark.parametrize("purpose", list(labels.MESSAGES))
def test_messages_and_links(audience_parts, purpose):
    messages = campaign.campaign_messages(campaign.campaign_audience(*audience_parts), purpose, "Loja do Zé")
    row = messages.where("id = '1'").first()
    text = labels.MESSAGES[purpose].format(name="Júlia", segment=labels.SEGMENT_LABELS[1], recency=12, shop="Loja do Zé")
    assert row["message_body"] == text and row["message_type"] == purpose
    assert row["wa_link"] == f"https://wa.me/5511988887777?text={quote(text.encode())}"


def test_unknown_purpose(audience_parts):
    with pytest.raises(KeyError):
        campaign.campaign_messages(campaign.campaign_audience(*audience_parts), "Cobrança", "x")


def test_sent_messages_go_to_the_log(spark, audience_parts, tmp_path):
    messages = campaign.campaign_messages(campaign.campaign_audience(*audience_parts), "Feedback", "x")
    path = str(tmp_path / "log")
    contacts.append_contacts(campaign.message_log(messages), path)
    log = contacts.read_contact_log(spark, path)
    assert log.columns == [f.name for f in schemas.CONTACT_LOG.fields]
    assert tuples(log, "customer_id", "phone") == [("1", "5511988887777"), ("3", "5511977776666")]
    assert log.where("timestamp > current_timestamp() - INTERVAL 1 HOUR").count() == 2


def test_appends_add_up_and_need_a_time(spark, tmp_path):
    path = str(tmp_path / "log")
    first, second = [entry(at(1), "1")], [entry(at(2), "2"), entry(at(3), "1")]
    for batch in (first, second):
        contacts.append_contacts(local_frame(spark, batch, LOG), path)
    log = contacts.read_contact_log(spark, path)
    assert tuples(contacts.last_contact(log), "customer_id") == [("1",), ("2",)]
    assert log.count() == 3
    with pytest.raises(Exception, match="needs a timestamp"):
        contacts.append_contacts(local_frame(spark, [entry(None, "1")], LOG), path)


def test_ids_and_phones_become_text(spark):
    batch = local_frame(spark, [(at(1), 7, 11988887777)], "timestamp timestamp, customer_id bigint, phone bigint")
    row = contacts.contact_rows(batch).first()
    assert (row["customer_id"], row["phone"], row["segment"]) == ("7", "11988887777", None)


def test_log_table_is_created_once(spark):
    table = contacts.ensure_contact_log(spark, "contact_log_test")
    try:
        assert [f.dataType for f in table.schema.fields] == [f.dataType for f in schemas.CONTACT_LOG.fields]
        assert contacts.ensure_contact_log(spark, "contact_log_test").count() == 0
    finally:
        spark.sql("DROP TABLE contact_log_test")


def test_history_and_latest(spark, settings):
    settings(session__timeZone="Asia/Tokyo")
    log = local_frame(spark, [entry(at(d, 23, 30), str(d % 2), f"T{d}") for d in range(1, 8)], LOG)
    history = contacts.contact_history(log, "1")
    assert [(r["timestamp"], r["message_type"]) for r in history.collect()][0] == ("07/01/2024 23:30", "T7")
    assert history.count() == 4
    assert contacts.headed_history(history).columns == ["Data/Hora", "Tipo", "Mensagem"]
    assert [r["message_type"] for r in contacts.latest_events(log, 3).collect()] == ["T7", "T6", "T5"]
    assert contacts.latest_events(log.limit(0)).count() == 0


def test_process_runs(spark):
    runs = local_frame(spark, [(at(5, 1, 2), "a", "A"), (at(6), "b", "B")], "last_run_date timestamp, process_key string, name string")
    assert tuples(freshness.process_last_run(runs, ["a", "zz"]), "name") == [("A",)]
    none = freshness.process_last_run(runs, [])
    assert none.count() == 0 and none.columns == ["last_run_date", "process_key", "name"]
    assert tuples(freshness.run_text(runs)) == [("A", "05/01/2024 01:02:00"), ("B", "06/01/2024 12:00:00")]


def test_jdbc_options():
    options = jdbc.postgres_options("db", 5432, "shop", "u", "p")
    assert options["url"] == "jdbc:postgresql://db:5432/shop" and options["driver"] == "org.postgresql.Driver"


def test_parquet_shop_reads_with_the_declared_schemas(spark, tmp_path):
    for name, schema in schemas.TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    shop = shop_source.parquet_shop(spark, str(tmp_path))
    assert shop.app_orders.schema["created_at"].dataType.simpleString() == "timestamp"
    assert shop.identity.count() == 0


def write_json(spark, folder, rows):
    local_frame(spark, rows, LOG).write.mode("append").json(folder)


def test_stream_equals_batch_with_late_and_repeated_events(spark, tmp_path):
    inbox, log_path, last_path = (str(tmp_path / n) for n in ("inbox", "log", "last"))
    batches = [[entry(at(5), "1"), entry(at(6), "2")], [entry(at(2), "1"), entry(at(6), "2")], [entry(at(7), "3")]]
    for batch in batches:
        write_json(spark, inbox, batch)
        events = contact_stream.contact_events(spark, inbox)
        contact_stream.ingest_contacts(events, log_path, str(tmp_path / "c1")).awaitTermination()
        contact_stream.track_last_contact(events, last_path, str(tmp_path / "c2")).awaitTermination()
    log = contacts.read_contact_log(spark, log_path)
    every = [row for batch in batches for row in batch]
    assert log.count() == len(every)
    assert tuples(log) == tuples(contacts.contact_rows(local_frame(spark, every, LOG)))
    assert tuples(contact_stream.current_last_contact(spark, last_path)) == tuples(contacts.last_contact(log))


@pytest.mark.parametrize("pattern", ["joão", "ZÉLIA", "ç", "^Á", "a b", "ß", "Ö$", "."])
def test_name_search_equals_pandas(spark, pattern):
    import pandas as pd

    names = ["JOÃO Ávila", "joão", "Zélia", "Conceição", "ávila", "A B", "strasse", "löwÖ", "", None]
    people = [(str(k), n, "12345678", 1, dt.date(2024, 1, 2), dt.date(2024, 1, 2), 1, "Loja", labels.SEGMENT_LABELS[0]) for k, n in enumerate(names)]
    nobody = contacts.last_contact(local_frame(spark, [], LOG))
    found = campaign.campaign_audience(local_frame(spark, people, SEGMENTS), nobody, name=pattern)
    hits = pd.Series(names, dtype=object).str.contains(pattern, case=False, na=False)
    assert [i for (i,) in tuples(found, "id")] == sorted(str(k) for k, hit in enumerate(hits) if hit)


def run_streams(spark, inbox, tmp_path, name):
    events = contact_stream.contact_events(spark, inbox)
    contact_stream.ingest_contacts(events, str(tmp_path / "log"), str(tmp_path / f"{name}-log")).awaitTermination()
    contact_stream.track_last_contact(events, str(tmp_path / "last"), str(tmp_path / f"{name}-last")).awaitTermination()


def test_batches_and_streams_share_one_log(spark, tmp_path):
    path = str(tmp_path / "log")
    counts = []
    contacts.append_contacts(local_frame(spark, [entry(at(1), "1")], LOG), path)
    counts.append(contacts.read_contact_log(spark, path).count())
    write_json(spark, str(tmp_path / "inbox"), [entry(at(2), "2")])
    run_streams(spark, str(tmp_path / "inbox"), tmp_path, "a")
    counts.append(contacts.read_contact_log(spark, path).count())
    for _ in range(2):  # a batch that is retried under its name is not doubled
        contacts.append_contacts(local_frame(spark, [entry(at(3), "3")], LOG), path, batch="march")
    run_streams(spark, str(tmp_path / "inbox"), tmp_path, "a")  # a restart finds nothing new
    counts.append(contacts.read_contact_log(spark, path).count())
    assert counts == [1, 2, 3]


def test_two_sources_keep_all_customers_and_compaction_changes_nothing(spark, tmp_path):
    for name, customer in (("a", "1"), ("b", "2")):
        write_json(spark, str(tmp_path / name), [entry(at(4), customer)])
        run_streams(spark, str(tmp_path / name), tmp_path, name)
    last = str(tmp_path / "last")
    before = tuples(contact_stream.current_last_contact(spark, last))
    assert [row[0] for row in before] == ["1", "2"]
    for name in ("first", "second"):
        contact_stream.compact_last_contact(spark, last, name)
        assert tuples(contact_stream.current_last_contact(spark, last)) == before
    parts = [p for p in (tmp_path / "last").glob("source=*/part=*")]
    assert [p.name for p in parts] == ["part=second"]
    write_json(spark, str(tmp_path / "a"), [entry(at(9), "1")])
    run_streams(spark, str(tmp_path / "a"), tmp_path, "a")
    assert dict(tuples(contact_stream.current_last_contact(spark, last)))["1"] == at(9).replace(tzinfo=None)


def test_bad_records_are_set_aside(spark, tmp_path):
    inbox = tmp_path / "inbox"
    write_json(spark, str(inbox), [entry(at(5), "1")])
    (inbox / "bad.json").write_text('{"timestamp": "2024-01-02T00:00:00Z", "customer_id": "7"}\nnot json at all\n{"customer_id": "8"}\n')
    run_streams(spark, str(inbox), tmp_path, "a")
    assert sorted(i for (i,) in tuples(contacts.read_contact_log(spark, str(tmp_path / "log")), "customer_id")) == ["1", "7"]
    rejected = contacts.read_parts(spark, str(tmp_path / "log-rejected"), schemas.CONTACT_LOG)
    assert rejected.count() == 2
    assert [i for i, _ in tuples(contact_stream.current_last_contact(spark, str(tmp_path / "last")))] == ["1", "7"]


def test_append_to_the_log_table(spark):
    spark.sql("DROP TABLE IF EXISTS appended_contacts")
    try:
        for day in (1, 2):
            contacts.append_to_table(local_frame(spark, [entry(at(day), str(day))], LOG), "appended_contacts")
        assert tuples(spark.table("appended_contacts"), "customer_id") == [("1",), ("2",)]
    finally:
        spark.sql("DROP TABLE IF EXISTS appended_contacts")
