from __future__ import annotations

import zlib

import pytest

from clientela.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op4_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


SPOKEN = {
    "en": "the house and the garden are with that which was there",
    "de": "das haus und der garten sind mit dem was dort nicht ist",
    "fr": "la maison et le jardin sont avec ce que nous avons",
    "es": "la casa y el jardín están con lo que nosotros tenemos",
    "xx": "qzx wqk zzq xkq qqz wxz kzx",
}


@pytest.fixture
def model(make_docs):
    rows = [(k, f"{text} {k} {text[::2]}", lang) for k, (lang, text) in enumerate(SPOKEN.items())] * 6
    return language.train(make_docs([(None, None, "en"), (None, "unlabelled", None), *rows]))


def test_families_and_prediction(model, make_docs):
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    rows = [(k, text) for k, text in enumerate(SPOKEN.values())]
    assert {r.doc_id: r.lang_pred for r in language.predict(make_docs(rows), model).collect()} == dict(enumerate(SPOKEN))


def test_edge_cases(model, make_docs):
    rows = [(1, None), (2, ""), (3, "12 + 4 = 16 !"), (4, "x"), (None, "the house"), (5, "the " * 40_000), (5, "the house"), (6, "漢")]
    found = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in language.predict(make_docs(rows), model).collect())
    assert [r for r in found if r[0] in (1, 2, 3)] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert all(r[1] in SPOKEN for r in found if r[0] not in (1, 2, 3)) and len(found) == 8
    kept = language.keep_determined(make_docs(rows), model)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 5, 6] and kept.columns == make_docs().columns


def test_empty_tables_and_one_language(make_docs):
    assert language.train(make_docs()) is None
    assert [(r.lang_pred, r.score) for r in language.predict(make_docs([(1, "words")]), None).collect()] == [("und", 0.0)]
    one = language.train(make_docs([(1, "some words", "en"), (2, "other words", "en")]))
    assert [r.lang_pred for r in language.predict(make_docs([(1, "qué tal")]), one).collect()] == ["en"]
    assert language.predict(make_docs(), one).collect() == []


def test_a_label_of_copies_is_still_predicted(make_docs):
    latin = ["gallia est omnis divisa in partes tres quarum unam incolunt", "arma virumque cano troiae qui primus ab oris"]
    rows = [(k, f"the house number {k} stands by the river of the town {k * 7}", "en") for k in range(3000)]
    rows += [(5000 + k, latin[k % 2], "la") for k in range(3000)]
    model = language.train(make_docs(rows), rows=200)
    found = {r.doc_id: r.lang_pred for r in language.predict(make_docs([(1, latin[0]), (2, "the town by the river"), (3, None)]), model).collect()}
    assert found == {1: "la", 2: "en", 3: "und"}


def test_missing_languages_are_filled(make_docs):
    rows = [(k, f"the house number {k} stands by the river", "en") for k in range(60)] + [(100 + k, f"la maison numero {k} est dans la ville", "fr") for k in range(60)]
    rows += [(500, "la ville est la maison", None), (501, "the house by the river", None), (502, "12", None)]
    docs = make_docs(rows)
    kept = {r.doc_id: r.lang for r in language.keep_determined(docs, language.train(docs), fill_column="lang").where("doc_id >= 500").collect()}
    assert kept == {500: "fr", 501: "en"}
