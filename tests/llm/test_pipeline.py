from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from clientela.llm import pii, queries

from llm.test_jaccard_join import brute_force
from llm.test_tokens import check_pieces

SF = "/root/testdata/sf0.001"


def masked(text):
    """Base spans masked by definition; the field's own spans come from the operator, and are checked in its tests."""
    import pyarrow as pa

    base = {("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)}
    base |= {("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15}
    spans = {(k, a, b) for k, a, b, _ in next(pii._find(pa.array([text]), pii.default_field()))}
    assert base <= spans
    out, end = "", 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b in spans):
        if a >= end:
            out += text[end:a] + "[" + kind.upper() + "]"
        end = max(end, b)
    return out + text[end:]


def by_hand(rows):
    """Documents that reach packing, by plain Python."""
    rows = [(own, text) for own, text in rows if text and re.search(r"[^\W\d_]", text)]
    component = {own: root for own, _, root, _ in brute_force(rows)}
    return sorted((own, masked(text)) for own, text in rows if component[own] == own)


def test_run_equals_plain_python(spark, corpus):
    from pyspark.sql import functions as F

    pieces = corpus_pipeline.run(spark, SF).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(by_hand([(own, text) for own, text, _ in corpus]), pieces)


def test_stages_keep_columns_and_take_effect(spark, make_docs):
    near = " ".join(f"w{k}" for k in range(40))
    rows = [
        (1, near, "en"), (2, near + " tail", "en"), (3, None, "en"), (4, "123 456", "en"), (5, "the mail a@b.co is here", "en"), (6, "", None),
        (7, "le chat est sur la table", "fr"), (7, "le chat est sur la table", "fr"), (None, "une autre phrase ici", "fr"),
    ]
    docs = make_docs(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out
    kept = sorted((r.doc_id or 0, r.text, r.n_chars) for r in docs.collect())
    assert kept == [(0, "une autre phrase ici", 20), (1, near, len(near)), (5, "the mail [EMAIL] is here", 24), (7, "le chat est sur la table", 24)]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == {None, 1, 5, 7}


def test_an_id_with_several_texts_loses_only_copies(spark, make_docs):
    near, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(3, near), (5, near), (5, "clean text of its own"), (6, other), (6, other + " tail"), (7, "once"), (7, "once"), (None, near), (None, near), (None, None), (8, None)]
    kept = corpus_pipeline.keep_one_of_each_group(spark, make_docs(rows), SF).select("doc_id", "text").collect()
    by_id = {}
    for r in kept:
        by_id.setdefault(r.doc_id, []).append(r.text)
    assert by_id.pop(6) in ([other], [other + " tail"])
    assert sorted(by_id.pop(None), key=str) == [None, near, near]
    assert by_id == {3: [near], 5: ["clean text of its own"], 7: ["once"], 8: [None]}


def test_stages_take_an_empty_table(spark, make_docs):
    docs = make_docs()
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(queries.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("module", ["clientela.plans.frequency", "clientela.session", "oracle", "sampledata"])
def test_the_library_does_not_import_this_subpackage(module):
    import subprocess
    import sys

    code = f"import sys, {module}; assert not any(m.startswith('clientela.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)
