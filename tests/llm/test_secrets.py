from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

from clientela.llm import queries, secrets

SF = "/root/testdata/sf0.01"


def reference_spans(text):
    """The fixed patterns, written out once more from their definition."""
    text = text or ""
    word = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
    found = [("assign", m) for m in re.finditer("(" + word + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def check(rows, result):
    by_id = dict(rows)
    assert sorted(r.doc_id for r in result) == sorted(own for own, _ in rows)
    for r in result:
        base = reference_spans(by_id[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in secrets.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        every = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(every) and [s[1] for s in every] == sorted(s[1] for s in every)


def test_query_keeps_all_base_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check([(r.doc_id, r.text) for r in docs], queries.op3_secret_scan(spark, SF).collect())


def test_edge_cases(make_docs):
    rows = [
        (1, None), (2, ""), (3, "API_KEY: 'abcd1234' é pa\u017f\u017fword=abcdefgh1"), (4, "a" * 50_000 + " token=short"), (5, "AKIA" * 9 + "0" * 32),
        (6, "password = \"x.y-z/9+=_\" secret:secret=12345678"), (7, "apikey=" * 2000), (8, "漢" * 30 + "deadbeef" * 5),
    ]
    found = secrets.find_secrets(make_docs(rows))
    check(rows, queries._span_digest(found, secrets.KINDS).collect())
    assert secrets.find_secrets(make_docs()).collect() == []


def drawn(rng, alphabet, n, prefix=""):
    return prefix + "".join(rng.choice(alphabet) for _ in range(n))


def test_formats_generalise():
    rng = random.Random(1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    labelled = {
        "access": [drawn(rng, capitals, 16, "AKIA") for _ in range(200)], "hex": [drawn(rng, "0123456789abcdef", 40) for _ in range(200)], "none": ["one"],
    }
    words = ["internationalisation", "wahrscheinlichkeit", "characteristically"] * 50
    formats = secrets.learn(labelled, words)
    assert set(formats.automata) == {"access", "hex"}
    assert len(formats.automata["hex"][0].ends) < 60  # merged: the prefix tree has thousands of states
    assert sum(formats.score(drawn(rng, capitals, 16, "AKIA"))[2] for _ in range(100)) > 85
    assert sum(formats.score(drawn(rng, "0123456789abcdef", 40))[2] for _ in range(100)) > 85
    plain = ["internationalisation2", "4111111111111111", "2024-05-06T10:11:12", "user_name_of_the_day_1", "aaaaaaaaaaaaaaaaaaaa1"]
    assert not any(formats.score(text)[2] for text in plain)


def test_inference_merges_a_loop():
    automaton = secrets.infer(["abcd" + "7" * n for n in range(1, 30) for _ in range(20)])
    assert len(automaton.ends) < 12 and automaton.log_probability(secrets.symbols("abcd777")) > automaton.log_probability(secrets.symbols("abcd7x7"))


def test_learned_spans_in_documents(make_docs):
    rng = random.Random(3)
    hexes = [drawn(rng, "0123456789abcdef", 40) for _ in range(60)]
    rows = [(k, f"token = {h} and internationalisation of words") for k, h in enumerate(hexes)]
    rows += [(100, "see " + drawn(rng, "0123456789abcdef", 30) + " here"), (101, "order 2024-11-12-0007-0001 of internationalisation2")]
    found = {r.doc_id: r.spans for r in secrets.find_secrets(make_docs(rows)).collect()}
    assert [(s.kind, s.start, s.end, s.base) for s in found[100]] == [("learned", 4, 34, False)]
    assert found[101] == [] and all(s.base for k in range(60) for s in found[k])


def test_background_counts_long_words_of_whole_texts(make_docs):
    long = "zebrazebra, quizzical " + "lorem " * 2000 + "jazzjazzjazz 12345678901234567890 jukeboxes"
    rows = [(1, long), (2, "quizzical quizzical short"), (3, None)]
    source = make_docs(rows).select("doc_id", "text")
    scanned = source.mapInArrow(secrets._scan, f"found {secrets._FOUND}, letters array<long>")
    want = Counter("quizzical" * 3 + "jazzjazzjazz" + "jukeboxes")
    assert +secrets._letters(scanned) == want


def test_credentials_are_learned_whole(make_docs):
    each = make_docs([(1, "a" * 300), (2, "a" * 300 + "b"), (3, "a" * 300)])
    assert secrets._bounded(each, "text", 600) == ["a" * 300, "a" * 300 + "b"]


def test_short_dotted_and_letter_only_formats_are_found(make_docs):
    rng = random.Random(8)
    consonants = "bcdfghjklmnpqrstvwxz"
    forms = {
        "short": lambda: drawn(rng, "0123456789", 3, "k") + drawn(rng, "XYZ", 4, "-"),
        "dotted": lambda: ".".join(drawn(rng, "0123456789ABCDEF", 4) for _ in range(4)),
        "letters": lambda: drawn(rng, consonants, 24),
    }
    plain = "the representative of international organisations, unfortunately www.example.com/understanding written 2024-11-12. "
    for name, form in forms.items():
        rows = [(k, f"secret={form()} and {plain}") for k in range(80)]
        rows += [(100 + k, f"see {form()}. {plain}") for k in range(20)]
        found = {r.doc_id: r.spans for r in secrets.find_secrets(make_docs(rows)).collect()}
        hits = [s for k in range(20) for s in found[100 + k] if s.kind == "learned"]
        assert sum(s.start == 4 for s in hits) >= 15, name
        assert sum(s.start != 4 for s in hits) == 0, name


def test_many_spans_take_linear_time():
    text = " ".join(f"token=abcdefgh{k} wordlike{k}x" for k in range(15_000))
    begin = time.perf_counter()
    base = secrets.base_spans(text)
    assert len(base) == 15_000 and len(list(secrets.candidates(text, base))) == 15_000
    assert time.perf_counter() - begin < 5
    assert list(secrets.candidates("a.b.c.d..e....... x" + "." * 100_000 + "y", [])) == [(0, 10), (18, 100_020)]
