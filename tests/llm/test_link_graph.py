from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from clientela.llm import link_graph, queries
from clientela.session import folder_exists

SF = "/root/testdata/sf0.01"
LINK = re.compile(r"""(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)""", re.IGNORECASE)
FOLD = {i: i + 32 for i in range(65, 91)}


def brute_force(pages):
    """{page: (host, path, rule, verdict)} with dictionaries and loops."""
    judged, edges = [], Counter()
    hosts = set()
    for own, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(FOLD)
        fits = []
        for verdict, rule in link_graph.RULES:
            name, _, start = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
                fits.append((len(rule), rule, verdict))
        judged.append((own, host, path, *(max(fits)[1:] if fits else (None, None))))
        if host:
            hosts.add(host)
            for target in {t for t in LINK.findall(html or "")}:
                target = target.translate(FOLD)
                if target != host:
                    edges[host, target] += 1
                    hosts.add(target)
    domain = set()
    for host in hosts:
        labels = host.split(".")
        for k in range(len(labels) - 2):
            domain |= {(".".join(labels[k:]), ".".join(labels[k + 1 :])), (".".join(labels[k + 1 :]), ".".join(labels[k:]))}
    for pair in domain:
        edges[pair] += 1
    total = Counter(j[1] for j in judged if j[1])
    shares = {}
    for kind, ruling, turned in (("trust", "allow", False), ("distrust", "block", True)):
        count = Counter(j[1] for j in judged if j[4] == ruling and j[1])
        count = {h: n for h, n in count.items() if 2 * n >= total[h]}
        start = {h: n / sum(count.values()) for h, n in count.items()}
        out = defaultdict(list)
        for (a, b), w in edges.items():
            out[b if turned else a].append((a if turned else b, w))
        now = dict(start)
        for _ in range(1000 if start else 0):
            moved = defaultdict(float)
            for host, mass in now.items():
                for target, w in out[host]:
                    moved[target] += link_graph.FOLLOW * mass * w / sum(x for _, x in out[host])
            back = 1 - sum(moved.values())
            for host, share in start.items():
                moved[host] += back * share
            change = sum(abs(moved.get(h, 0) - now.get(h, 0)) for h in {*moved, *now})
            reached = any(mass and not now.get(h) for h, mass in moved.items())
            now = moved
            if change <= link_graph.TOLERANCE and not reached:
                break
        shares[kind] = now
    result = {}
    for own, host, path, rule, verdict in judged:
        bad = shares["distrust"].get(host, 0) > shares["trust"].get(host, 0) * (1 + 1e-9)
        result.setdefault(own, []).append((host, path, rule, verdict or ("block" if bad else "allow")))
    return {own: sorted(rows, key=repr) for own, rows in result.items()}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    return {own: sorted(rows, key=repr) for own, rows in out.items()}


def test_query_equals_brute_force(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert found(queries.op2_url_filter(spark, SF)) == brute_force(pages)


@pytest.fixture
def make_pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1.0) for r in rows], "page_id long, url string, html string, host string, trust double")


def test_propagation_and_edge_cases(make_pages):
    def page(own, url, *links):
        return own, url, "".join(f"<a HREF='http://{t}/x'>" for t in links)

    pages = [
        page(1, "http://good.com/", "friend.org", "Friend.ORG"), page(2, "http://friend.org/a", "far.org"), page(3, "http://far.org/"),
        page(4, "https://bad.net/es/1"), page(5, "http://feeder.org/x?y", "bad.net"), page(6, "http://bad.net/de/"),
        (7, None, None), (8, "no scheme", "<a href=//good.com/>"), (9, "x://", None), (10, "HTTP://A.B.EXAMPLE.COM/EN/", ""),
        (11, "http://www.example.com/en/z#f", ""), (12, "http://example.com/en/", ""), (13, "http://notexample.com", ""), (14, "http://com/?q", ""),
        (15, "ftp://u://v/w", ""), (16, "http://É.net/fr/", None), (3, "http://far.org/", ""), (None, "http://other.org/", ""),
        (17, "http://lonely.org/" + "x" * 100_000, "src=" * 10_000),
    ]
    result = found(link_graph.judge_pages(make_pages(pages)))
    assert result == brute_force(pages)
    verdicts = {own: rows[0][3] for own, rows in result.items()}
    assert [verdicts[k] for k in (2, 3, 4, 5, 6, 7, 8)] == ["allow", "allow", "block", "block", "block", "allow", "allow"]
    assert result[10][0][:3] == ("a.b.example.com", "/EN/", "com/") and result[11][0][2] == "www.example.com/en/" and result[13][0][2] is None


def test_a_long_chain_is_blocked_to_its_end(make_pages):
    # host k links to host k + 1, the last one to a blocked host: the exact distrust of all is above their trust of none
    pages = [(k, f"http://h{k}.org/", f"<a href='http://h{k + 1}.org/'>") for k in range(40)] + [(40, "http://h40.org/", "<a href='//x.net/'>"), (41, "http://x.net/es/", "")]
    assert {own: rows[0][3] for own, rows in found(link_graph.judge_pages(make_pages(pages))).items()} == dict.fromkeys(range(42), "block")


def test_empty_table(make_pages):
    assert link_graph.judge_pages(make_pages([])).collect() == []


def test_rounds_keep_few_files_however_shuffles_are_dealt(make_pages, settings, spark, monkeypatch):
    """Only the last round's ranks stay, and each round is written in files by its rows, not by the number of shuffle partitions."""
    settings(shuffle__partitions="23", adaptive__coalescePartitions__enabled="false")
    pages = [(k, f"http://h{k}.org/", f"<a href='http://h{k + 1}.org/'>") for k in range(12)] + [(12, "http://h12.org/", "<a href='//x.net/'>"), (13, "http://x.net/es/", ""), (14, "http://a.com/", "")]
    written = []
    monkeypatch.setattr(link_graph, "stored_at", lambda df, label, f=link_graph.stored_at: written.append(f(df, label)) or written[-1])
    judged = link_graph.judge_pages(make_pages(pages))
    left = [path for _, path in written if folder_exists(spark, path)]
    assert len(written) > 20 and left == [written[-1][1]]
    assert len(written[-1][0].inputFiles()) == 1
    assert found(judged) == brute_force(pages)
    monkeypatch.setattr(link_graph, "ROWS_PER_FILE", 4)
    assert found(link_graph.judge_pages(make_pages(pages))) == brute_force(pages) and len(written[-1][0].inputFiles()) > 1
