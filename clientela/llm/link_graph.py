"""URL filter by rules and by propagation over the graph of hosts.

Trusted hosts are those whose pages the rules mostly allow, blocked hosts those whose pages they mostly
block. Personalised PageRank spreads trust from trusted seeds along links; distrust spreads from
blocked seeds against them. A host's pages that no rule judges are blocked if its distrust outweighs
its trust.

Edges run from a page's host to the hosts its links name, and both ways between a host and the domain
above it, so that hosts of one domain share some of their standing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.llm.tables import stored, stored_at
from clientela.operators.joins import join_unique
from clientela.session import delete_folder

#: The rules, as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
KINDS = ("trust", "distrust")
FOLLOW = 0.85
#: Rounds end when the masses of a kind change by no more than this in all, and no further host is reached.
TOLERANCE = 1e-3
THRESHOLD = 1.0
#: The tables that every round reads or writes have about so many rows in a file: rounds are many, and a file or task for a few rows costs more than they do.
ROWS_PER_FILE = 200_000
#: Shares that differ by less than this part of themselves are equal: sums of doubles depend on their order.
_ROUNDING = 1e-9
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")


def with_host_and_path(pages: DataFrame) -> DataFrame:
    rest = _after_scheme(F.col("url"))
    return pages.withColumns(
        {
            "host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER),
            "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        }
    )


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)


def with_rule(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """The longest rule that fits a page's host or a domain above it, and its path; null if none does."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for ruling, text in reversed(longest_first):
        rule = F.when(_fits(text), F.lit(text)).otherwise(rule)
        verdict = F.when(_fits(text), F.lit(ruling)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "ruling": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, weight): links between different hosts, and each host with the domains above it."""
    links = pages.where("host <> ''").select(
        F.col("host").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), 1))).alias("target")
    )
    links = links.select("source", F.translate("target", _UPPER, _LOWER).alias("target")).where("source <> target")
    links = links.groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))
    links = stored(links, "named")
    hosts = pages.where("host <> ''").select("host").distinct().unionByName(links.select(F.col("target").alias("host"))).distinct()
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(0), F.size(labels) - 2), lambda k: F.array_join(F.slice(labels, k + 1, 255), "."))
    above = hosts.where(F.size(labels) >= 3).select(chain.alias("chain"))
    above = above.select(F.explode(F.arrays_zip(F.expr("slice(chain, 1, size(chain) - 1)").alias("low"), F.expr("slice(chain, 2, size(chain) - 1)").alias("high"))).alias("e"))
    above = above.select(F.col("e.low").alias("source"), F.col("e.high").alias("target")).distinct()
    both = above.unionByName(above.select(F.col("target").alias("source"), F.col("source").alias("target")))
    every = links.unionByName(both.withColumn("weight", F.lit(1.0)))
    return stored(every.groupBy("source", "target").agg(F.sum("weight").alias("weight")), "links")


def seeds(judged: DataFrame) -> DataFrame:
    """(kind, host, mass): trusted and blocked hosts, each kind's mass adding up to one, shared by number of pages."""
    counts = judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("ruling") == "allow").alias("allow"), F.count_if(F.col("ruling") == "block").alias("block")
    )
    kinds = [counts.where(f"2 * {name} >= pages").select(F.lit(kind).alias("kind"), "host", F.col(name).cast("double").alias("n")) for kind, name in (("trust", "allow"), ("distrust", "block"))]
    both = reduce(DataFrame.unionByName, kinds)
    totals = both.groupBy("kind").agg(F.sum("n").alias("total"))
    return both.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("mass"))  # two rows


def propagate(edges: DataFrame, start: DataFrame, follow: float = FOLLOW, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, mass); trust follows edges, distrust runs against them.

    In each round a host passes on the share ``follow`` of its mass, by weight, and each seed gets the rest of
    the total by its share of the seeds. Mass of hosts without an edge to follow goes back to the seeds too.
    Rounds go on until each kind's total change is at most ``tolerance`` and no host got its first mass, so
    every host that a seed reaches has some. The change shrinks by ``follow`` at least in every round.
    """
    directed = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "weight")
    )
    out = stored(directed.groupBy("kind", "host").agg(F.sum("weight").alias("total")), "totals")
    hosts = out.select("kind", "host", F.lit(True).alias("leads"))
    share = join_unique(directed, out, ["kind", "host"]).select("kind", "host", "to", (F.lit(follow) * F.col("weight") / F.col("total")).alias("share"))
    share = join_unique(share, hosts.withColumnRenamed("host", "to"), ["kind", "to"], "left").select("kind", "host", "to", "share", F.coalesce("leads", F.lit(False)).alias("leads"))
    share = stored(share.coalesce(_files(2 * edges.count())), "edges")
    start = stored(join_unique(start, hosts, ["kind", "host"], "left").select("kind", "host", "mass", F.coalesce("leads", F.lit(False)).alias("leads")), "seeds")
    start = stored(start.coalesce(_files(start.count())), "seeds")
    # a host of either kind leads somewhere in one of the two directions, or is a seed
    files = _files(2 * (out.count() + start.count()))
    now, last, old_path = start, _sums(start.withColumn("old", F.lit(0.0))), None
    while True:
        passed = reduce(lambda rest, kind: F.when(F.col("kind") == kind, F.lit(follow * last[f"leading_{kind}"])).otherwise(rest), KINDS, F.lit(0.0))
        moved = now.join(share.withColumnRenamed("leads", "goes_on"), ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("mass") * F.col("share")).alias("mass"), F.col("goes_on").alias("leads"))
        given = start.select("kind", "host", (F.col("mass") * (1 - passed)).alias("mass"), "leads")
        parts = [part.withColumn("old", F.lit(0.0)) for part in (moved, given)] + [now.select("kind", "host", F.lit(0.0).alias("mass"), "leads", F.col("mass").alias("old"))]
        united = reduce(DataFrame.unionByName, parts).groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.bool_or("leads").alias("leads"), F.sum("old").alias("old"))
        # each round is read three times, so its plan must end here
        now, path = stored_at(united.coalesce(files), "ranks")
        last = _sums(now)
        if old_path:
            delete_folder(now.sparkSession, old_path)  # no plan reads it any more
        old_path = path
        if all(last[f"change_{kind}"] <= tolerance and not last[f"reached_{kind}"] for kind in KINDS):
            return now.select("kind", "host", "mass")


def _files(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_FILE))


def _sums(ranks: DataFrame) -> dict[str, float]:
    """Of each kind: its change, how many hosts got their first mass, and the mass of hosts that lead somewhere."""
    sums = []
    for kind in KINDS:
        own = F.col("kind") == kind
        sums += [
            F.coalesce(F.sum(F.when(own, F.abs(F.col("mass") - F.col("old")))), F.lit(0.0)).alias(f"change_{kind}"),
            F.count_if(own & (F.col("mass") > 0) & (F.col("old") == 0)).alias(f"reached_{kind}"),
            F.coalesce(F.sum(F.when(own & F.col("leads"), F.col("mass"))), F.lit(0.0)).alias(f"leading_{kind}"),
        ]
    return ranks.agg(*sums).first().asDict()


def judge_pages(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A url that is null or has no ``://`` has an empty host and path, fits no rule, and is allowed. Null
    html has no links. Repeated pages are judged alike and count each. Empty table: no rows. Other columns
    are not read; ``trust`` and ``distrust`` are the host's shares, shown rounded to 12 places and compared as
    they are. Equal shares allow. A host whose pages are half allowed, half blocked is a seed of both kinds.
    """
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    judged = with_rule(with_host_and_path(source), rules)
    edges = host_edges(judged)
    judged = stored(judged.drop("html", "url"), "judged")
    ranks = propagate(edges, seeds(judged), tolerance=tolerance)
    hosts = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0)).alias(k) for k in KINDS])
    shares = {k: F.coalesce(k, F.lit(0.0)) for k in KINDS}
    found = join_unique(judged, hosts, ["host"], "left").withColumns(shares)
    by_method = F.when(F.col("distrust") > (1 + _ROUNDING) * threshold * F.col("trust"), "block").otherwise("allow")
    shown = [F.round(k, 12).alias(k) for k in KINDS]
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruling", by_method).alias("verdict"), *shown)
