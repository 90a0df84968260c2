"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Every document becomes the set of its distinct word shingles; equal sets are one node. Shingles are
   shuffled once, packed by bucket of their hash, to count exactly in how many nodes each occurs.
2. Two sets with a Jaccard likeness of at least t share a shingle among the first n - ceil(t n) + 1 of
   each, in any order common to all (prefix filter). The order is rarest first. Shingles of one node
   come first and can't be shared, so only shared shingles go back to their nodes, which keep those
   inside their prefix: mostly none.
3. Sets that share a prefix shingle fall into the block of that shingle's leader, the member with the
   smallest hash. Shingles of one family of copies mostly have one leader, so a set falls into few
   blocks. A pair that meets in several blocks is taken in the one with the smallest leader only.
4. Blocks are cut into chunks of bounded size, and every pair of chunks is solved by itself: length
   filter, positional filter, suffix filter (shingles counted by cells of the hash range), then one
   exact intersection per surviving pair. It yields each set's number of links, and links that span
   the components found; pairs themselves are never written.
5. Components of these links, joined back to all documents.

Nodes are named by a 64-bit signature of the set. In steps 1 and 2 a shingle is known by the upper 48 bits
of its hash; prefixes are longer by two, so that shingles which agree in these bits can't lose a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.llm import texts
from clientela.llm.components import connected_components
from clientela.llm.tables import bytes_per_batch, counters, records_per_batch, ship, shuffle_partitions, stored
from clientela.operators.joins import join_unique

PERCENT = 75
NODE_FILTER_BITS = 26
CHUNK_SHINGLES = 20_000
PAIRS_PER_BATCH = 64
HELD_SHINGLES = 500_000
DEALT_SHINGLES = 1_000_000
#: Shingles of an Arrow batch of packed rows, at most if they are not of one bucket.
SENT_SHINGLES = 100_000
_BLOCK = 1 << 15
_CELLS = 64


def _signed(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit signature of each set; equal sets have equal signatures."""
    n = np.diff(starts)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(texts.mix(hashes ^ np.uint64(0x1B873593CC9E2D51)), out=total[1:])
    return n, texts.mix(total[starts[1:]] - total[starts[:-1]] + n.astype(np.uint64))


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, set number per shingle, shingle hashes, where sets start) for runs of documents."""
    column = texts.as_strings(batch.column(1))
    data, offsets = texts.flat(column)
    for first, last in texts.slices(offsets):
        at = offsets[first : last + 1]
        words = texts.word_hashes(data[at[0] : at[-1]], at - at[0])
        text, hashes = texts.distinct_by_text(*texts.shingle_hashes(words, size))
        starts = np.searchsorted(text, np.arange(last - first + 1))
        yield batch.column(0).slice(first, last - first), text, hashes, starts


_SETS = "doc_id long, n int, node long"


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, hashes, starts in _sets(batch, size):
                n, node = _signed(hashes, starts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int32()), pa.array(node.view(np.int64))], names=["doc_id", "n", "node"])

    return run


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


_SHINGLES = "bucket int, h binary, times binary, node binary, n binary"


def _dealt(size: int, buckets: int):
    """Packed shingles by bucket of the hash range, a bounded number at a time; equal sets among these count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        seen: set[int] = set()
        held = 0
        for batch in batches:
            for ids, text, hashes, starts in _sets(batch, size):
                n, node = _signed(hashes, starts)
                take = ids.is_valid().to_numpy(zero_copy_only=False) & (n > 0)
                take &= np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool)
                keep = take[text]
                parts.append((hashes[keep] >> np.uint64(16), text[keep].astype(np.int32), node, n))
                held += len(parts[-1][0])
                if held > DEALT_SHINGLES:
                    yield from _packed_shingles(parts, buckets)
                    parts, seen, held = [], set(), 0
        if held:
            yield from _packed_shingles(parts, buckets)

    return run


def _packed_shingles(parts: list[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """The parts' shingles by bucket; ``parts`` is emptied, and copies go as soon as the next one stands."""
    count = np.cumsum([0, *[len(p[2]) for p in parts]])
    node, n = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
    bucket = np.concatenate([_bucket(p[0] << np.uint64(16), buckets) for p in parts])
    text = np.concatenate([p[1] + np.int32(c) for p, c in zip(parts, count)])
    h = np.concatenate([p[0] for p in parts]).astype("<u8", copy=False)
    parts.clear()
    order = np.argsort(bucket, kind="stable").astype(np.int32)  # within a bucket, by text
    h = h[order]
    text = text[order]
    bucket = bucket[order]
    del order
    edges = np.r_[_runs(bucket), len(h)]
    six = h.view(np.uint8).reshape(-1, 8)[:, :6]
    for first, last in texts.slices(edges, SENT_SHINGLES):
        columns: list[list] = [[] for _ in range(5)]
        for a, b in zip(edges[first:last], edges[first + 1 : last + 1]):
            new = _runs(text[a:b])
            columns[0].append(int(bucket[a]))
            columns[1].append(six[a:b].tobytes())
            columns[2].append(np.diff(np.r_[new, b - a]).astype(np.uint16 if b - a < 65536 else np.uint32).tobytes())
            columns[3].append(node[text[a:b][new]].tobytes())
            columns[4].append(n[text[a:b][new]].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["bucket", "h", "times", "node", "n"]
        )


def _by_bucket(solve):
    """Apply ``solve`` to the rows of each bucket; partitions are sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from solve(held)
                    held = []
                held.append(row)
        if held:
            yield from solve(held)

    return run


_SHARED = "bucket int, node binary, n binary, h binary, often binary"


def _shared(buckets: int):
    """Shingles of two nodes or more, with their number of nodes, packed by bucket of the node."""

    def solve(rows: list[dict]) -> Iterator[tuple[np.ndarray, ...]]:
        ends = np.cumsum([0, *[len(r["h"]) // 6 for r in rows]])
        h = np.zeros((ends[-1], 8), np.uint8)
        for r, a, b in zip(rows, ends[:-1], ends[1:]):
            h[a:b, :6] = np.frombuffer(r["h"], np.uint8).reshape(-1, 6)
        h = h.view("<u8").ravel()
        order = np.argsort(h, kind="stable")
        h = h[order]
        many = np.zeros(len(h), bool)
        many[1:] = h[1:] == h[:-1]
        many[:-1] |= many[1:]
        h, order = h[many], order[many]  # mostly few are left, and large copies go
        times = [np.frombuffer(r["times"], np.uint16 if len(r["h"]) // 6 < 65536 else np.uint32) for r in rows]
        which = np.searchsorted(np.cumsum(np.concatenate(times), dtype=np.int64), order, side="right")
        node = np.concatenate([np.frombuffer(r["node"], np.uint64) for r in rows])[which]
        n = np.concatenate([np.frombuffer(r["n"], np.uint32) for r in rows])[which]
        order = np.lexsort((node, h))
        order = order[_runs(h[order], node[order])]  # equal sets count once
        h, node, n = h[order], node[order], n[order]
        members = np.diff(np.r_[_runs(h), len(h)])
        often = np.repeat(members, members).astype(np.uint32)
        keep = often > 1
        yield node[keep], n[keep], h[keep], often[keep]

    def packed(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*parts)]
        parts.clear()
        bucket = _bucket(texts.mix(columns[0]), buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [x[order] for x in columns]
        edges = np.r_[_runs(bucket), len(bucket)]
        for first, last in texts.slices(edges, SENT_SHINGLES):
            at = edges[first : last + 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[at[:-1]]), *[pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()) for x in columns]],
                names=["bucket", "node", "n", "h", "often"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in _by_bucket(solve)(batches):
            held.append(part)
            size += len(part[0])
            if size > HELD_SHINGLES:  # few large blocks rather than one for each pair of buckets
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    return run


def _prefixes(percent: int):
    """Shared shingles inside their node's prefix, rarest first, with their position."""

    def solve(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        node, n, h, often = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in (("node", np.uint64), ("n", np.uint32), ("h", np.uint64), ("often", np.uint32)))
        order = np.lexsort((h, often, node))
        node, n, h = node[order], n[order].astype(np.int64), h[order]
        first = _runs(node)
        shared = np.diff(np.r_[first, len(node)])
        pos = np.arange(len(node)) - np.repeat(first, shared) + n - np.repeat(shared, shared)
        keep = pos < prefix_length(n, percent) + 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[keep].view(np.int64)), pa.array(node[keep].view(np.int64)), pa.array(n[keep], pa.int32()), pa.array(np.maximum(pos[keep], 0), pa.int32())],
            names=["h", "node", "n", "pos"],
        )

    return _by_bucket(solve)


def _node_filter(bits: int):
    def run(batches):
        seen = np.zeros(1 << (bits - 5), np.uint32)
        for batch in batches:
            at = texts.mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - bits)
            np.bitwise_or.at(seen, (at >> np.uint64(5)).astype(np.int64), np.uint32(1) << (at & np.uint64(31)).astype(np.uint32))
        for block, part in enumerate(seen.reshape(-1, min(_BLOCK, len(seen)))):
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})

    return run


def _kept_sets(size: int, bits: int, wanted):
    """(node, set) of sets whose signature may be a node's; the join that follows is exact."""

    def run(batches):
        seen = wanted.value
        for batch in batches:
            sent: set[int] = set()
            for _, _, hashes, starts in _sets(batch, size):
                _, node = _signed(hashes, starts)
                at = texts.mix(node) >> np.uint64(64 - bits)
                hit = (seen[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
                new = [k for k in np.flatnonzero(hit).tolist() if node[k] not in sent and not sent.add(node[k])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[new].view(np.int64)), pa.array([hashes[starts[k] : starts[k + 1]].tobytes() for k in new], pa.binary())],
                    names=["node", "shingles"],
                )

    return run


class _Chunk:
    """Sets of one chunk, their prefix entries and cell counts."""

    def __init__(self, members: list[dict]):
        self.node = np.array([m["node"] for m in members], np.int64)
        self.n = np.array([m["n"] for m in members], np.int64)
        self.sets = [np.frombuffer(m["shingles"], np.uint64) for m in members]
        owner = np.repeat(np.arange(len(members)), [len(m["prefix"]) for m in members])
        entries = [e for m in members for e in m["prefix"]]
        h = np.array([e["h"] for e in entries], np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.owner = h[order], owner[order]
        self.pos = np.array([e["pos"] for e in entries], np.int64)[order]
        self.leader = np.array([e["leader"] for e in entries], np.int64)[order]
        self.cells = np.stack([np.bincount(s >> np.uint64(58), minlength=_CELLS) for s in self.sets])
        self._joined = None

    def joined(self):
        """All shingles of the chunk, sorted, with the set of each."""
        if self._joined is None:
            every = np.concatenate(self.sets)
            owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
            order = np.argsort(every, kind="stable")
            self._joined = every[order], owner[order]
        return self._joined


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all ranges [low, high), and which range each is of."""
    many = high - low
    which = np.repeat(np.arange(len(low)), many)
    return np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + low[which], which


def _linked(left: _Chunk, right: _Chunk, block: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each left set, the right sets linked to it, among pairs whose smallest shared leader is ``block``."""
    within = left is right
    starts = np.argsort(left.owner, kind="stable")
    edges = np.searchsorted(left.owner[starts], np.arange(len(left.node) + 1))
    for x in range(len(left.node)):
        mine = starts[edges[x] : edges[x + 1]]
        low, high = (np.searchsorted(right.h, left.h[mine], side=s) for s in ("left", "right"))
        at, which = _ranges(low, high)
        if not len(at):
            continue
        y = right.owner[at]
        order = np.argsort(y, kind="stable")
        at, which, y = at[order], mine[which[order]], y[order]
        new = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
        other = y[new]
        # a pair belongs to the block whose leader comes first among those of its shared shingles
        least = np.minimum.reduceat(right.leader[at], new)
        nx, ny = left.n[x], right.n[other]
        ok = (least == block) & (np.minimum(nx, ny) * 100 >= percent * np.maximum(nx, ny))
        if within:
            ok &= other > x
        need = -(-percent * (nx + ny) // (100 + percent))
        # positional filter, at the first shared shingle: no more can be shared than follow it
        rest = 1 + np.minimum(nx - left.pos[which] - 1, right.n[y] - right.pos[at] - 1)
        ok &= np.maximum.reduceat(rest, new) >= need
        other, need = other[ok], need[ok]
        if len(other):  # suffix filter: no more can be shared than the cells allow
            ok = np.minimum(left.cells[x], right.cells[other]).sum(axis=1) >= need
            other = other[ok]
        if not len(other):
            continue
        if len(other) <= 4:
            shared = np.array([np.isin(right.sets[k], left.sets[x], assume_unique=True).sum() for k in other])
        else:
            every, owner = right.joined()
            low, high = (np.searchsorted(every, left.sets[x], side=s) for s in ("left", "right"))
            shared = np.bincount(owner[_ranges(low, high)[0]], minlength=len(right.node))[other]
        hit = other[100 * shared >= percent * (nx + right.n[other] - shared)]
        if len(hit):
            yield x, hit


def _solve(percent: int):
    """Rows of two chunks of a block -> (node, root, links): links a node has here, and spanning links."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                left = _Chunk(row["left"])
                right = left if row["i"] == row["j"] else _Chunk(row["right"])
                count = {0: np.zeros(len(left.node), np.int64), 1: np.zeros(len(right.node), np.int64)}
                nodes = left.node if left is right else np.concatenate([left.node, right.node])
                shift = 0 if left is right else len(left.node)
                root = np.arange(len(nodes))
                for x, hit in _linked(left, right, row["leader"], percent):
                    count[0][x] += len(hit)
                    np.add.at(count[0 if left is right else 1], hit, 1)
                    together = np.unique(root[np.r_[x, hit + shift]])
                    if len(together) > 1:
                        root[np.isin(root, together)] = together[0]
                links = count[0] if left is right else np.concatenate([count[0], count[1]])
                if not links.any():
                    continue
                keep = links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[keep]), pa.array(nodes[root[keep]]), pa.array(links[keep])],
                    names=["node", "root", "links"],
                )

    return run


def jaccard_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = texts.SHINGLE,
    percent: int = PERCENT, chunk_shingles: int = CHUNK_SHINGLES,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    Two documents link when their shingle sets have a Jaccard likeness of ``percent`` / 100 or more.
    ``component_id`` is the smallest id reachable by links; ``n_links`` counts the different sets that
    a document's set links to (equal sets are one set, and share component and count).

    Null or empty text, or text without words: an empty set, linked with nothing, its own component.
    A null id: its row is returned with a null component and takes no part. Repeated rows: each is
    returned; rows of one id with different texts are sets of their own. Empty table: no rows. Other
    columns are not read. Very long texts are taken whole.
    """
    spark = ship(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    sets = stored(source.mapInArrow(_count(size), _SETS), "sets")

    partitions = shuffle_partitions(spark)
    buckets = 4 * partitions
    dealt = source.mapInArrow(_dealt(size, buckets), _SHINGLES).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    shared = dealt.mapInArrow(_shared(partitions), _SHARED).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    with bytes_per_batch(spark):
        entries = stored(shared.mapInArrow(_prefixes(percent), "h long, node long, n int, pos int"), "prefixes")
    leaders = entries.groupBy("h").agg(F.count("*").alias("members"), F.min_by("node", F.xxhash64("node")).alias("leader")).where("members > 1")
    entries = stored(entries.join(leaders.drop("members"), "h"), "entries")

    bits = NODE_FILTER_BITS
    seen = counters(entries.select("node").distinct().mapInArrow(_node_filter(bits), "block int, counts binary"), "or")
    wanted = spark.sparkContext.broadcast(_filled(seen, 1 << (bits - 5)))
    shingles = source.mapInArrow(_kept_sets(size, bits, wanted), "node long, shingles binary").dropDuplicates(["node"])
    chunks = stored(_block_chunks(entries, shingles, chunk_shingles), "blocks")
    left = chunks.select("leader", F.col("chunk").alias("i"), F.col("members").alias("left"))
    right = chunks.select("leader", F.col("chunk").alias("j"), F.col("members").alias("right"))
    pairs = left.join(right.hint("merge"), "leader").where("i <= j")
    with records_per_batch(spark, PAIRS_PER_BATCH), bytes_per_batch(spark):
        found = stored(pairs.mapInArrow(_solve(percent), "node long, root long, links long"), "found")

    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = connected_components(found, "node", "root")
    known = sets.where("doc_id is not null and n > 0").groupBy("node").agg(F.min("doc_id").alias("own"))
    linked = stored(known.join(roots, "node").join(links, "node"), "linked")
    least = linked.groupBy("root").agg(F.min("own").alias("least"))
    linked = linked.join(least, "root").select("node", "least", "n_links")
    classes = known.join(linked, "node", "left").select(
        "node", F.coalesce("least", "own").alias("least"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    taking_part = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return join_unique(sets, classes, ["node"], "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(taking_part, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(taking_part, F.col("n_links")).otherwise(0).alias("n_links"),
    )


def _filled(counts: np.ndarray, length: int) -> np.ndarray:
    """Blocks without any count at the end are not sent; the table has its full length all the same."""
    return np.concatenate([counts, np.zeros(length - len(counts), np.uint32)])


def _block_chunks(entries: DataFrame, shingles: DataFrame, chunk_shingles: int) -> DataFrame:
    """(leader, chunk, members): the sets of each block in chunks of about ``chunk_shingles`` shingles."""
    prefixes = entries.groupBy("node").agg(F.collect_list(F.struct("h", "pos", "leader")).alias("prefix"))
    members = entries.select("leader", "node", "n").distinct()
    sizes = members.groupBy("leader").agg(F.ceil(F.sum("n") / F.lit(chunk_shingles)).cast("int").alias("chunks"))
    members = members.join(sizes, "leader").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    member = F.struct("node", "n", "shingles", "prefix")
    return (
        members.join(prefixes, "node").join(shingles, "node")
        .groupBy("leader", "chunk").agg(F.collect_list(member).alias("members"))
    )
