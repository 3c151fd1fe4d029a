"""SimHash near-dedup over vantage-point trees.

Two fingerprints that differ in at most LINK of 64 bits differ in at most LINK // 2 bits of one of their halves. Each
half is a metric space of its own under Hamming distance and gets a vantage-point tree: nodes split the fingerprints by
their distance from a vantage point, and by the triangle inequality a fingerprint at distance d needs to look beyond a
node's radius only if d is within LINK // 2 of it. The tree's leaves are the shards. Every fingerprint lives in one
shard and also visits those shards beyond a boundary that it is close to; a pair is compared where one of them lives and
the other one lives or visits. Inside a shard a smaller tree of the same kind prunes further, and pairs that remain are
compared exactly on all 64 bits. Trees are grown on a bounded sample of fingerprints; that only moves the boundaries.

Equal fingerprints are one point. A shard gives a forest of links (linear in its members), and components come from
alternating large-star and small-star rounds over these links; no links, components or fingerprints of all documents
reach the driver.

The first trees have a bounded number of shards, whatever the number of fingerprints. A shard with too many residents
gets a tree of its own, grown on a sample of them in one task, over which its rows are routed in many; and so on, until
shards are small or a tree parts nothing any more.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, map_arrow, slices, spread, table, texts

LINK = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that the shard trees are grown on, at most.
SAMPLE = 1 << 15
#: Fingerprints a shard should hold, and shards of a tree at most.
SHARD, SHARDS = 4096, 1 << 12
#: A shard with more residents is dealt to several tasks, all of which its visitors visit.
CROWD = 20_000
#: Comparisons made at once.
BLOCK = 1 << 21

_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def shingles(text: str, size: int) -> list[bytes]:
    """Each `size` neighbouring words of the text, in lower case and one space apart; of fewer words all; of none nothing."""
    words = text.encode().translate(_LOWER).split()  # bytes.split() parts at 0x20 and 0x09-0x0D
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined, at, end = b" ".join(words), 0, sum(map(len, words[:size])) + size - 1
    found = []
    for first, after in zip(words, words[size:]):
        found.append(joined[at:end])
        at += len(first) + 1
        end += len(after) + 1
    found.append(joined[at:end])
    return found


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, set where over half of the shingles' hashes have them set; 0 without words."""
    found = shingles(text, size)
    if not found:
        return 0
    hashes = b"".join(map(partial(xxhash.xxh64_digest, seed=seed), found))
    return majority(np.frombuffer(hashes, ">u8")) % (1 << 64)


def majority(hashes: np.ndarray) -> int:
    """The bits, as a signed number, that are set in over half of some 64-bit numbers; 0 for none."""
    total, n = np.zeros(64, np.int64), len(hashes)
    raw = hashes.astype(">u8" if hashes.dtype.kind == "u" else ">i8", copy=False).view(np.uint8).reshape(n, 8)
    for i in range(0, n, 1 << 16):
        total += np.unpackbits(raw[i : i + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def _halves(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (prints >> np.uint64(32)).astype(np.uint32), prints.astype(np.uint32)


def _far(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ points.dtype.type(vantage)).astype(np.int16)


class Tree:
    """Nodes of a vantage-point tree over one half; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple] = []  # (vantage point, radius, inner, outer); leaves are ~number
        self.leaves = 0
        self.root = self._grow(sample, leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(points) > 1:
            # of some points the one whose boundary holds the fewest others
            best = None
            for v in points[:: max(1, len(points) // 8)][:8]:
                d = _far(points, v)
                radius = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
                inner = int((d <= radius).sum())
                if 0 < inner < len(points):
                    cost = int(((d == radius) | (d == radius + 1)).sum()) + abs(2 * inner - len(points)) // 2
                    if best is None or cost < best[0]:
                        best = cost, int(v), radius
            if best:
                _, v, radius = best
                d = _far(points, v)
                at = len(self.nodes)
                self.nodes.append(())
                self.nodes[at] = v, radius, self._grow(points[d <= radius], leaves // 2), self._grow(points[d > radius], leaves - leaves // 2)
                return at
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, half: np.ndarray, reach: int, lives: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the point, leaf, and whether it lives there (else it visits), for every place each point goes to.

        Points that are visitors already stay so wherever they go.
        """
        out = []
        todo = [(self.root, np.arange(len(half)), np.ones(len(half), bool) if lives is None else lives)]
        while todo:
            node, at, lives = todo.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((at, np.full(len(at), ~node), lives))
                continue
            v, radius, inner, outer = self.nodes[node]
            d = _far(half[at], v)
            inside = np.where(lives, d <= radius, d - reach <= radius)
            # residents of the inner side visit the outer one; that is enough for a pair to meet once
            outside = np.where(lives, d > radius, d + reach > radius) | (lives & (d <= radius) & (d + reach > radius))
            todo.append((inner, at[inside], lives[inside]))
            todo.append((outer, at[outside], (lives & (d > radius))[outside]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes label, in which each point leads to a smaller one or itself, join the pairs' groups."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def forest(residents: np.ndarray, visitors: np.ndarray, side: int, link: int = LINK) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smaller one) that join all fingerprints within `link` bits, one of each pair a resident."""
    points = np.unique(np.concatenate([residents, visitors]))
    label = np.arange(len(points))
    half, reach = _halves(points)[side], link // 2

    def search(members: np.ndarray, queries: np.ndarray, depth: int) -> None:
        if not len(members) or not len(queries):
            return
        if len(members) > 64 and len(members) * len(queries) > BLOCK // 4 and depth < 40:
            d = _far(half[members], half[members[len(members) // 2]])
            radius = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
            near = d <= radius
            if 0 < near.sum() < len(members):
                q = _far(half[queries], half[members[len(members) // 2]])
                search(members[near], queries[q - reach <= radius], depth + 1)
                search(members[~near], queries[q + reach > radius], depth + 1)
                return
        step = max(1, BLOCK // len(members))
        for i in range(0, len(queries), step):
            part = queries[i : i + step]
            x, y = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[members][None, :]) <= link)
            _united(label, part[x], members[y])

    search(np.searchsorted(points, np.unique(residents)), np.arange(len(points)), 0)
    linked = np.flatnonzero(label != np.arange(len(points)))
    return points[linked], points[label[linked]]


_PLACE = "tree int, leaf bigint, print bigint, lives boolean"


def deepened(stage: Stage, placed: DataFrame, turn: int, reach: int, crowd: int, shard: int) -> DataFrame | None:
    """The places once shards with more than crowd residents are parted by trees of their own; None if there is none or nothing is parted."""
    sizes = placed.filter("lives").groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd)
    crowds = stage.save(sizes.withColumn("leaves", F.least(F.lit(SHARDS), F.ceil(F.col("n") / shard)).cast("int")).withColumn("parts", F.ceil(F.col("n") / crowd).cast("int")), f"crowds-{turn}")
    if crowds.isEmpty():
        return None
    # about 8 residents for each leaf: at most 8 * SHARDS, whatever the shard's size
    chosen = F.pmod(F.xxhash64("print", F.lit(11 + turn)), F.col("n")) < 8 * F.col("leaves")
    sample = placed.filter("lives").join(crowds, ["tree", "leaf"]).filter(chosen).groupBy("tree", "leaf", "leaves", "parts").agg(F.collect_list("print").alias("prints"))

    def grow(batches):
        for b in batches:
            trees = []
            for side, leaves, prints in zip(*(b.column(c).to_pylist() for c in ("tree", "leaves", "prints"))):
                points = np.sort(np.array(prints, np.int64).view(np.uint64))  # as the sample has no order
                trees.append(pickle.dumps(Tree(_halves(points)[side], leaves)))
            yield {"tree": b.column("tree"), "leaf": b.column("leaf"), "parts": b.column("parts"), "grown": trees}

    grown = stage.save(map_arrow(sample, grow, "tree int, leaf bigint, parts int, grown binary"), f"grown-{turn}")
    rows = placed.join(crowds.select("tree", "leaf", "parts"), ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("print", F.lit(3)), F.col("parts")).cast("int"))
    each = grown.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def route(key, pdf, trees):
        import pandas as pd

        prints, lives = pdf["print"].to_numpy().view(np.uint64), pdf["lives"].to_numpy().astype(bool)
        if not len(prints) or not len(trees):
            return pd.DataFrame({"tree": pdf["tree"], "leaf": pdf["leaf"], "print": pdf["print"], "lives": pdf["lives"]})
        tree = pickle.loads(trees["grown"].iloc[0])
        at, leaf, stays = tree.route(_halves(prints)[int(key[0])], reach, lives)
        return pd.DataFrame({"tree": np.full(len(at), key[0], np.int32), "leaf": int(key[1]) * SHARDS + SHARDS + leaf, "print": prints[at].view(np.int64), "lives": stays})

    by = ["tree", "leaf", "part"]
    parted = rows.groupBy(by).cogroup(each.groupBy(by)).applyInPandas(route, _PLACE)
    now = stage.save(placed.join(crowds, ["tree", "leaf"], "left_anti").unionByName(parted), f"placed-{turn}")
    before, after = crowds.count(), now.filter("lives").groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd)
    told = after.agg(F.count(F.lit(1)), F.max("n")).first()
    largest = crowds.agg(F.max("n")).first()[0]
    return None if told[0] == before and told[1] == largest else now


def links(stage: Stage, points: DataFrame, link: int = LINK, shard_size: int = SHARD, shards: int = SHARDS, crowd: int = CROWD) -> DataFrame:
    """a, b joining all points (column print) within `link` bits of each other."""
    n = points.count()
    leaves = max(1, min(shards, 1 << max(0, (n // shard_size).bit_length())))
    # at most SAMPLE fingerprints, the same ones whenever it is asked again
    sample = np.array([r[0] for r in points.orderBy(F.xxhash64("print"), "print").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    trees = [Tree(h, leaves) for h in _halves(sample)]
    reach = link // 2

    def run(batches):
        for b in batches:
            prints = b.column("print").to_numpy().view(np.uint64)
            for k, (tree, half) in enumerate(zip(trees, _halves(prints))):
                at, leaf, lives = tree.route(half, reach)
                if len(at):
                    yield {"tree": np.full(len(at), k, np.int32), "leaf": leaf.astype(np.int64), "print": prints[at].view(np.int64), "lives": lives}

    placed, turn = stage.save(map_arrow(points, run, _PLACE), "placed"), 0
    while (deeper := deepened(stage, placed, turn := turn + 1, reach, crowd, shard_size)) is not None:
        placed = deeper
    # shards that no tree parts (many equal halves) are dealt to several tasks; each has a crowd of residents at least
    crowds = placed.filter("lives").groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("tree", "leaf", F.ceil(F.col("n") / crowd).cast("int").alias("parts"))
    dealt = placed.join(stage.save(crowds, "crowds"), ["tree", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    home = F.pmod(F.xxhash64("print", F.lit(7)), F.col("parts")).cast("int")
    # residents live in one part and visit the parts after it; visitors visit all
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.when(F.col("lives"), home).otherwise(0), F.col("parts") - 1))).withColumn("lives", F.col("lives") & (F.col("part") == home))

    def shard(key, pdf):
        import pandas as pd

        prints, lives = pdf["print"].to_numpy().view(np.uint64), pdf["lives"].to_numpy()
        a, b = forest(prints[lives], prints[~lives], int(key[0]), link)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("tree", "leaf", "part").applyInPandas(shard, "a bigint, b bigint").distinct()


def components(stage: Stage, edges: DataFrame) -> DataFrame:
    """node, root of each node of the edges (a, b): the least node of its component, as signed numbers.

    Large-star joins every node's greater neighbours to its least one, small-star its smaller ones; the rounds end
    when nothing changes, and their number grows with the logarithm of a component's size.
    """
    edges = stage.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges-0")
    was, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        turn += 1
        edges = stage.save(small, f"edges-{turn}")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        stage.drop(f"edges-{turn - 1}")
        if now == was or not now[0]:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, link: int = LINK, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs.

    A null text has no words, so its fingerprint is zero like that of an empty one. Repeated rows and ids each give
    their own row; a null id stays null and names no component unless no other id is in it. Other columns are
    ignored, whatever their names. An empty table gives an empty table.
    """
    stage = Stage(docs.sparkSession, "neardup")

    def run(batches):
        for b in slices(batches, "text"):
            prints = [fingerprint(t or "", size, seed) for t in b.column("text").to_pylist()]
            yield {"doc_id": b.column("doc_id"), "print": np.array(prints, np.uint64).view(np.int64)}

    rows = stage.save(map_arrow(texts(docs), run, "doc_id bigint, print bigint"), "rows")
    points = stage.save(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "points")
    found = components(stage, links(stage, points.select("print"), link))
    grouped = points.join(found, points.print == found.node, "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    ids = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(ids, "root").select("print", "component_id")
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")))


ORACLE_SQL = None  # XXH64 and components aren't within the SQL at hand: tested against a plain loop instead
