"""SimHash near-dedup without misses: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Fingerprints of these sets are linked over vantage-point trees as in neardup; linked texts are held against each other
by their whole sets. That joins most copies. No distance of fingerprints that trees can prune is wide enough for all
texts of this similarity, so a prefix filter, which loses none, completes it: in any one order of all shingles, two sets
that are this similar share one of the first n // 5 + 1 of their n shingles. Shingles that are common in a bounded
sample come last in that order; this only keeps the buckets of texts with the same shingle small.

Equal sets are one point. Points of a bucket are compared inside a task by size and by the parities of their sets' hashes
(which never show more differences than there are), narrow ones first, then ones as wide as their sets are large; a
crowded bucket is dealt to several tasks, and of buckets with the same points one is enough. A bucket gives a forest of
its candidates, not pairs: fewer than it has points. So all candidates are in the same cluster, a component of these
forests. The whole sets of a cluster meet in one task, and those of a large one in several, each once in its own part;
what shares enough hashes there is linked, again by a forest. Refuted candidates are never written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, map_arrow, shuffle_width, slices, texts
from .neardup import components, links, majority, shingles

SHINGLE = 5
#: Texts that common shingles are looked for in, about; how many of them have a common one; common ones listed at most.
SAMPLE, COMMON, LISTED = 1 << 14, 4, 1 << 16
#: A bucket with more points is dealt to several tasks.
CROWD = 4096
#: Pairs compared at once, and numbers of their wide parities.
BLOCK = 1 << 18
#: A cluster with more marks is dealt to several tasks.
CLUSTER = 1 << 20
#: Bits in which linked fingerprints differ at most.
LINK = 3
#: Bits of the parities, 64 in each of so many numbers; wide ones have at least as many bits as their set has marks.
WORDS = 8

#: Slots of hashes of wanted texts, told to all tasks: texts in none of them are not moved.
SLOTS = 1 << 17

KEY = ["doc_id", "hash_1", "hash_2"]


def marks(text: str, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles(text, size))), np.int64))


def prefix(found: np.ndarray, listed: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The marks of which two similar sets share one: the first ones, where listed marks come last, in order of rank."""
    most = len(found) // 5 + 1
    if not len(listed) or not len(found):
        return found[:most]
    place = np.minimum(np.searchsorted(listed, found), len(listed) - 1)
    common = listed[place] == found
    late = np.argsort(rank[place[common]])
    return np.concatenate([found[~common], found[common][late]])[:most]


def parity(found: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Bits, each set if an odd number of marks fall on it: two sets differ in at least as many marks as their parities in bits."""
    count = np.bincount((found.view(np.uint64) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words)
    return np.packbits(count & 1).view(np.int64)


def width(n: int) -> int:
    """Numbers in the wide parity of a set of n marks: a power of two. Sizes that fit each other have at most one doubling between them."""
    return max(WORDS, 1 << max(0, (n - 1) // 64).bit_length())


def _key(docs: DataFrame) -> list[Column]:
    """KEY: the id and two hashes of the text tell rows apart, except for repeated ones."""
    text = docs["text"].cast("string")
    return [docs["doc_id"].cast("bigint"), F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.filter(F.pmod("hash_1", F.lit(1 << 20)) < int(share * (1 << 20))).select("text").distinct()

    def run(batches):
        for b in slices(batches, "text"):
            yield {"mark": np.concatenate([marks(t or "", size) for t in b.column("text").to_pylist()])}

    # at most LISTED shingles
    seen = map_arrow(some, run, "mark bigint").groupBy("mark").count().filter(F.col("count") >= COMMON)
    found = np.array([r[0] for r in seen.orderBy(F.col("count").desc(), "mark").limit(LISTED).collect()], np.int64)
    order = np.argsort(found)
    return found[order], len(found) - order  # the most common one is the last


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _sizes_fit(n: Column, m: Column) -> Column:
    return (5 * n >= 4 * m) & (5 * m >= 4 * n)


def _differing(x: Column, y: Column) -> Column:
    """Bits in which two wide parities differ, at the width of the narrower one: the halves of the wider one, added up, are its parity."""

    def narrowed(bits: Column, other: Column) -> Column:
        half = F.floor(F.size(bits) / 2).cast("int")
        added = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(bits) > F.size(other), added).otherwise(bits)

    each = F.zip_with(narrowed(x, y), narrowed(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(each, F.lit(0), lambda total, n: total + n)


def _near(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of points that may be similar by the sizes and wide parities of their sets."""
    x, y = (points.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab")
    fits = F.when(_sizes_fit(F.col("n_a"), F.col("n_b")), 9 * _differing(F.col("wide_a"), F.col("wide_b")) <= F.col("n_a") + F.col("n_b"))
    return pairs.join(x, "a").join(y, "b").filter(fits).select("a", "b")


class Cluster:
    """The sets that live in one part of a cluster, and links that join all similar ones of different roots."""

    def __init__(self, node: list[int], root: list[int], sets: list[np.ndarray]):
        self.node, self.sets, self.n = node, sets, np.array(list(map(len, sets)), np.int64)
        names, first, self.label = np.unique(np.array(root, np.int64), return_index=True, return_inverse=True)
        self.one = dict(zip(names.tolist(), first.tolist()))  # a point of each root
        held = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        order = np.argsort(held, kind="stable")
        self.held, self.owner = held[order], np.repeat(np.arange(len(sets)), self.n)[order]

    def _met(self, node: int, found: np.ndarray, own: int) -> list[tuple[int, int]]:
        """Links of a set to one point of each label but its own that has a similar one; these labels are one from now on."""
        low, high = np.searchsorted(self.held, found), np.searchsorted(self.held, found, "right")
        size = high - low
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        shared = np.bincount(self.owner[at], minlength=len(self.n))
        near = np.flatnonzero((9 * shared >= 4 * (len(found) + self.n)) & (self.label != own))
        labels, first = np.unique(self.label[near], return_index=True)
        if len(labels):
            self.label[np.isin(self.label, labels)] = own if own >= 0 else labels[0]
        return [(min(node, other), max(node, other)) for other in (self.node[k] for k in near[first].tolist())]

    def links(self) -> list[tuple[int, int]]:
        """Of those who live here. A pair of different labels has a point outside the largest one; that point is enough to find it."""
        out, new = [], np.ones(len(self.n), bool)
        while len(left := np.flatnonzero(new & (self.label != np.bincount(self.label, minlength=1).argmax()))):
            new[x := int(left[0])] = False
            out += self._met(self.node[x], self.sets[x], int(self.label[x]))
        return out

    def visited(self, node: int, root: int, found: np.ndarray) -> list[tuple[int, int]]:
        """Of one who lives in another part."""
        return self._met(node, found, int(self.label[self.one[root]]) if root in self.one else -1) if len(self.n) else []


def _verified(stage: Stage, name: str, pairs: DataFrame, roots: DataFrame | None, points: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b) of points that join all points of the same cluster, a component of the given pairs, whose sets have a similarity of at least 0.8."""
    spark = docs.sparkSession
    clusters = components(Stage(spark, f"copies-{name}"), pairs).select("node", F.col("root").alias("cluster"))
    wanted = points.join(clusters, "node")
    wanted = wanted.withColumn("root", F.col("node")) if roots is None else wanted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    wanted = stage.save(wanted.select("node", "cluster", "root", "n", *[F.col("first")[c].alias(f"_{c}") for c in KEY]), f"wanted-{name}")
    crowds = stage.save(wanted.groupBy("cluster").agg(F.sum("n").alias("all")).filter(F.col("all") > CLUSTER).select("cluster", F.ceil(F.col("all") / CLUSTER).cast("int").alias("parts")), f"parts-{name}")
    slot = F.pmod("hash_1", F.lit(SLOTS)).cast("int")
    slots = wanted.select(F.pmod("_hash_1", F.lit(SLOTS)).cast("int").alias("slot")).distinct()
    # at most SLOTS numbers
    docs = docs.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    chosen = docs.join(wanted, [docs[c].eqNullSafe(wanted[f"_{c}"]) for c in KEY]).select("node", "cluster", "root", "text").dropDuplicates(["node"])
    dealt = chosen.join(crowds, "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    home = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    # a point lives in one part of its cluster and visits the parts after it, where it comes after those who live there
    dealt = dealt.withColumn("part", F.explode(F.sequence(home, F.col("parts") - 1))).withColumn("visits", F.col("part") != home)
    dealt = dealt.select("cluster", "part", "visits", "node", "root", "text").repartition(shuffle_width(spark), "cluster", "part").sortWithinPartitions("cluster", "part", "visits")

    def run(batches):
        key, living, held = None, [], None

        def settled():
            cluster = Cluster(*map(list, zip(*living))) if living else Cluster([], [], [])
            return cluster, cluster.links()

        for b in slices(batches, "text"):
            out = []
            for *at, visits, node, root, text in zip(*(b.column(c).to_pylist() for c in ("cluster", "part", "visits", "node", "root", "text"))):
                if at != key:
                    if living and held is None:
                        out += settled()[1]
                    key, living, held = at, [], None
                if not visits:
                    living.append((node, root, marks(text or "", size)))
                    continue
                if held is None:
                    held, links_ = settled()
                    out += links_
                out += held.visited(node, root, marks(text or "", size))
            yield {"a": [a for a, _ in out], "b": [b for _, b in out]}
        if living and held is None:
            out = settled()[1]
            yield {"a": [a for a, _ in out], "b": [b for _, b in out]}

    found = stage.save(map_arrow(dealt, run, "a bigint, b bigint"), f"similar-{name}")
    for done in (f"wanted-{name}", f"parts-{name}"):
        stage.drop(done)
    return found


def _linked(stage: Stage, points: DataFrame) -> DataFrame:
    """Pairs (a, b) of points with equal or linked fingerprints: fewer than there are points."""
    first = stage.save(points.groupBy("print").agg(F.min("node").alias("least")), "prints")
    same = points.select("node", "print").join(first, "print").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    of_a, of_b = (first.select(F.col("print").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
    apart = links(Stage(points.sparkSession, "links"), first.select("print"), LINK).join(of_a, "a").join(of_b, "b")
    return same.unionByName(apart.select(*_pair(F.col("least_a"), F.col("least_b"))))


def _apart(wide: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the wide parities of points x and y differ, as _differing. wide: all numbers, where each point's begin, and how many it has."""
    flat, start, size = wide
    out = np.zeros(len(x), np.int64)
    least, most = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
    for w, v in set(zip(least.tolist(), most.tolist())):
        these = np.flatnonzero((least == w) & (most == v))
        step = max(1, BLOCK // v)
        for i in range(0, len(these), step):
            at = these[i : i + step]
            low = np.where(size[x[at]] == w, x[at], y[at])
            high = x[at] + y[at] - low
            bits = flat[start[high][:, None] + np.arange(v)].reshape(len(at), -1, w)
            out[at] = np.bitwise_count(np.bitwise_xor.reduce(bits, axis=1) ^ flat[start[low][:, None] + np.arange(w)]).sum(1, dtype=np.int64)
    return out


def _narrow(wide: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The parities in WORDS numbers, from wide ones."""
    flat, start, size = wide
    out = np.zeros((len(size), WORDS), flat.dtype)
    for w in np.unique(size).tolist():
        these = np.flatnonzero(size == w)
        step = max(1, BLOCK // w)
        for i in range(0, len(these), step):
            at = these[i : i + step]
            out[at] = np.bitwise_xor.reduce(flat[start[at][:, None] + np.arange(w)].reshape(len(at), -1, WORDS), axis=1)
    return out


def compared(node: np.ndarray, n: np.ndarray, root: np.ndarray, bits: np.ndarray, lives: np.ndarray, every: bool, wide: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket's points, at least one of which lives there, that may be similar and have different roots: all, or a forest that joins the same points."""
    found, roots, bits = ([], []), np.unique(root, return_inverse=True)[1], bits.view(np.uint64)
    label = np.arange(len(node))
    home = np.flatnonzero(lives)
    i, step = 0, 8  # the first ones join most of a group
    while i < len(home):
        part = home[i : i + max(1, min(step, BLOCK // len(node)))]
        i, step = i + len(part), 2 * step
        fits = roots[part][:, None] != roots[None, :]
        if not every:
            fits &= label[part][:, None] != label[None, :]
        fits &= (5 * n[part][:, None] >= 4 * n[None, :]) & (5 * n[None, :] >= 4 * n[part][:, None])
        x, y = np.nonzero(fits)
        x = part[x]
        once = ~lives[y] | (node[x] < node[y])
        x, y = x[once], y[once]
        near = 9 * np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= n[x] + n[y]
        x, y = x[near], y[near]
        if wide is not None and len(x):
            near = 9 * _apart(wide, x, y) <= n[x] + n[y]
            x, y = x[near], y[near]
        if not every and len(x):
            low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            first = np.unique(low * len(label) + high, return_index=True)[1]
            chosen = []
            for k in first.tolist():
                a, b = int(low[k]), int(high[k])
                while label[a] != a:
                    a = int(label[a])
                while label[b] != b:
                    b = int(label[b])
                if a != b:
                    label[max(a, b)] = min(a, b)
                    chosen.append(k)
            while (label[label] != label).any():
                label = label[label]
            x, y = x[chosen], y[chosen]
        found[0].append(np.minimum(node[x], node[y]))
        found[1].append(np.maximum(node[x], node[y]))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found[0] or none), np.concatenate(found[1] or none)


def _candidates(stage: Stage, name: str, placed: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b), a below b, of points in the same bucket that join all its candidates; see compared."""
    crowds = stage.save(placed.groupBy("mark").count().filter(F.col("count") > CROWD).select("mark", F.ceil(F.col("count") / CROWD).cast("int").alias("parts")), f"crowds-{name}")
    dealt = placed.join(points.select("node", "wide"), "node").join(crowds, "mark", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    home = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    # a point lives in one part of its bucket and visits the parts after it
    dealt = dealt.withColumn("part", F.explode(F.sequence(home, F.col("parts") - 1))).withColumn("lives", F.col("part") == home)
    dealt = dealt.select("mark", "part", "node", "n", "root", "wide", "lives").repartition(shuffle_width(placed.sparkSession), "mark", "part").sortWithinPartitions("mark", "part")

    def run(batches):
        held = None

        def pairs(rows: pa.Table):
            mark, part, node, n, root, lives = (rows.column(c).to_numpy() for c in ("mark", "part", "node", "n", "root", "lives"))
            flat = np.concatenate([c.flatten().to_numpy() for c in rows.column("wide").chunks]).view(np.uint64)
            size = np.concatenate([pc.list_value_length(c).to_numpy() for c in rows.column("wide").chunks]).astype(np.int64)
            start = np.cumsum(size) - size
            cut = np.flatnonzero(np.r_[True, (mark[1:] != mark[:-1]) | (part[1:] != part[:-1])])
            ends = np.r_[cut[1:], len(mark)]
            out = ([], [])
            bits = _narrow((flat, start, size))
            for i, j in zip(cut.tolist(), ends.tolist()):
                if j - i > 1:
                    for side, found in zip(out, compared(node[i:j], n[i:j].astype(np.int64), root[i:j], bits[i:j], lives[i:j], False, (flat, start[i:j], size[i:j]))):
                        side.append(found)
            none = [np.zeros(0, np.int64)]
            return {"a": np.concatenate(out[0] or none), "b": np.concatenate(out[1] or none)}

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            mark, part = rows.column("mark").to_numpy(), rows.column("part").to_numpy()
            same = (mark == mark[-1]) & (part == part[-1])
            last = len(mark) - int(same.sum())  # the last bucket can go on
            if last:
                yield pairs(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield pairs(held)

    return map_arrow(dealt, run, "a bigint, b bigint").distinct()


def groups(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """KEY, keep for each row of docs whose group has other rows: the least id of the group (null after all others) and its text's hashes.

    A group is joined by pairs of similarity of at least 0.8. Null texts and texts without words are equal. Repeated
    rows and ids each give their own row. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "copies")
    docs = texts(docs)
    docs = docs.select("text", *[c.alias(k) for c, k in zip(_key(docs), KEY)])
    listed, rank = _common(docs, size)

    def run(batches):
        for b in slices(batches, "text"):
            sets = [marks(t or "", size) for t in b.column("text").to_pylist()]
            yield {**{c: b.column(c) for c in KEY}, "set": [xxhash.xxh128_digest(s.tobytes()) for s in sets], "n": list(map(len, sets)), "print": [majority(s) for s in sets], "wide": [parity(s, width(len(s))) for s in sets], "prefix": [prefix(s, listed, rank) for s in sets]}

    rows = stage.save(map_arrow(docs, run, "doc_id bigint, hash_1 bigint, hash_2 bigint, set binary, n int, print bigint, wide array<bigint>, prefix array<bigint>"), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), *KEY)
    # rows of a set have the same prefix, parities and fingerprint
    points = rows.groupBy("set").agg(F.min(F.struct(order.alias("first"), "n", "print", "wide", "prefix")).alias("p"), F.count(F.lit(1)).alias("rows"))
    points = stage.save(points.select(F.monotonically_increasing_id().alias("node"), "set", "p.first", "p.n", "p.print", "p.wide", "p.prefix", "rows"), "whole-points")
    prefixes, points = points.select("node", "n", "prefix"), stage.save(points.drop("prefix"), "points")
    rows = stage.save(rows.select(*KEY, "set"), "sets")
    stage.drop("rows")
    tried = stage.save(_near(_linked(stage, points), points), "pairs-trees")
    edges = _verified(stage, "trees", tried, None, points, docs, size)
    roots = components(Stage(spark, "copies-roots"), edges)
    placed = prefixes.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), F.explode("prefix").alias("mark"))
    # marks whose points are in several components
    open_ = placed.groupBy("mark").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("mark")
    placed = stage.save(placed.join(stage.save(open_, "open"), "mark", "left_semi"), "placed-trees")
    stage.drop("whole-points")
    shape = placed.groupBy("mark").agg(F.count(F.lit(1)).alias("points"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"))
    one = stage.save(shape.groupBy("points", "sum", "xor").agg(F.min("mark").alias("mark")).select("mark"), "buckets")
    placed = stage.save(placed.join(one, "mark", "left_semi"), "placed")
    stage.drop("placed-trees")
    pairs = stage.save(_candidates(stage, "buckets", placed, points), "pairs-buckets")
    stage.drop("placed")
    edges = edges.unionByName(_verified(stage, "buckets", pairs, roots, points, docs, size))
    found = components(Stage(spark, "copies-found"), edges)

    kept = points.select("node", "set", "first", "rows").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = kept.groupBy("root").agg(F.min("first").alias("keep"), F.sum("rows").alias("all")).filter("all > 1")
    kept = stage.save(kept.join(least, "root").select("set", "keep"), "kept")
    return stage.save(rows.select(*KEY, "set").join(kept, "set").select(*KEY, "keep"), "groups")


def distinct(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs with exactly one row of each group, that of the least id (null after all others), of equal ids the one of the least hash."""
    found = groups(docs, size)
    same = F.struct(*KEY).eqNullSafe(F.struct(*[F.col("keep")[c] for c in KEY]))

    def met(rows: DataFrame) -> list[Column]:
        return [c.eqNullSafe(rows[k]) for c, k in zip(_key(docs), KEY)]

    gone = found.filter(~same).select(KEY).distinct()
    left = docs.join(gone, met(gone), "left_anti")
    twins = found.filter(same).groupBy(KEY).count().filter("count > 1").select(KEY)
    if twins.isEmpty():
        return left
    return left.join(twins, met(twins), "left_anti").unionByName(docs.join(twins, met(twins), "left_semi").dropDuplicates(["doc_id", "text"]))
