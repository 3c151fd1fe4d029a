import random

import numpy as np
import plain
from test_operators import frame

from lodestone.llm import copies


def shingles(text):
    words = plain.WORD.findall(plain.lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    """Places of rows by group, by comparing all pairs."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    out = {}
    for i, g in enumerate(group):
        out.setdefault(g, []).append(i)
    return list(out.values())


def edited(seed=4):
    """Texts of few to many words, copies of them with more and more words changed, chains of copies, common lines."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    line, out = [word() for _ in range(12)], []
    for _ in range(12):
        w = [word() for _ in range(rnd.choice([3, 6, 30, 120, 400]))] + line * rnd.randint(0, 1)
        for _ in range(9):
            out.append(" ".join(w))
            w = list(w)
            for _ in range(rnd.randint(0, 1 + len(w) // 40)):
                w[rnd.randrange(len(w))] = word()
    out += [" ".join(line), " ".join(line).upper(), "", None, "\t"]
    rnd.shuffle(out)
    return [(7 * i + 1, t) for i, t in enumerate(out)]


def test_groups_against_all_pairs(spark, monkeypatch):
    rows = edited()
    want = {i: min(rows[k][0] for k in g) for g in groups(rows) if len(g) > 1 for i in (rows[k][0] for k in g)}
    assert len(set(want.values())) > 5
    for common in (1, 10**6):  # whatever comes last in the order
        monkeypatch.setattr(copies, "COMMON", common)
        assert {r.doc_id: r.keep.doc_id for r in copies.groups(frame(spark, rows)).collect()} == want
    assert copies.groups(frame(spark, rows).limit(0)).collect() == []


def test_similar_sets_share_a_mark_of_their_prefixes():
    rnd = np.random.default_rng(2)
    listed = np.arange(0, 900, 3)
    rank = rnd.permutation(len(listed))
    for _ in range(3000):
        a = np.unique(rnd.integers(0, 900, rnd.integers(1, 60)))
        b = np.unique(np.r_[rnd.permutation(a)[: rnd.integers(4 * len(a) // 5, len(a) + 1)], rnd.integers(0, 900, rnd.integers(0, 5))])
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            assert 9 * sum(int(x ^ y).bit_count() for x, y in zip(copies.parity(a).view(np.uint64), copies.parity(b).view(np.uint64))) <= len(a) + len(b)
            assert set(copies.prefix(a, listed, rank)) & set(copies.prefix(b, listed, rank))


def test_pipeline_stage_drops_copies_beyond_three_bits(spark):
    import corpus_pipeline

    rows = edited(6)
    left = {r.doc_id for r in corpus_pipeline.distinct(spark, frame(spark, rows), "").collect()}
    assert left == {min(rows[k][0] for k in g) for g in groups(rows)}
    assert {c for _, _, c in plain.components(rows)} - left


def test_one_row_of_each_group_stays_where_ids_repeat(spark):
    import corpus_pipeline

    rnd = random.Random(9)
    a, b, c, d = (" ".join("".join(rnd.choices("abcdefgh", k=4)) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (2, a + " end"), (2, b), (1, a), (1, a + " more"), (None, a), (None, c), (None, c), (None, d), (3, d + " end"), (4, ""), (4, None), (None, "")]
    left = [(r.doc_id, r.text) for r in corpus_pipeline.distinct(spark, frame(spark, rows), "").collect()]
    assert len(left) == 5 and {(2, b), (None, c), (3, d + " end")} <= set(left)
    assert sum(i == 1 and t.startswith(a) for i, t in left) == 1 and sum(i == 4 for i, _ in left) == 1


def test_a_bucket_gives_a_forest_that_joins_what_all_pairs_join():
    rnd = np.random.default_rng(5)
    base = [np.unique(rnd.integers(-(2**62), 2**62, 200)) for _ in range(4)]
    sets = [np.unique(np.r_[rnd.permutation(base[i % 4])[: rnd.integers(150, 200)], rnd.integers(0, 2**62, rnd.integers(0, 20))]) for i in range(300)]
    node = rnd.permutation(300)
    n, bits = np.array(list(map(len, sets))), np.array(list(map(copies.parity, sets)))
    both = []
    for every in (True, False):
        pairs = set()
        for part in range(2):  # a crowded bucket dealt to two tasks
            lives, here = node % 2 == part, (node % 2 == part) | (part == 1)
            a, b = copies.compared(node[here], n[here], node[here], bits[here], lives[here], every)
            pairs |= set(zip(a.tolist(), b.tolist()))
        label = list(range(300))
        for x, y in pairs:
            if label[x] != label[y]:
                old, new = label[x], label[y]
                label = [new if v == old else v for v in label]
        both.append((len(pairs), {frozenset(i for i in range(300) if label[i] == v) for v in set(label)}))
    assert both[0][1] == both[1][1] and both[1][0] < 600 < both[0][0]


def test_wide_parities_never_differ_more_than_their_sets(spark):
    rnd = np.random.default_rng(8)
    rows = []
    for n in (1, 3, 511, 512, 513, 600, 1000, 1024, 1025, 1100, 5000):
        a = np.unique(rnd.integers(-(2**62), 2**62, n))
        for kept in (1.0, 0.9, 0.5, 0.0):
            b = np.unique(np.r_[a[: int(len(a) * kept)], rnd.integers(-(2**62), 2**62, max(1, int(n * (1 - kept) * rnd.uniform(0.8, 1.2))))])
            if 5 * len(a) >= 4 * len(b) and 5 * len(b) >= 4 * len(a):
                rows.append((len(rows), len(np.setxor1d(a, b)), len(a) + len(b), *(copies.parity(s, copies.width(len(s))).tolist() for s in (a, b))))
    found = spark.createDataFrame(rows, "i int, apart int, sizes int, a array<bigint>, b array<bigint>")
    bits = {r.i: (r.bits, r.back) for r in found.select("i", copies._differing(found.a, found.b).alias("bits"), copies._differing(found.b, found.a).alias("back")).collect()}
    assert len({len(r[3]) for r in rows}) > 3 and any(len(r[3]) != len(r[4]) for r in rows)
    for i, apart, sizes, *_ in rows:
        assert bits[i][0] == bits[i][1] <= apart and (apart - bits[i][0]) % 2 == 0
        assert sizes < 1000 or apart < sizes // 3 or 9 * bits[i][0] > sizes  # sets that share half or less are told apart


def alike(seed=3, groups_=3, members=14, words=600):
    """Groups of texts that share most words, any two too few to be similar by themselves, and some real copies among them."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    out = []
    for _ in range(groups_):
        base = [word() for _ in range(words)]
        for k in range(members):
            own = list(base)
            for at in range(6 + 6 * k, words - 6, 6 * members):
                own[at] = word()
            out.append(" ".join(own))
            if k % 7 == 0:
                out.append(" ".join([*own, word()]))
    rnd.shuffle(out)
    return [(i + 1, t) for i, t in enumerate(out)]


def test_buckets_and_clusters_never_make_more_rows_than_they_get(spark, monkeypatch):
    rows, told, plainly = alike(), [], copies.map_arrow

    def counted(df, run, schema):
        out = plainly(df, run, schema)
        if schema == "a bigint, b bigint":
            told.append((df.count(), out.count()))
        return out

    want = {rows[i][0]: min(rows[k][0] for k in g) for g in groups(rows) if len(g) > 1 for i in g}
    assert 10 <= len(want) and len(set(want.values())) > 5
    monkeypatch.setattr(copies, "map_arrow", counted)
    assert {r.doc_id: r.keep.doc_id for r in copies.groups(frame(spark, rows)).collect()} == want
    assert sum(made for _, made in told) and all(made <= got for got, made in told)


def test_large_clusters_and_buckets_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(copies, "CROWD", 7)
    monkeypatch.setattr(copies, "CLUSTER", 700)
    rows = edited(11) + [(10_000 + i, t) for i, t in alike(5, 1)]
    want = {rows[i][0]: min(rows[k][0] for k in g) for g in groups(rows) if len(g) > 1 for i in g}
    assert {r.doc_id: r.keep.doc_id for r in copies.groups(frame(spark, rows)).collect()} == want


def test_a_cluster_links_what_all_pairs_link():
    rnd = np.random.default_rng(3)
    base = [np.unique(rnd.integers(-(2**62), 2**62, 100)) for _ in range(5)]
    sets = [np.unique(np.r_[rnd.permutation(base[i % 5])[: rnd.integers(82, 100)], rnd.integers(0, 2**62, rnd.integers(0, 9))]) for i in range(120)]
    root = [i if i % 3 else i % 5 for i in range(120)]  # some are known to be joined
    here = copies.Cluster(list(range(80)), root[:80], sets[:80])
    found = here.links() + [p for i in range(80, 120) for p in here.visited(i, root[i], sets[i])]
    rest = copies.Cluster(list(range(80, 120)), root[80:], sets[80:])
    found += rest.links()
    assert copies.Cluster([], [], []).links() == [] and copies.Cluster([], [], []).visited(1, 1, sets[0]) == []

    def joined(pairs):
        label = list(range(120))
        for x, y in pairs:
            old, new = label[x], label[y]
            label = [new if v == old else v for v in label]
        return {frozenset(i for i in range(120) if label[i] == v) for v in set(label)}

    known = [(i, i % 5) for i in range(0, 120, 3)]
    every = [(i, j) for i in range(120) for j in range(i) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))]
    assert joined(found + known) == joined(every + known) and len(found) < 240 < len(every)
