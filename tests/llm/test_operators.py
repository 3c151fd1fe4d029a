import random
import zlib
from itertools import combinations

import numpy as np
import plain
import public_tokenizers
import pytest

from lodestone.llm import contamination, fingerprint, neardup, phrases, pieces, quality, runindex, sharding, tokencount, toxicity

SYLLABLES = "the an ti on re er ou ing Ma vé ß 漢 x9 , . -".split(" ")


def corpus(seed=1, n=60):
    """Invented texts: near and exact copies, shared passages, repeats inside a text, empty, blank and one long text."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices(SYLLABLES, k=rnd.randint(1, 3)))
    prose = lambda k: [word() for _ in range(k)]
    shared = [prose(45) for _ in range(3)]
    texts = []
    for i in range(n):
        w = prose(rnd.randint(0, 160))
        if i % 3 == 0:
            at = rnd.randint(0, len(w))
            w[at:at] = rnd.choice(shared)
        if i % 11 == 0:
            w += w[:60]
        texts.append(rnd.choice([" ", "\n", "  "]).join(w))
    texts += [texts[5], texts[5], texts[6] + " more", " ".join(texts[7].split()[:-1] + ["other"])]
    texts += ["", None, " \t\n", "one", "two words", "ab " * 150, " ".join(prose(9000)), "x" * 5000, "x" * 5000]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return [(10 * i + 3, texts[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows, extra=True):
    """With columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    return df.selectExpr("*", "doc_id AS key", "'x' AS row", "1 AS start", "text AS kept", "2 AS score", "cast(null AS string) AS hit") if extra else df


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def test_near_duplicates(spark, rows):
    names = "doc_id", "fingerprint", "component_id"
    assert got(neardup.near_duplicates(frame(spark, rows)), *names) == sorted(plain.components(rows), key=repr)
    assert neardup.near_duplicates(empty(spark)).collect() == []
    twice = neardup.near_duplicates(frame(spark, [(4, "a b"), (4, "a b"), (None, "a b"), (None, "q r s t")])).collect()
    assert sorted(str(r.component_id) for r in twice) == ["4", "4", "4", "None"]


def test_vantage_point_shards_lose_no_pair():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 150, dtype=np.uint64)
    flips = (np.uint64(1) << rnd.integers(0, 64, (3, 1500)).astype(np.uint64))
    points = np.unique(np.concatenate([base, np.bitwise_xor.reduce(flips, 0) ^ rnd.choice(base, 1500)]))
    close = {(int(a), int(b)) for a, b in combinations(points.tolist(), 2) if (a ^ b).bit_count() <= 3}
    met = set()
    for side, half in enumerate(neardup._halves(points)):
        tree = neardup.Tree(half[::3], 16)
        at, leaf, lives = tree.route(half, 1)
        assert tree.leaves > 8 and lives.sum() == len(points)
        for k in range(tree.leaves):
            home, all_ = set(at[(leaf == k) & lives].tolist()), at[leaf == k].tolist()
            met |= {(int(points[min(x, y)]), int(points[max(x, y)])) for x in home for y in all_}
    assert close and close <= met


def test_components_of_a_long_chain(spark):
    from lodestone.llm.common import Stage

    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    found = {r.node: r.root for r in neardup.components(Stage(spark, "test"), edges).collect()}
    assert found == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeated_bytes(spark, rows, hot):
    names = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    assert got(runindex.digests(frame(spark, rows), hot=hot), *names) == sorted(plain.repeated_bytes(rows), key=repr)


def test_repeated_bytes_of_odd_tables(spark):
    assert runindex.digests(empty(spark)).collect() == []
    long = "".join(random.Random(2).choices("abcdé", k=300))
    both = runindex.digests(frame(spark, [(1, long), (1, long), (None, "short")])).collect()
    assert sorted((r.n_removed, r.n_bytes) for r in both) == [(0, 5)] + [(len(long.encode()),) * 2] * 2


def test_run_index_against_all_substrings():
    rnd = random.Random(5)
    for _ in range(30):
        parts = ["".join(rnd.choices("ab", k=rnd.randint(1, 12))) for _ in range(4)]
        texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 6))).encode() for _ in range(rnd.randint(1, 8))]
        index = runindex.RunIndex(texts)
        assert len(index.runs) <= sum(map(len, texts)) + len(texts)
        for window in (4, 7, 13):
            want = plain.repeated_bytes(list(enumerate(t.decode() for t in texts)), window)
            spans = index.covered(window)
            assert [sum(s[1::2]) - sum(s[::2]) for s in spans] == [w[2] for w in want]
            assert [len(s) // 2 for s in spans] == [w[3] for w in want]


@pytest.mark.parametrize("hot", [2000, 1])
def test_later_phrases(spark, rows, hot):
    names = "doc_id", "n_words", "n_removed", "kept_sha256"
    assert got(phrases.digests(frame(spark, rows), hot=hot), *names) == sorted(plain.later_phrases(rows), key=repr)


def test_phrases_clean_keeps_columns_and_untouched_texts(spark, rows):
    docs = frame(spark, rows)
    cleaned = phrases.clean(docs)
    assert cleaned.columns == docs.columns
    kept = {r.doc_id: r for r in cleaned.collect()}
    for i, _, gone, _ in plain.later_phrases(rows):
        if not gone:
            assert kept[i].text == dict(rows)[i] and kept[i].key == i
    assert phrases.clean(empty(spark)).collect() == []


def test_leaks(spark, rows):
    words = [plain.TERM.findall(plain.lower(t)) for _, t in rows if t]
    items = [(1, " ".join(words[3][2:30])), (2, ", ".join(words[8][:9]).upper()), (10, "one"), (11, "two, WORDS"), (12, ""), (13, None), (14, " ".join(words[3][4:12])), (None, "one"), (15, "ab ab ab"), (15, "漢")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    names = "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    want = sorted(plain.leaks(rows, [i for i in items if i[0] is not None]), key=repr)
    assert got(contamination.digests(frame(spark, rows), benchmark), *names) == want
    assert got(contamination.digests(frame(spark, rows), benchmark, block_bytes=60), *names) == want
    assert contamination.digests(empty(spark), benchmark).collect() == []
    none = contamination.digests(frame(spark, rows), benchmark.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.n_hit for r in none)
    cleaned = {r.doc_id: r.text for r in contamination.clean(frame(spark, rows), benchmark).collect()}
    for i, _, hit, n, *_ in plain.leaks(rows, [i for i in items if i[0] is not None]):
        assert (i in cleaned) <= (n < 2) and (hit or cleaned[i] == dict(rows)[i])


def test_fm_index():
    rnd = np.random.default_rng(1)
    for _ in range(20):
        seq = rnd.integers(0, 5, rnd.integers(1, 60))
        index = contamination.FMIndex(seq)
        for size in (1, 2, 3):
            pattern = rnd.integers(1, 5, (1, size))
            low, high = index.search(np.concatenate([np.zeros((1, 1), np.int64), pattern], 1))
            want = [i for i in range(len(seq) - size + 1) if (seq[i : i + size] == pattern[0]).all()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_kernel_counts_weighted_common_subsequences():
    def weights(w):
        out = {}
        for p in combinations(range(len(w)), toxicity.ORDER):
            u = "".join(w[i] for i in p)
            out[u] = out.get(u, 0) + toxicity.DECAY ** (p[-1] - p[0] + 1)
        return out

    def kernel(a, b):
        x, y = weights(a), weights(b)
        return sum(v * y.get(u, 0) for u, v in x.items()) / max(1e-12, (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5)

    words, marks = ["moron", "mo.r.o.n", "aaaa", "lolol", "zq", "", "disgusting"], ["moron", "lolo", "disgust"]
    want = [[kernel(a, b) if len(a) > 2 else 0 for b in marks] for a in words]
    assert np.allclose(toxicity.Landmarks(marks).kernels(words), want, atol=1e-5)
    assert toxicity.Landmarks(["moron"]).kernels(["m0ro-n"])[0, 0] > toxicity.Landmarks(["moron"]).kernels(["monument"])[0, 0]


def labelled(seed, bad):
    rnd = random.Random(seed)
    out = []
    for i in range(400):
        w = ["".join(rnd.choices(["th", "er", "on", "is", "at", "ly"], k=rnd.randint(1, 4))) for _ in range(rnd.randint(20, 60))]
        mark = i % 4 == 0
        out.append((i, bad(rnd, w) if mark else " ".join(w), int(mark)))
    return out


def test_toxicity_on_held_out_rows(spark):
    def insult(rnd, w):
        for _ in range(3):
            w.insert(rnd.randint(0, len(w)), rnd.choice(["gromuk", "gro-muk", "Vaxpib!", "vaxxpib"]))
        return " ".join(w)

    data = labelled(3, insult)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(1000, None), (1001, ""), (None, "gromuk")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(5000, None)], "doc_id bigint, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(found) == 403 and all(0 <= r.score <= 1 for r in found.values())
    held = [(found[i], y) for i, _, y in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(r.held_out and r.predicted == y for r, y in held)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).collect() == []


def test_quality_on_held_out_rows(spark):
    data = [(i, t, 1 - y) for i, t, y in labelled(4, lambda rnd, w: " ".join(x.upper() + "!!" for x in w))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(1000, None), (1001, ""), (None, "word")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    found = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [(found[i], y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(r.held_out and r.predicted == y for r, y in held)
    kept = {r.doc_id for r in quality.accept(docs, model).collect()}
    assert kept == {i for i, r in found.items() if r.predicted}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).collect() == []


def odd_texts(n=600):
    rnd = random.Random(6)
    parts = [" ", "  ", "\n", "\t", "▁", "a", "B", "é", "ß", "12", "'s", "'", "<|endoftext|>", "<s>", "😀", " ", "　", "\x00", "\x1c", "\x85", "!!", "ﬁ", "中文", "​", "\r\n", "don't", "②", "͸", "ⅷ"]
    return ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(n)]


def test_pieces_are_the_librarys(spark, rows):
    import sentencepiece

    path = public_tokenizers.path(pieces.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = rows + [(10_000 + i, t) for i, t in enumerate(odd_texts())]
    want = sorted(((i, len(ids), plain.sha(",".join(map(str, ids))), plain.sha(sp.decode(ids))) for i, t in docs for ids in [sp.encode(t or "")]), key=repr)
    assert got(pieces.piece_digests(frame(spark, docs), path, max_entries=300), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(frame(spark, rows), path), path).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_token_counts_are_the_librarys(spark, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokencount.TOKENIZER)
    library = Tokenizer.from_file(path)
    docs = rows + [(10_000 + i, t) for i, t in enumerate(odd_texts())]
    want = sorted(((i, len((t or "").encode()), n, n > 1024) for i, t in docs for n in [len(library.encode(t or "", add_special_tokens=False).ids)]), key=repr)
    assert got(tokencount.token_counts(frame(spark, docs), path, max_entries=300), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


@pytest.mark.parametrize("partitions", [1, 7])
def test_fingerprints(spark, rows, partitions):
    ordered = sorted(rows)
    want = []
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        t, after = t or "", after or ""
        other = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        marks = [fingerprint.digest(x.encode()) for x in (t, other, after)]
        want.append((i, len(t), plain.sha(other), marks[0], marks[1], fingerprint.likeness(*marks[:2]), fingerprint.likeness(marks[0], marks[2])))
    names = "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    found = got(fingerprint.fingerprints(frame(spark, rows), partitions), *names)
    assert found == sorted(want, key=repr) and all(0 <= x <= 1 for r in found for x in r[5:])
    assert fingerprint.fingerprints(empty(spark)).collect() == []
    assert [r.near_next for r in fingerprint.fingerprints(frame(spark, [(None, "ab"), (None, "ab"), (1, None)])).collect()].count(1.0) >= 1


def test_shards(spark, rows):
    docs = rows + [(9000 + i, "the same text") for i in range(50)] + [(9000, "the same text"), (None, "")]
    found = sharding.shard(frame(spark, docs)).collect()
    assert len(found) == len(docs)
    text = {i: t for i, t in docs}
    homes, slots, sizes = {}, {}, dict.fromkeys(range(40), 0)
    for r in found:
        t = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 16, zlib.crc32(t), "bytes", None) and 0 <= r.shard < 40
        homes.setdefault(t, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r.size
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty(spark)).collect() == []


def test_differencing_is_tight_and_gives_a_giant_its_own_shard():
    rnd = random.Random(9)
    weights = [rnd.randint(1, 5000) for _ in range(3000)]
    sums = [0] * 40
    for w, s in zip(weights, sharding.difference(weights, 40)):
        sums[s] += w
    assert max(sums) - min(sums) <= 5
    big = sharding.difference([10**9, *weights], 40)
    assert big.count(big[0]) == 1


def test_crowded_shards_are_parted_without_losing_a_pair(spark):
    from lodestone.llm.common import Stage

    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 2**63, 60, dtype=np.uint64)
    flips = np.uint64(1) << rnd.integers(0, 64, (3, 900)).astype(np.uint64)
    same_half = np.uint64(7) << np.uint64(32) | rnd.integers(0, 2**32, 200, dtype=np.uint64)  # no tree over this half parts them
    points = np.unique(np.concatenate([base, np.bitwise_xor.reduce(flips, 0) ^ rnd.choice(base, 900), same_half]))
    rows = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "print bigint").repartition(3)
    found = neardup.links(Stage(spark, "test"), rows, shard_size=16, shards=4, crowd=40).collect()
    label = {int(p): int(p) for p in points.view(np.int64)}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in found:
        label[max(root(r.a), root(r.b))] = min(root(r.a), root(r.b))
    want = {int(p): int(p) for p in points.view(np.int64)}
    for a, b in combinations(points.tolist(), 2):
        if (a ^ b).bit_count() <= 3:
            x, y = (int(np.uint64(v).view(np.int64)) for v in (a, b))
            old, new = max(want[x], want[y]), min(want[x], want[y])
            if old != new:
                want = {k: new if v == old else v for k, v in want.items()}
    assert {k: root(k) for k in label} == want
