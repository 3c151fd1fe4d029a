"""Cases that once went wrong, odd tables, and held-out figures on the labels of the data."""

import os
import random
import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
from test_operators import empty, frame, got

from lodestone.llm import common, contamination, phrases, pieces, quality, runindex, tokencount, toxicity

#: Two beginnings of equal size whose polynomial hashes modulo 2 ** 64 are equal, and what follows both.
HEADS = ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "aaabaabbaaabbababbbabababbbbbbabbbbbaaababaabbaabaaaabbbbbaaaaaaabaaabbabaaaabbabb")
TAIL = "aaaaaayczrwgwdlpgzycxxsqwqggliawkmhjhkabsawqmlsywfeythdkbdxuvkjrzahhgdpodkfzxbxoopttuhmjhghiipckwqdfwvedgdlosnthsajecgtrlxprrpsxswfclxlqbyyoompzdlamiprszenrlxbuzeacjjyhympimwrdktltjhromrpoatrnobrjhuqouokdmuygpqsrugjltvtzstghtqsyviedsrvnlvvdqwsabokcubvqhnrutnijmacuatgzmgtdsctughanhzrtwd"


def test_strings_of_equal_hash_are_not_equal(spark):
    rows = [(i, head + TAIL) for i, head in enumerate(HEADS)]
    names = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    want = sorted(plain.repeated_bytes(rows), key=repr)
    assert [w[2] for w in want] == [len(TAIL)] * 2
    for hot in (2000, 0):
        assert got(runindex.digests(frame(spark, rows), hot=hot), *names) == want
    # the same as words: the beginnings are one word each, then as one of twenty
    words = [(i, " ".join([head, *"abcdefghijklmnopqrstuvwxyz"])) for i, head in enumerate(HEADS)]
    names = "doc_id", "n_words", "n_removed", "kept_sha256"
    for hot in (2000, 0):
        assert got(phrases.digests(frame(spark, words), hot=hot), *names) == sorted(plain.later_phrases(words), key=repr)
    items = spark.createDataFrame([(i, t) for i, t in words[:1]], "item_id bigint, text string")
    names = "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    assert got(contamination.digests(frame(spark, words), items), *names) == sorted(plain.leaks(words, words[:1]), key=repr)


@pytest.mark.parametrize("window", [20, 100])
def test_wide_windows(spark, window):
    rnd = random.Random(window)
    base = [str(rnd.randrange(50)) for _ in range(400)]
    rows = [(i, " ".join(base[rnd.randrange(100) : 250 + rnd.randrange(150)])) for i in range(12)]
    names = "doc_id", "n_words", "n_removed", "kept_sha256"
    assert got(phrases.digests(frame(spark, rows), window), *names) == sorted(plain.later_phrases(rows, window), key=repr)


def test_clashing_names_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = frame(spark, [(1, text), (1, text), (2, text + " end"), (3, None)]).selectExpr("*", "1 AS _flag", "2 AS __flag", "'n' AS _none", "3 AS `a.b`", "4 AS rid", "5 AS marks", "6 AS mix")
    items = spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9 w10")], "item_id bigint, text string")
    for made in (phrases.clean(docs), contamination.clean(docs, items)):
        assert made.columns == docs.columns
        left = made.collect()
        assert all((r["_flag"], r["__flag"], r["_none"], r["a.b"], r["rid"], r["marks"], r["mix"]) == (1, 2, "n", 3, 4, 5, 6) for r in left)
        assert sorted(r.doc_id for r in left) == [1, 1, 2, 3] and [r.text for r in left if r.doc_id == 3] == [None]


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [(1, "Some words, twice."), (1, "Some words, twice."), (None, "Some words, twice."), (None, None), (4, "")]
    piece, byte = public_tokenizers.path(pieces.MODEL), public_tokenizers.path(tokencount.TOKENIZER)
    for run in (lambda d: pieces.piece_digests(d, piece), lambda d: tokencount.token_counts(d, byte)):
        found = run(frame(spark, rows)).collect()
        assert len(found) == 5 and len({tuple(r)[1:] for r in found}) == 2
        assert run(empty(spark)).collect() == []
    items = spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    assert sorted(r.n_hit for r in contamination.digests(frame(spark, rows), items).collect()) == [0, 0, 2, 2, 2]


def test_a_text_longer_than_any_slice(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghij", k=7)) for _ in range(400_000)]
    long = " ".join(words)  # 3.2 MB
    rows = [(1, long), (2, " ".join(words[200_000:200_050])), (3, "short")]
    assert got(phrases.digests(frame(spark, rows)), "doc_id", "n_removed") == [(1, 0), (2, 50), (3, 0)]
    found = got(runindex.digests(frame(spark, rows)), "doc_id", "n_removed")
    size = len(rows[1][1])
    assert found == [(1, size), (2, size), (3, 0)]


def test_runs_expand_to_the_transform():
    rnd = random.Random(7)
    texts = [bytes(rnd.choices(b"ab", k=rnd.randint(1, 30))) for _ in range(12)]
    index = runindex.RunIndex(texts)
    rows = sorted((t[i:], k, i) for k, t in enumerate(texts) for i in range(len(t) + 1))
    want = [texts[k][i - 1] + 1 if i else 0 for _, k, i in rows]
    got_ = np.repeat(index.runs, index.length).tolist()
    # suffixes that are equal to their ends stand in any order, so only the symbols of each such group are compared
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end][0] == rows[at][0]:
            end += 1
        assert sorted(got_[at:end]) == sorted(want[at:end])
        at = end


def held_out(spark, folder, module, label, of, part):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in module.score(docs.repartition(8), module.train(docs, labels)).collect()}
    return [(found[r.doc_id], r[label]) for r in labels.collect() if r[label] is not None and zlib.crc32(str(r.doc_id).encode()) % of == part]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no data")
def test_held_out_toxic_rows_are_found(spark):
    rows = held_out(spark, "/root/testdata/sf0.1", toxicity, "toxic", 3, 1)
    hit = sum(r.predicted for r, y in rows if y)
    assert hit >= 0.9 * sum(y for _, y in rows) and hit >= 0.9 * sum(r.predicted for r, _ in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no data")
def test_held_out_quality(spark):
    rows = held_out(spark, "/root/testdata/sf0.1", quality, "quality", 5, 0)
    good, bad = ([r.score for r, y in rows if y == v] for v in (1, 0))
    assert np.mean([[(a > b) + (a == b) / 2 for b in bad] for a in good]) > 0.99
    assert sum(r.predicted for r, y in rows if y) >= 0.95 * len(good)
    print(sum(r.predicted for r, y in rows if not y), len(bad))


def test_batches_are_bounded_by_bytes(spark):
    spark.conf.unset(common.BATCH_BYTES)
    try:
        rows = spark.range(40).selectExpr("id AS doc_id", "repeat('x', 1 << 20) AS text").coalesce(1)
        sizes = [r.n for r in common.map_arrow(rows, lambda batches: ({"n": [b.num_rows]} for b in batches), "n int").collect()]
        assert sum(sizes) == 40 and max(sizes) <= 10
        spark.conf.set(common.BATCH_BYTES, "64m")
        common.bounded(spark)
        assert spark.conf.get(common.BATCH_BYTES) == "64m"  # the session's own bound stays
    finally:
        spark.conf.unset(common.BATCH_BYTES)
