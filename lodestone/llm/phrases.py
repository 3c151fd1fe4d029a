"""Substring dedup by repeated-phrase automata.

Passages of WINDOW words or more that may recur are compiled into Aho-Corasick automata, one for each shard of
co-located segments (see passages). All different segments of the shard's documents are streamed through the automaton,
which locates every occurrence of every phrase and so confirms it, or not. Of a phrase's occurrences all but the first
(smallest doc_id, then place) are removed. Words are single characters to the automaton, so phrases match whole words
only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import passages
from .common import Stage, map_arrow, rest, slices, table, unpacked, with_row
from .passages import SAME

WINDOW = 20
#: Words of the hashed grams that windows are anchored at.
GRAM = 8
#: Windows that a mask of a segment can hold.
MASK = 62
#: Bytes of text in a shard, and in an automaton.
SHARD_BYTES = 8 << 20
AUTOMATON_BYTES = 2 << 20


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    start, end, rows = passages.words_at(data, offsets, ~passages.SPACE)
    values = passages.span_hash(passages.prefix_hash(passages.BYTE_VALUES[data]), start, end)
    # the same words with one space after each
    size = end - start
    after = np.cumsum(size + 1)
    spaced = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    spaced[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[~passages.SPACE[data]]
    return values, rows, spaced, after - size - 1, after - 1


def suspects(said: list[str], times: list[int], window: int) -> list[str]:
    """Passages of the pieces that may recur, among them all that do; a hash alone decides, so some may not.

    A piece with copies, none of whose windows is seen anywhere else, is one passage; otherwise each window is one.
    """
    code = np.frombuffer("".join(said).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(s) for s in said], np.int64)
    n = size - window + 1
    piece = np.repeat(np.arange(len(said)), n)
    at = np.arange(len(piece)) + piece * (window - 1)
    prefix = passages.prefix_hash(passages.mix((code + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)))
    _, which, seen = np.unique(passages.span_hash(prefix, at, at + window), return_inverse=True, return_counts=True)
    weight = np.array(times, np.int64)
    elsewhere = np.bincount(piece, seen[which] > 1, minlength=len(said)) > 0
    out = [s for s, m, e in zip(said, times, elsewhere.tolist()) if m > 1 and not e]
    again = (np.bincount(which, weight[piece])[which] > 1) & elsewhere[piece]
    whole = "".join(said)
    out += {whole[a : a + window] for a in at[again].tolist()}
    return out


def repeats(pieces: list[tuple[tuple, int, list[bytes]]], window: int = WINDOW) -> list[int]:
    """For each piece (its place, how often it occurs, its words) a mask of the windows that also start earlier.

    A place is an ordered tuple whose last member counts words. Further occurrences of a piece come after the given
    place.
    """
    import ahocorasick

    letters: dict[bytes, str] = {}

    def letter(word: bytes) -> str:
        if word not in letters:
            n = len(letters) + 1
            letters[word] = chr(n if n < 0xD800 else n + 0x800)
        return letters[word]

    said = ["".join(map(letter, words)) for *_, words in pieces]
    phrases = suspects(said, [n for _, n, _ in pieces], window)
    masks = [0] * len(pieces)
    if not phrases:
        return masks
    automaton = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        automaton.add_word(p, i)
    automaton.make_automaton()
    found: list[list[tuple[int, int]]] = [[] for _ in phrases]
    for piece, s in enumerate(said):
        for end, phrase in automaton.iter(s):
            found[phrase].append((piece, end))
    for p, where in zip(phrases, found):
        if len(where) > 1:
            size = len(p)
            at = [(*pieces[piece][0][:-1], pieces[piece][0][-1] + end - size + 1) for piece, end in where]
            first = min(at)
            for (piece, end), place in zip(where, at):
                if first < place:
                    masks[piece] |= ((1 << (size - window + 1)) - 1) << (end - size + 1)
    return masks


def _place(doc_id, key: int, start: int) -> tuple:
    return doc_id is not None, doc_id or 0, key, start


_ORDER = ["doc_id", "key", "start"]


def _cut(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The representatives' words, joined by spaces."""
    fields = (*_ORDER, *SAME, "times", "hot")
    got = passages.with_text(rows, wanted.select("rid", *fields), "wanted")

    def run(batches):
        for b in slices(batches, "text"):
            out: dict[str, list] = {c: [] for c in (*fields, "words")}
            for text, want in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                words = text.encode().split()
                for w in want:
                    for c in fields:
                        out[c].append(w[c])
                    out["words"].append(b" ".join(words[w["start"] : w["start"] + w["size"]]))
            yield out

    return map_arrow(got, run, "doc_id bigint, key bigint, start int, anchor bigint, size int, digest_1 bigint, digest_2 bigint, times bigint, hot boolean, words binary")


_MASKS = "anchor bigint, size int, digest_1 bigint, digest_2 bigint, mask bigint"


def _by_automata(pieces: DataFrame, shards: int, window: int) -> DataFrame:
    def run(batches):
        rows: dict[tuple, tuple] = {}
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in (*SAME, *_ORDER, "times", "words"))):
                rows[r[:4]] = r
        todo, size = [], 0
        ordered = sorted(rows.values(), key=lambda r: r[:4])
        for i, r in enumerate(ordered):
            todo.append(r)
            size += len(r[8])
            if i + 1 == len(ordered) or size >= AUTOMATON_BYTES and ordered[i + 1][0] != r[0]:
                masks = repeats([(_place(*r[4:7]), r[7], r[8].split()) for r in todo], window)
                yield {**{c: [r[k] for r in todo] for k, c in enumerate(SAME)}, "mask": masks}
                todo, size = [], 0

    return map_arrow(pieces.repartition(shards, "anchor"), run, _MASKS)


def _by_windows(stage: Stage, pieces: DataFrame, window: int) -> DataFrame:
    """The same for anchors with too many different segments for one task: each window is dealt by its own content."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in (*SAME, "offset", "doc_id", "key", "place", "phrase")}
            for *same, doc_id, key, start, words in zip(*(b.column(c).to_pylist() for c in (*SAME, *_ORDER, "words"))):
                words = words.split()
                for i in range(len(words) - window + 1):
                    for c, x in zip(out, (*same, i, doc_id, key, start + i, passages.same_content(b" ".join(words[i : i + window])))):
                        out[c].append(x)
            yield out

    each = stage.save(map_arrow(pieces, run, "anchor bigint, size int, digest_1 bigint, digest_2 bigint, offset int, doc_id bigint, key bigint, place int, phrase binary"), "windows")
    first = stage.save(each.groupBy("phrase").agg(F.min(F.struct("doc_id", "key", "place")).alias("first")), "first")
    later = each.join(first, "phrase").withColumn("bit", F.when(F.struct("doc_id", "key", "place") > F.col("first"), F.expr("shiftleft(1L, offset)")).otherwise(F.lit(0).cast("bigint")))
    return later.groupBy(SAME).agg(F.bit_or("bit").alias("mask"))


def marks(stage: Stage, rows: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = passages.HOT) -> DataFrame:
    """rid and an array of (start, mask) for dealt rows with words to remove: bit o is the window at word start + o.

    Grams are longer for windows of so many words that a segment could have more of them than a mask holds.
    """
    gram = min(window, max(gram, window - MASK + 1))
    cand = passages.candidates(stage, rows, word_units, gram, window, "doc_id", "key")
    reps = passages.representatives(stage, cand, [*_ORDER, "rid"], hot)
    told = reps.agg(F.sum("size"), F.max(F.col("hot").cast("int"))).first()
    pieces = _cut(rows, reps)
    if told[1]:
        pieces = stage.save(pieces, "pieces")
    masks = _by_automata(pieces.filter("not hot"), max(1, (told[0] or 0) * 8 // SHARD_BYTES + 1), window)
    if told[1]:
        masks = masks.unionByName(_by_windows(stage, pieces.filter("hot"), window))
    masks = stage.save(masks, "masks")
    # a table of its own, so the join with a frequent segment's rows can be split
    known = stage.save(reps.join(masks, SAME).select(*SAME, "mask", F.struct(_ORDER).alias("first")), "known")
    every = F.expr(f"shiftleft(1L, size - {window - 1}) - 1")
    found = cand.join(known, SAME).withColumn("mask", F.when(F.struct(_ORDER).eqNullSafe(F.col("first")), F.col("mask")).otherwise(every)).filter("mask <> 0")
    return found.groupBy("rid").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))


def _removed(n: int, found: list[dict], window: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for m in found or ():
        mask, at = m["mask"], m["start"]
        while mask:  # runs of windows, lowest first
            low = (mask & -mask).bit_length() - 1
            run = ((mask >> low) + 1 & ~(mask >> low)).bit_length() - 1
            out[at + low : at + low + run - 1 + window] = True
            mask &= ~(((1 << run) - 1) << low)
    return out


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = passages.HOT) -> DataFrame:
    """The rows of docs with the columns kept (the remaining words joined by one space), n_words, n_removed, then others of docs in `row`.

    A null text has no words. Rows that share an id count as documents in order of a hash of their texts; equal rows
    are one document and have equal results. A null id sorts first. Columns besides doc_id and text come as they are within
    the struct `row`, so their names can't clash. An empty table gives an empty table. Texts shorter than a window lose
    nothing; very long ones go through one task each, whole.
    """
    row, _ = rest(docs, F.col("text").isNull())
    stage = Stage(docs.sparkSession, "phrases")
    rows = passages.dealt(stage, docs, F.xxhash64("doc_id", "text").alias("key"), row)
    joined = rows.join(marks(stage, rows, window, gram, hot), "rid", "left").select("doc_id", "text", "row", "marks")
    kind = with_row("doc_id bigint, text string, kept string, n_words bigint, n_removed bigint", joined.schema["row"])

    def run(batches):
        for b in slices(batches, "text"):
            kept, total, gone = [], [], []
            for text, m in zip(b.column("text").to_pylist(), b.column("marks").to_pylist()):
                words = text.encode().split()
                total.append(len(words))
                drop = _removed(len(words), m, window)
                gone.append(int(drop.sum()))
                kept.append(b" ".join([w for w, d in zip(words, drop.tolist()) if not d] if gone[-1] else words).decode())
            yield {"doc_id": b.column("doc_id"), "text": b.column("text"), "row": b.column("row"), "kept": kept, "n_words": total, "n_removed": gone}

    return map_arrow(joined, run, kind)


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = passages.HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""
    got = remove(docs.select("doc_id", "text"), window, gram, hot)
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without repeated passages, its columns in order; untouched texts stay as they are, rows left without words go."""
    _, null = rest(docs, F.lit(None))
    got = remove(docs, window).filter("n_removed = 0 or kept <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).when(~F.col("row").getField(null), F.col("text"))
    return unpacked(got, docs.schema, doc_id=F.col("doc_id"), text=text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = None  # windows over all words of a table: tested against a plain loop instead
