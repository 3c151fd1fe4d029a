"""Benchmark decontamination by an FM-index per training shard.

A shard is a slice of a task's documents. Its words become numbers (0: in no benchmark item); stretches of numbered words
long enough for a window are indexed: suffix order, Burrows-Wheeler transform, its wavelet matrix for ranks, and every
SAMPLE-th suffix position. All windows are searched backward at once, located through the sampled positions, and their
words merged into removal spans. Words that no item has can be in no occurrence, so leaving them out loses nothing.

Words are numbered by a hash, so every occurrence is held against the window's own words before it counts.

Items are cut into overlapping parts and read by the driver in blocks of bounded size, one pass over the documents for
each; passes need no shuffle. After PASSES of them the rows are written, so no task ever holds more tables than that.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import passages
from .common import Stage, map_arrow, rest, slices, spread, table, unpacked, with_row

WINDOW = 8
#: A document with so many items is contaminated.
ITEMS = 2
SAMPLE = 4
#: Bytes of benchmark text that are searched in one pass.
BLOCK_BYTES = 4 << 20
#: Bytes of an item's part, about.
PART_BYTES = 1 << 16
#: Passes in one stage.
PASSES = 8

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of lower-cased bytes, its hash, and rows' offsets in words."""
    start, end, rows = passages.words_at(data, offsets, INSIDE)
    return start, end, passages.span_hash(passages.prefix_hash(passages.BYTE_VALUES[data]), start, end), rows


class Phrases:
    """The distinct windows of some items: as words, and as patterns over their words' hashes numbered from 1."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        number: dict[int, int] = {}
        pattern: dict[tuple[int, ...], int] = {}
        self.place: dict[tuple[bytes, ...], int] = {}
        of: list[set[int]] = []
        self.items = sorted({i for i, _ in items})
        item_at = {i: k for k, i in enumerate(self.items)}
        for item, text in items:
            data = LOWER[np.frombuffer(text.encode(), np.uint8)]
            start, end, code, _ = words_of(data, np.array([0, len(data)]))
            raw = data.tobytes()
            ids = [number.setdefault(c, len(number) + 1) for c in code.tolist()]
            words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                pattern.setdefault(tuple(ids[i : i + window]), len(pattern))
                at = self.place.setdefault(tuple(words[i : i + window]), len(of))
                if at == len(of):
                    of.append(set())
                of[at].add(item_at[item])
        self.of = [sorted(x) for x in of]
        self.codes = np.array(sorted(number), np.uint64)
        self.numbers = np.array([number[c] for c in sorted(number)], np.int32)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.codes >> np.uint64(48)).astype(np.int64)] = True
        self.length = np.array([len(w) for w in self.place], np.int64)
        self.sizes = np.array([len(w) for w in pattern], np.int64)
        self.shortest = int(self.length.min()) if of else 0
        # patterns flush right, as the search goes backward
        self.patterns = np.zeros((len(pattern), window), np.int64)
        for k, w in enumerate(pattern):
            self.patterns[k, window - len(w) :] = w

    def number(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code), np.int64)
        if len(self.codes):
            at = np.flatnonzero(self.maybe[(code >> np.uint64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
            out[at] = np.where(self.codes[place] == code[at], self.numbers[place], 0)
        return out


class FMIndex:
    """A sequence of numbers below 2 ** bits; searches many patterns at once."""

    def __init__(self, sequence: np.ndarray, sample: int = SAMPLE):
        n = len(sequence)
        self.bits = max(1, int(sequence.max()).bit_length()) if n else 1
        _, rank = np.unique(sequence, return_inverse=True)
        rank, h = rank.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while n and rank[order[-1]] < n - 1:
            after = np.zeros(n, np.int64)
            after[: n - h] = rank[h:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
            h *= 2
        # row 0 is the end of the sequence, which sorts before all others; its symbol there is number 0
        self.rows = np.r_[n, order]
        last = np.where(self.rows > 0, sequence[self.rows - 1] if n else 0, -1)
        self.end_row = int(np.flatnonzero(last < 0)[0])
        last = np.maximum(last, 0)
        self.below = np.r_[0, np.cumsum(np.bincount(sequence, minlength=1 << self.bits))] + 1
        self.ones, self.zeros = [], []
        level = last.astype(np.int64)
        for bit in reversed(range(self.bits)):
            set_ = (level >> bit & 1).astype(bool)
            self.ones.append(np.r_[0, np.cumsum(set_)])
            self.zeros.append(int(len(level) - set_.sum()))
            level = np.r_[level[~set_], level[set_]]
        marked = self.rows % sample == 0
        self.marked, self.before = marked, np.cumsum(marked) - marked
        self.sampled = self.rows[marked]
        del self.rows

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform's first `at` rows."""
        begin = np.zeros_like(at)
        end = at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            b, e = ones[begin], ones[end]
            begin, end = np.where(up, zeros + b, begin - b), np.where(up, zeros + e, end - e)
        # the row of the sequence's start holds no symbol; it stands as 0 in the matrix
        return end - begin - ((symbol == 0) & (at > self.end_row))

    def _symbol(self, row: np.ndarray) -> np.ndarray:
        out = np.zeros_like(row)
        for ones, zeros in zip(self.ones, self.zeros):
            up = ones[row + 1] > ones[row]
            out = out << 1 | up
            row = np.where(up, zeros + ones[row], row - ones[row])
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 row of each pattern's suffixes; patterns are flush right, 0 in front."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.marked), np.int64)
        for j in reversed(range(patterns.shape[1])):
            at = np.flatnonzero((patterns[:, j] > 0) & (low < high))
            c = patterns[at, j]
            known = c < 1 << self.bits
            high[at[~known]] = low[at[~known]]
            at, c = at[known], c[known]
            low[at], high[at] = self.below[c] + self._rank(c, low[at]), self.below[c] + self._rank(c, high[at])
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        out = np.zeros(len(row), np.int64)
        todo, steps = np.arange(len(row)), 0
        while len(todo):
            done = self.marked[row]
            out[todo[done]] = self.sampled[self.before[row[done]]] + steps
            todo, row = todo[~done], row[~done]
            c = self._symbol(row)
            row = self.below[c] + self._rank(c, row)
            steps += 1
        return out


def occurrences(phrases: Phrases, data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur in a shard and the word (counted in the shard) each occurrence starts at."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.patterns) or not len(code):
        return none
    number = phrases.number(code)
    row = np.searchsorted(rows, np.arange(len(code)), "right")
    known = np.r_[False, number > 0, False]
    fresh = np.r_[True, row[1:] != row[:-1]]
    first = np.flatnonzero(known[1:-1] & (~known[:-2] | fresh))
    last = np.flatnonzero(known[1:-1] & (~known[2:] | np.r_[fresh[1:], True])) + 1
    long = last - first >= phrases.shortest
    first, size = first[long], (last - first)[long]
    if not len(first):
        return none
    # stretches one after the other, a 0 after each
    offset = np.cumsum(size + 1) - size - 1
    place = np.repeat(first - offset, size + 1) + np.arange(int(size.sum()) + len(size))
    sequence = number[np.minimum(place, len(number) - 1)]
    sequence[offset + size] = 0
    index = FMIndex(sequence)
    low, high = index.search(phrases.patterns)
    which = np.repeat(np.arange(len(low)), high - low)
    if not len(which):
        return none
    step = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    at = place[index.locate(np.repeat(low, high - low) + step)]
    # words were numbered by their hash: the window of that place must be an item's, word for word
    raw = data.tobytes()
    size = phrases.sizes[which]
    spans = zip(start.tolist(), end.tolist()) if 4 * len(at) > len(start) else None
    words = [raw[a:b] for a, b in spans] if spans else None
    cut = (lambda a, n: tuple(words[a : a + n])) if words else (lambda a, n: tuple([raw[x:y] for x, y in zip(start[a : a + n].tolist(), end[a : a + n].tolist())]))
    true = np.array([phrases.place.get(cut(a, n), -1) for a, n in zip(at.tolist(), size.tolist())], np.int64)
    return true[true >= 0], at[true >= 0]


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.r_[False, inside, False]
    return np.flatnonzero(edge[1:] & ~edge[:-1]), np.flatnonzero(edge[:-1] & ~edge[1:])


def _merge(spans: list[int], more: list[int]) -> list[int]:
    if not spans or not more:
        return spans or more
    out: list[int] = []
    for a, b in sorted([*zip(spans[::2], spans[1::2]), *zip(more[::2], more[1::2])]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, row, n_words, hit, items for each row of docs.

    hit: spans of words in any window's occurrence, flat (start, end, start, end, ...); items: ids, as
    strings, of items with occurring windows. Null and empty texts have no words. Items without words or id are
    ignored; texts of items with the same id count together. Repeated rows each give their own row. Columns besides doc_id and text come within the struct `row`, so their names can't clash. Empty tables give
    empty results, or rows without hits.
    """
    stage = Stage(docs.sparkSession, "contamination")
    items = stage.save(parts(benchmark, window), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), rest(docs, F.lit(True))[0], F.lit(0).cast("bigint").alias("n_words"), *[F.array().cast(f"array<{t}>").alias(c) for c, t in (("hit", "int"), ("items", "string"))])
    kind = with_row("doc_id bigint, text string, n_words bigint, hit array<int>, items array<string>", rows.schema["row"])
    for block in range(blocks):
        if block and block % PASSES == 0:
            rows = stage.save(rows, f"rows-{block}")
        # about block_bytes of parts, each of a bounded size
        phrases = Phrases([(r.item, r.text) for r in items.filter(F.pmod(F.xxhash64("item", "part"), F.lit(blocks)) == block).collect()], window)
        rows = map_arrow(rows, _pass(phrases), kind)
    return rows


def parts(benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """item, part, text: items with an id and words, in parts that overlap by so many words that each window is in one of them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.col("item").isNotNull())

    def run(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("item", "part", "text")}
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                raw = text.encode()
                start, end, _ = passages.words_at(LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), INSIDE)
                first, k = 0, 0
                while first < len(start):
                    last = max(first + window, int(np.searchsorted(start, start[first] + part_bytes)))
                    last = min(last, len(start))
                    out["item"].append(item)
                    out["part"].append(k)
                    out["text"].append(raw[start[first] : end[last - 1]].decode())
                    k += 1
                    first = len(start) if last == len(start) else last - window + 1
            yield out

    return map_arrow(items, run, "item string, part int, text string")


def _pass(phrases: Phrases):
    def run(batches):
        for b in slices(batches, "text", passages.HASH_BYTES):
            data, offsets = passages.text_bytes(b.column("text").fill_null(""))
            data = LOWER[data]
            start, end, code, rows = words_of(data, offsets)
            which, at = occurrences(phrases, data, start, end, code, rows)
            n = b.num_rows
            found: dict[str, list[list]] = {c: [[] for _ in range(n)] for c in ("hit", "items")}
            change = np.zeros(len(code) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + phrases.length[which], -1)
            for a, z in zip(*_runs(np.cumsum(change[:-1]) > 0)):
                while a < z:  # a run can go on in the next row
                    r = int(np.searchsorted(rows, a, "right")) - 1
                    e = min(int(z), int(rows[r + 1]))
                    found["hit"][r] += [int(a - rows[r]), int(e - rows[r])]
                    a = e
            for r, w in sorted(set(zip((np.searchsorted(rows, at, "right") - 1).tolist(), which.tolist()))):
                found["items"][r].extend(phrases.items[i] for i in phrases.of[w])
            old = {c: b.column(c).to_pylist() for c in found}
            merged = {"hit": [_merge(x, y) for x, y in zip(old["hit"], found["hit"])]}
            merged["items"] = [sorted({*x, *y}) if y else x for x, y in zip(old["items"], found["items"])]
            yield {"doc_id": b.column("doc_id"), "text": b.column("text"), "row": b.column("row"), "n_words": np.diff(rows).tolist(), **merged}

    return run


def digests(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, items: int = ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (see find)."""
    got = find(docs.select("doc_id", "text"), benchmark, window, block_bytes).select("doc_id", "n_words", "hit", "items")

    def run(batches):
        for b in batches:
            hit, found = b.column("hit").to_pylist(), b.column("items").to_pylist()
            yield {"doc_id": b.column("doc_id"), "n_words": b.column("n_words"), "n_hit": [sum(h[1::2]) - sum(h[::2]) for h in hit], "n_items": [len(i) for i in found], "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in found], "contaminated": [len(i) >= items for i in found]}

    return map_arrow(got, run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, items: int = ITEMS) -> DataFrame:
    """docs without contaminated rows and without passages that are hit, of short items too, its columns in order; other texts stay as they are.

    A passage goes from its first word to its last. A row that loses all its words goes too.
    """
    got = find(docs, benchmark, window).filter(F.size("items") < items)
    kind = with_row("doc_id bigint, text string, lost boolean", got.schema["row"])

    def run(batches):
        for b in slices(batches, "text"):
            out = []
            for text, cut in zip(b.column("text").to_pylist(), b.column("hit").to_pylist()):
                if cut:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    start, end, _ = passages.words_at(LOWER[raw], np.array([0, len(raw)]), INSIDE)
                    if cut == [0, len(start)]:
                        text = None
                    else:
                        keep = np.ones(len(raw), bool)
                        for a, z in zip(cut[::2], cut[1::2]):
                            keep[start[a] : end[z - 1]] = False
                        text = raw[keep].tobytes().decode()
                out.append(text)
            yield {"doc_id": b.column("doc_id"), "text": out, "row": b.column("row"), "lost": [bool(c) and t is None for c, t in zip(b.column("hit").to_pylist(), out)]}

    got = map_arrow(got.select("doc_id", "text", "row", "hit"), run, kind).filter("not lost")
    return unpacked(got, docs.schema, doc_id=F.col("doc_id"), text=F.col("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = None  # word windows of all texts: tested against a plain loop instead
