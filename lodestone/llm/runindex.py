"""Suffix-array dedup with a run-length index.

For each shard of co-located segments (see passages) a Burrows-Wheeler transform is built and compressed to its runs:
symbol, length, and suffix samples at the run's ends, with the length of the match between a run's head and the end of
the run before. Matching statistics are streamed from these samples: from one sampled place to the next the length of
the match falls by one for each byte. Matches of WINDOW bytes or more are marked on both sides. In repetitive text runs
are few, and so are the samples.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import passages
from .common import Stage, map_arrow, slices, table
from .passages import SAME

WINDOW = 200
#: Bytes of the hashed grams that windows are anchored at.
GRAM = 32
#: Bytes of text in a shard, and in one transform.
SHARD_BYTES = 8 << 20
INDEX_BYTES = 900_000
_BITS = 20


class RunIndex:
    """The run-length transform of some byte strings; matches never cross their ends.

    A string that occurs several times stands once with its count: its copies' suffixes follow each other in the order
    and only lengthen runs, by the count.
    """

    def __init__(self, pieces: list[bytes], times: list[int] | None = None):
        self.pieces, self.times = pieces, np.array(times or [1] * len(pieces), np.int64)
        lengths = np.array([len(p) + 1 for p in pieces], np.int64)
        ends = np.cumsum(lengths)
        self.start = ends - lengths
        n = int(ends[-1])
        symbol = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64) + 1
        symbol[ends - 1] = 0
        self.left = np.repeat(ends, lengths) - 1 - np.arange(n)  # bytes up to the piece's end
        self.weight = np.repeat(self.times, lengths)
        self.symbol, self.levels = symbol, {}
        self._runs(self._sorted(n))
        self.levels = {}  # only the runs and their samples stay

    @staticmethod
    def _argsort(key: np.ndarray, bits: int) -> np.ndarray:
        """Stable order of keys below 2 ** bits."""
        n = len(key)
        if n <= 1 << _BITS and bits + _BITS <= 63:
            return (np.sort(key << _BITS | np.arange(n)) & ((1 << _BITS) - 1)).astype(np.int64)
        return np.argsort(key, kind="stable")

    def _sorted(self, n: int) -> np.ndarray:
        """The suffix array, by doubling; a suffix whose first h bytes reach its piece's end is told apart at once.

        Only groups of several suffixes with the same first h bytes are looked at again.
        """
        padded = np.concatenate([self.symbol, np.zeros(3, np.int64)])
        key = padded[:n] << 27 | padded[1 : n + 1] << 18 | padded[2 : n + 2] << 9 | padded[3 : n + 3]
        order = self._argsort(key, 36)
        key, short = key[order], self.left[order] < 4
        new = np.r_[True, (key[1:] != key[:-1]) | short[1:] | short[:-1]]
        place = np.arange(n)  # in the order, of the suffixes that are looked at
        first = np.maximum.accumulate(np.where(new, place, 0))  # where the group of each begins
        rank = np.empty(n, np.int32)
        rank[order] = first
        h = 4
        while True:
            self.levels[h] = rank.copy()
            several = ~(new & np.r_[new[1:], True])
            place, first = place[several], first[several]
            if not len(place):
                return order
            active = order[place]
            room = self.left[active]
            second = np.where(room >= h, rank[np.minimum(active + h, n - 1)], 0)
            group = np.cumsum(np.r_[False, first[1:] != first[:-1]])
            by = self._argsort(group * np.int64(n) + second, max(1, int(group[-1] * n + n).bit_length()))
            active, second, tail = active[by], second[by], room[by] < 2 * h
            new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | tail[1:] | tail[:-1]]
            order[place] = active
            first = np.maximum.accumulate(np.where(new, place, 0))
            rank[active] = first
            h *= 2

    def _runs(self, order: np.ndarray) -> None:
        """The transform's runs: symbol (0: a string's end), length with copies, suffix samples of the first and last row.

        Rows of symbol 0 are runs of their own, as what precedes their strings differs.
        """
        before = np.where(order > 0, self.symbol[order - 1], 0)
        head = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (before[1:] == 0)])
        last = np.r_[head[1:], len(order)] - 1
        self.runs, self.length = before[head], np.add.reduceat(self.weight[order], head)
        self.first, self.last = order[head], order[last]
        self.match = np.r_[0, self._common(self.first[1:], self.last[:-1])]  # of a run's first row with the row before

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes, by the ranks of the doubling."""
        n = len(self.symbol)
        most, out = np.minimum(self.left[a], self.left[b]), np.zeros(len(a), np.int64)
        for h in sorted(self.levels, reverse=True):
            rank = self.levels[h]
            for _ in range(1 if h < max(self.levels) else 2):
                x, y = a + out, b + out
                fits = out + h <= most
                out += np.where(fits & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]), h, 0)
        for _ in range(3):
            fits = out < most
            out += fits & (self.symbol[np.minimum(a + out, n - 1)] == self.symbol[np.minimum(b + out, n - 1)])
        return out

    def statistics(self) -> np.ndarray:
        """For each place the length of its match with the row before it in the order, streamed from the samples.

        At a run's first row it is sampled; from one place to the next it falls by one at most, and by just one where
        the place isn't sampled. The row before a place in a string that has copies is that place in a copy.
        """
        reach = np.zeros(len(self.symbol), np.int64)
        reach[self.first] = self.first + self.match
        found = np.maximum(np.maximum.accumulate(reach) - np.arange(len(reach)), 0)
        return np.where(self.weight > 1, self.left, found)

    def covered(self, least: int) -> list[list[int]]:
        """For each piece the spans (start, end, start, end, ...) covered by a string of `least` bytes that occurs again."""
        n = len(self.symbol)
        found = self.statistics()
        reach = np.where(found >= least, np.arange(n) + found, 0)
        inside = np.maximum.accumulate(reach) > np.arange(n)
        # the other side of each match: the last row of the run before, and what follows it
        long = np.flatnonzero(self.match >= least)
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, self.last[long - 1], 1)
        np.add.at(change, self.last[long - 1] + self.match[long], -1)
        inside = np.r_[False, inside | (np.cumsum(change[:n]) > 0), False]
        begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        owner = np.searchsorted(self.start, begin, "right") - 1
        out: list[list[int]] = [[] for _ in self.pieces]
        for p, b, e in zip(owner.tolist(), begin.tolist(), end.tolist()):
            out[p] += [b - int(self.start[p]), e - int(self.start[p])]
        return out


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    at = np.arange(len(data) + 1)
    return passages.BYTE_VALUES[data], offsets, data, at[:-1], at[1:]


def _cut(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The representatives' bytes."""
    got = passages.with_text(rows, wanted.select("rid", "start", *SAME, "times", "hot"), "wanted")

    def run(batches):
        for b in slices(batches, "text"):
            out: dict[str, list] = {c: [] for c in (*SAME, "times", "hot", "data")}
            for text, want in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                data = text.encode()
                for w in want:
                    for c in (*SAME, "times", "hot"):
                        out[c].append(w[c])
                    out["data"].append(data[w["start"] : w["start"] + w["size"]])
            yield out

    return map_arrow(got, run, "anchor bigint, size int, digest_1 bigint, digest_2 bigint, times bigint, hot boolean, data binary")


_SPANS = "anchor bigint, size int, digest_1 bigint, digest_2 bigint, spans array<int>"


def _by_index(pieces: DataFrame, shards: int, window: int) -> DataFrame:
    def run(batches):
        rows: dict[tuple, tuple] = {}
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in (*SAME, "times", "data"))):
                rows[r[:4]] = r
        todo, size = [], 0
        ordered = sorted(rows.values(), key=lambda r: r[:4])
        for i, r in enumerate(ordered):
            todo.append(r)
            size += len(r[5]) + 1
            following = ordered[i + 1] if i + 1 < len(ordered) else None
            if following is None or following[0] != r[0] and size + len(following[5]) > INDEX_BYTES:
                spans = RunIndex([r[5] for r in todo], [r[4] for r in todo]).covered(window)
                yield {**{c: [r[k] for r in todo] for k, c in enumerate(SAME)}, "spans": spans}
                todo, size = [], 0

    return map_arrow(pieces.repartition(shards, "anchor"), run, _SPANS)


def _by_windows(stage: Stage, pieces: DataFrame, window: int) -> DataFrame:
    """The same for anchors with too many different segments for one task: each window is dealt by its own content."""

    def run(batches):
        for b in batches:
            for *same, times, data in zip(*(b.column(c).to_pylist() for c in (*SAME, "times", "data"))):
                n = len(data) - window + 1
                yield {**{c: [x] * n for c, x in zip(SAME, same)}, "offset": list(range(n)), "times": [times] * n, "string": [passages.same_content(data[i : i + window]) for i in range(n)]}

    each = stage.save(map_arrow(pieces, run, "anchor bigint, size int, digest_1 bigint, digest_2 bigint, offset int, times bigint, string binary"), "windows")
    again = stage.save(each.groupBy("string").agg(F.sum("times").alias("n")).filter("n > 1").select("string"), "again")
    span = F.array(F.col("offset"), F.col("offset") + window)
    return each.join(again, "string").groupBy(SAME).agg(F.flatten(F.collect_list(span)).alias("spans"))


def marks(stage: Stage, rows: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = passages.HOT) -> DataFrame:
    """rid and an array of (start, spans) for dealt rows with repeated bytes."""
    cand = passages.candidates(stage, rows, byte_units, min(gram, window), window)
    reps = passages.representatives(stage, cand, ["rid", "start"], hot)
    told = reps.agg(F.sum("size"), F.max(F.col("hot").cast("int"))).first()
    pieces = _cut(rows, reps)
    if told[1]:
        pieces = stage.save(pieces, "pieces")
    spans = _by_index(pieces.filter("not hot"), (told[0] or 0) // SHARD_BYTES + 1, window)
    if told[1]:
        spans = spans.unionByName(_by_windows(stage, pieces.filter("hot"), window))
    spans = stage.save(spans.filter("size(spans) > 0"), "spans")
    found = cand.join(spans, SAME)
    return found.groupBy("rid").agg(F.collect_list(F.struct("start", "spans")).alias("marks"))


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = passages.HOT) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    A null text has no bytes. Repeated rows are documents of their own, so what they share is removed from each. A null
    id is an id like others. Other columns are ignored, whatever their names. An empty table gives an empty table.
    Texts shorter than a window lose nothing; very long ones go through one task each, whole. There are no ties: a
    string that starts at two places goes from both.
    """
    stage = Stage(docs.sparkSession, "runindex")
    rows = passages.dealt(stage, docs.select("doc_id", "text"))
    joined = rows.join(marks(stage, rows, window, gram, hot), "rid", "left").select("doc_id", "text", "marks")

    def run(batches):
        for b in slices(batches, "text"):
            out: dict[str, list] = {c: [] for c in ("kept", "n_bytes", "n_removed", "n_spans")}
            for text, m in zip(b.column("text").to_pylist(), b.column("marks").to_pylist()):
                data = text.encode()
                keep, runs = data, 0
                if m:
                    gone = np.zeros(len(data) + 1, bool)
                    for x in m:
                        at, spans = x["start"], x["spans"]
                        for i in range(0, len(spans), 2):
                            gone[at + spans[i] : at + spans[i + 1]] = True
                    runs = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
                    keep = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes()
                out["kept"].append(keep)
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(keep))
                out["n_spans"].append(runs)
            yield {"doc_id": b.column("doc_id"), **out, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in out["kept"]]}

    return map_arrow(joined, run, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = passages.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    return remove(docs, window, gram, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = None  # strings of all places of a table: tested against a plain loop instead
