"""Co-location of recurring passages, for the operators that look for repeated windows of bytes or words.

A window is a run of `window` units (bytes or words) of one document. Among the k-grams inside it the one of least hash
is the window's anchor: equal windows have equal anchors at equal distances. Neighbouring windows with the same anchor
form a segment, so each window lies in exactly one segment, and windows can be equal only if their segments have anchors
of equal hash. That makes the search for repeated windows a grouping of segments by anchor:

1. rows are numbered and written once, dealt by their number, so that what follows meets a row's text without moving it;
2. segments: anchor, size and a digest of the segment's bytes, place. No text is carried;
3. candidates: segments whose anchor occurs again. Equal segments (equal in size and in 128 bits of BLAKE2b, for which
   nobody can make two strings) are collapsed into one representative, the first in order, with a count. Copies thus
   cost a row each, but no text;
4. representatives get their text from the rows and go, by anchor, to shards of bounded size;
5. a shard's index decides which windows of its representatives occur again; all occurrences inherit by a join.

The hash that chooses anchors only decides who meets whom; it never says that two strings are equal.

An anchor with more than `hot` different segments isn't held by one task: its representatives are cut into windows,
which are dealt by a digest of their own content, so each group holds equal windows only. That is exact, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, map_arrow, slices

#: Bytes of text that are hashed at once; one longer document is hashed whole.
HASH_BYTES = 2 << 20
#: An anchor with more different segments is dealt by single windows.
HOT = 2000
BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers[0], _powers[1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums by which span_hash gives the hash of any run of the values."""
    up, _ = powers(len(values) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and the offsets of its rows in them."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_at(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words, which are runs of bytes in `inside`, and each row's offset in words."""
    mark = np.zeros(len(data) + 2, bool)
    mark[1:-1] = inside[data]
    first = mark[1:-1] & ~mark[:-2]
    last = mark[1:-1] & ~mark[2:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = mark[1:-1][cut]
    last[cut - 1] = mark[1:-1][cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def winnow(values: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, ...]:
    """Segments of documents whose units have these hash values: document, start, number of units, hash of anchor."""
    n = len(values)
    lengths = np.diff(offsets)
    long = np.flatnonzero(lengths >= window)
    if not len(long):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    prefix = prefix_hash(values)
    _, down = powers(n + 1)
    gram = mix((prefix[k:] - prefix[:-k]) * down[: n - k + 1])
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width, have = window - k + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: have - width], least[width - have :])
    edge = np.zeros(n + 1, np.int8)
    edge[offsets[long]] = 1
    np.add.at(edge, offsets[long + 1] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:n]))  # starts of windows
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    start, last = at[new], at[np.r_[new[1:], len(at)] - 1]
    end = last + window
    doc = np.searchsorted(offsets, start, "right") - 1
    return doc, start - offsets[doc], end - start, gram[anchor[new]]


def same_content(data: bytes) -> bytes:
    """16 bytes that stand for a string wherever two are held to be equal."""
    return blake2b(data, digest_size=16).digest()


def dealt(stage: Stage, docs: DataFrame, *more: Column) -> DataFrame:
    """rid, doc_id, text (null: empty) and more columns of docs, written once and dealt by rid, a number of the row.

    Repeated rows have numbers of their own, so no part of the table can grow hot.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    return stage.deal(rows, "dealt", "rid")


#: What equal segments have in common; the anchor follows from the rest and says where they meet.
SAME = ["anchor", "size", "digest_1", "digest_2"]


def segments(rows: DataFrame, units: Callable, k: int, window: int, *order: str) -> DataFrame:
    """rid, order columns, start, SAME of the rows' segments.

    units gives, for a slice's bytes and offsets, the hash values of its units, each row's offset in units, and the
    bytes that a run of units stands for: the buffer and every unit's start and end in it.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "text", HASH_BYTES):
            values, offsets, data, begin, end = units(*text_bytes(b.column("text")))
            doc, start, size, anchor = winnow(values, offsets, k, window)
            if len(doc):
                first = offsets[doc] + start
                raw = memoryview(data)
                spans = zip(begin[first].tolist(), end[first + size - 1].tolist())
                digest = np.frombuffer(b"".join([blake2b(raw[x:y], digest_size=16).digest() for x, y in spans]), np.int64).reshape(-1, 2)
                place = pa.array(doc)
                own = {c: b.column(c).take(place) for c in ("rid", *order)}
                yield {**own, "start": pa.array(start.astype(np.int32)), "size": pa.array(size.astype(np.int32)), "anchor": pa.array(anchor.view(np.int64)), "digest_1": pa.array(digest[:, 0]), "digest_2": pa.array(digest[:, 1])}

    schema = "".join(f"{c} bigint, " for c in ("rid", *order)) + "start int, size int, anchor bigint, digest_1 bigint, digest_2 bigint"
    return map_arrow(rows.select("rid", *order, "text"), run, schema)


def anchors(rows: DataFrame, units: Callable, k: int, window: int) -> DataFrame:
    """The anchor of every segment."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "text", HASH_BYTES):
            values, offsets, *_ = units(*text_bytes(b.column("text")))
            *_, anchor = winnow(values, offsets, k, window)
            yield {"anchor": pa.array(anchor.view(np.int64))}

    return map_arrow(rows.select("text"), run, "anchor bigint")


def candidates(stage: Stage, rows: DataFrame, units: Callable, k: int, window: int, *order: str) -> DataFrame:
    """Segments whose anchor occurs again. Anchors are counted before the shuffle; being a table of its own, the counts meet a frequent anchor's rows in a join that can be split."""
    often = stage.save(anchors(rows, units, k, window).groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor"), "often")
    found = segments(rows, units, k, window, *order)
    return stage.save(found.join(often, "anchor", "left_semi").select(found.columns), "candidates")


def representatives(stage: Stage, cand: DataFrame, order: list[str], hot: int = HOT) -> DataFrame:
    """One row for equal segments: SAME, the first place in the given order, the number of places, whether its anchor has too many."""
    one = cand.groupBy(SAME).agg(F.min(F.struct(order)).alias("first"), F.count(F.lit(1)).alias("times"))
    one = stage.save(one.select(*SAME, *[F.col("first")[c].alias(c) for c in order], "times"), "distinct")
    # fewer rows than a hot-th part of the segments
    crowds = stage.save(one.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > hot).select("anchor", F.lit(True).alias("hot")), "crowds")
    return one.join(crowds, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def with_text(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """text of dealt rows, with an array of the wanted rows' structs; a document's array is bounded by its length."""
    per = wanted.groupBy("rid").agg(F.collect_list(F.struct(*[c for c in wanted.columns if c != "rid"])).alias(name))
    return rows.select("rid", "text").join(per, "rid")
