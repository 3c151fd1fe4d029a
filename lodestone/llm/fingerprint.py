"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Each window of WINDOW bytes gives byte triplets (its first byte and two of the others), a text shorter than that those
it has; each triplet is hashed into one of BUCKETS counters. The digest holds a checksum byte, the length on a logarithmic scale, two quartile ratios and two
bits per bucket: the quartile of the counts that the bucket's count lies in. Two digests differ by a bounded score.

The next document in order of doc_id is found by one range partitioning on doc_id: in a sorted partition it is the next
row. Rows of one id are dealt further by a hash of their texts and by their place, so a frequent id is many tasks. Only
the last row of each partition has its next row elsewhere; these few (one for each partition) are looked up afterwards.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, map_arrow, shuffle_width, slices, table, texts

BUCKETS = 128
WINDOW = 5
#: Other bytes of each triplet, counted from the window's first byte, with the salt of its hash.
TRIPLETS = ((1, 2, 0x9E37), (1, 3, 0x85EB), (2, 4, 0xC2B3))
#: Bytes hashed at once.
BLOCK = 1 << 20
#: The largest difference of two digests: 3 steps for each bucket, 12 each for length and ratios, 1 for the checksum.
MOST = 3 * BUCKETS + 12 * 3 + 1


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets of the bytes fall in each bucket."""
    out = np.zeros(BUCKETS, np.int64)
    b = np.frombuffer(data, np.uint8)
    for at in range(0, max(1, len(b) - WINDOW + 1), BLOCK):
        part = b[at : at + BLOCK + WINDOW - 1].astype(np.uint32)
        for i, j, salt in TRIPLETS:
            n = len(part) - (WINDOW - 1 if len(b) >= WINDOW else j)
            if n <= 0:
                continue
            h = part[:n] | part[i : i + n] << np.uint32(8) | part[j : j + n] << np.uint32(16)
            h = (h + np.uint32(salt)) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
            h *= np.uint32(2246822519)
            out += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return out


def digest(data: bytes) -> str:
    """Hex digits: checksum (2), length (2), ratios of the quartiles (2), two bits for each bucket (BUCKETS / 2). Equal bytes, equal digest."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    size = min(255, int(np.log1p(len(data)) * 12))
    ratios = (int(q1 * 15 // q3) << 4 | int(q2 * 15 // q3)) if q3 else 0
    quartile = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = quartile[0::4] << 6 | quartile[1::4] << 4 | quartile[2::4] << 2 | quartile[3::4]
    return f"{zlib.crc32(data) & 0xFF:02x}{size:02x}{ratios:02x}" + packed.astype(np.uint8).tobytes().hex()


_STEPS = np.array([[sum(abs((x >> s & 3) - (y >> s & 3)) for s in (0, 2, 4, 6)) for y in range(256)] for x in range(256)], np.int32)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, falling linearly to 0 with their difference score."""
    if a == b:
        return 1.0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    score = int(x[0] != y[0]) + min(12, abs(int(x[1]) - int(y[1])))
    score += min(12, abs(int(x[2] >> 4) - int(y[2] >> 4))) + min(12, abs(int(x[2] & 15) - int(y[2] & 15)))
    return 1.0 - (score + int(_STEPS[x[3:], y[3:]].sum())) / MOST


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _row(text: str, mark: str, following: str, next_mark: str) -> tuple[str, str, float, float]:
    other = edited(text, following)
    changed = other.encode()
    own = mark if other == text else digest(changed)
    return hashlib.sha256(changed).hexdigest(), own, likeness(mark, own), likeness(mark, next_mark)


_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, mix bigint, part int, place bigint"


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    Null texts count as empty. Rows of equal doc_id follow each other in order of a hash of their texts; null ids
    come first; after the last row comes the first, so the only row of a table follows itself. Other columns are
    ignored, whatever their names. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "fingerprint")
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("mix", F.xxhash64("text"))
    # rows that are equal so far have equal results, whatever their places
    placed = rows.withColumn("row", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(partitions or shuffle_width(spark), "doc_id", "mix", "row").sortWithinPartitions("doc_id", "mix", "row").drop("row")

    def run(batches):
        from pyspark import TaskContext

        part, place, held = TaskContext.get().partitionId(), 0, None

        def made(ids, found):
            nonlocal place
            cols = list(zip(*found))
            out = dict(zip(("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"), map(list, cols)))
            places = list(range(place, place + len(ids)))
            place += len(ids)
            return {"doc_id": [i for i, _ in ids], "mix": [m for _, m in ids], "part": [part] * len(ids), "place": places, **out}

        for b in slices(batches, "text"):
            ids, found = [], []
            for i, t in zip(zip(b.column("doc_id").to_pylist(), b.column("mix").to_pylist()), b.column("text").to_pylist()):
                mark = held[2] if held and held[1] == t else digest(t.encode())
                if held:
                    ids.append(held[0])
                    found.append((len(held[1]), *(x := _row(held[1], held[2], t, mark))[:1], held[2], *x[1:]))
                held = i, t, mark
            if ids:
                yield made(ids, found)
        if held:  # the next row is in another partition
            yield made([held[0]], [(len(held[1]), None, held[2], None, None, None)])

    out = stage.save(map_arrow(ordered, run, _SCHEMA), "rows")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    # one open row for each partition, and the first id of each: as many as there are partitions
    ends = out.groupBy("part").agg(F.min("place"), F.max("place").alias("last"), F.min_by(F.struct("doc_id", "mix"), "place").alias("first"), F.max_by(F.struct("doc_id", "mix"), "place").alias("end")).orderBy("part").collect()
    if not ends:
        return out.select(names)
    follow = [(r.part, r.last, *r.end, *ends[(k + 1) % len(ends)].first) for k, r in enumerate(ends)]
    pairs = spark.createDataFrame(follow, "part int, place bigint, last_id bigint, last_mix bigint, first_id bigint, first_mix bigint")
    wanted = spark.createDataFrame(list({x for f in follow for x in (f[2:4], f[4:6])}), "wanted bigint, hash bigint")
    near = rows.join(F.broadcast(wanted), rows.doc_id.eqNullSafe(wanted.wanted) & (rows.mix == wanted.hash), "left_semi")
    said = near.groupBy("doc_id", "mix").agg(F.min("text").alias("text"))
    left, right = said.alias("l"), said.alias("r")
    open_rows = (
        pairs.join(left, F.col("l.doc_id").eqNullSafe(F.col("last_id")) & (F.col("l.mix") == F.col("last_mix")))
        .select("part", "place", "first_id", "first_mix", F.col("l.text").alias("own"))
        .join(right, F.col("r.doc_id").eqNullSafe(F.col("first_id")) & (F.col("r.mix") == F.col("first_mix")))
        .select("part", "place", F.col("own").alias("text"), F.col("r.text").alias("following"))
    )

    def close(batches):
        for b in batches:
            found = [_row(t, digest(t.encode()), f, digest(f.encode())) for t, f in zip(b.column("text").to_pylist(), b.column("following").to_pylist())]
            if found:
                cols = dict(zip(("s", "e", "ne", "nn"), map(list, zip(*found))))
                yield {"part": b.column("part"), "place": b.column("place"), **cols}

    closed = stage.save(map_arrow(open_rows, close, "part int, place bigint, s string, e string, ne double, nn double"), "ends")
    return out.join(F.broadcast(closed), ["part", "place"], "left").select(
        "doc_id", "n_chars", F.coalesce("edited_sha256", "s").alias("edited_sha256"), "fingerprint", F.coalesce("edited_fingerprint", "e").alias("edited_fingerprint"), F.coalesce("near_edited", "ne").alias("near_edited"), F.coalesce("near_next", "nn").alias("near_next")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


ORACLE_SQL = None  # the digest is the operator's own; edited_sha256 and n_chars are tested against a plain loop
