"""Sharding by Karmarkar-Karp differencing: equal texts stay together, shards hold nearly equal bytes.

Groups of equal texts are the items. Groups of at least one unit (a 1/(shards * PER_SHARD) part of all bytes; so at
most shards * PER_SHARD of them) are items of their own, the others are gathered by hash into a fixed number of
bundles. The driver thus differences a number of items with a fixed bound, whatever the size of the corpus; documents
find their shard by a broadcast table of the same bound. Texts are never shuffled.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, table, texts

SHARDS = 40
#: Items per shard: of either kind (large groups, bundles of small ones) there are at most SHARDS * PER_SHARD.
PER_SHARD = 128
ROW_BYTES = 16


def difference(weights: list[int], shards: int) -> list[int]:
    """The shard of each item. Partial partitions of largest spread are combined oppositely ordered until one is left."""
    if not weights:
        return []
    # a partial partition: sums in descending order, and per sum a chain of (item | chain, chain)
    heap = [(-w, i, [w] + [0] * (shards - 1), [i] + [None] * (shards - 1)) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    at = len(weights)
    while len(heap) > 1:
        _, _, a, held_a = heapq.heappop(heap)
        _, _, b, held_b = heapq.heappop(heap)
        both = sorted(((x + y, k) for k, (x, y) in enumerate(zip(a, reversed(b)))), key=lambda p: (-p[0], p[1]))
        held_b = held_b[::-1]
        held = [held_b[k] if held_a[k] is None else held_a[k] if held_b[k] is None else (held_a[k], held_b[k]) for _, k in both]
        sums = [s for s, _ in both]
        heapq.heappush(heap, (sums[-1] - sums[0], at, sums, held))
        at += 1
    out = [0] * len(weights)
    for shard, chain in enumerate(heap[0][3]):
        todo = [] if chain is None else [chain]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                out[x] = shard
    return out


def shard(docs: DataFrame, shards: int = SHARDS, per_shard: int = PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for each row of docs.

    Equal texts, null and empty ones alike, get the same shard. Sizes of shards are near equal unless one group alone
    is larger than a shard's part. slot counts the rows of a shard from 0 without gaps; its order is that of input
    partitions, then of doc_id. Repeated rows and ids each get a slot. Other columns are ignored, whatever their
    names. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "shard")
    text = F.coalesce("text", F.lit(""))
    rows = stage.save(texts(docs).select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key"), F.spark_partition_id().alias("part")), "rows")
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("weight"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = shards * per_shard
    unit = max(1, math.ceil(total / most))
    bundle = F.pmod(F.xxhash64("text_key"), F.lit(most)).cast("int")
    groups = groups.select("text_key", "weight", (F.col("weight") >= unit).alias("large"), bundle.alias("bundle"))
    # at most `most` rows each, as large groups have a unit of bytes at least and bundles are numbered below `most`
    large = groups.filter("large").select("text_key", "weight").collect()
    small = groups.filter("not large").groupBy("bundle").agg(F.sum("weight").alias("weight")).collect()
    items = sorted([(r.weight, 0, bytes(r.text_key)) for r in large] + [(r.weight, 1, r.bundle) for r in small], key=lambda x: (-x[0], x[1], str(x[2])))
    found = difference([x[0] for x in items], shards)
    by_key = spark.createDataFrame([(x[2], s) for x, s in zip(items, found) if x[1] == 0], "text_key binary, own int")
    by_bundle = spark.createDataFrame([(x[2], s) for x, s in zip(items, found) if x[1] == 1], "bundle int, bundled int")
    dealt = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(by_key), "text_key", "left")
        .join(F.broadcast(by_bundle), "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own", "bundled").alias("shard"), "part")
    )
    # rows before a part in a shard: as many rows as parts times shards
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return dealt.withColumn("within", within).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


ORACLE_SQL = None  # differencing is a loop over a heap
