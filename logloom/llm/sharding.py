"""Sharding by rendezvous hashing of stable record keys over weighted shards (DataFrame functions only)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_columns


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest weighted rendezvous score.

    Score of shard j: -ln(u) / weight, the least wins, where u in (0, 1) is drawn from the first 52 bits of
    md5("key:j"). Adding a shard, or raising one weight, moves rows only into that shard. A null key hashes as "null".
    """
    text = F.coalesce(key.cast("string"), F.lit("null"))
    draws = []
    for j, w in enumerate(weights):
        if not w > 0:
            continue
        u = (F.conv(F.substring(F.md5(F.concat(text, F.lit(f":{j}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        draws.append(F.struct((-F.ln(u) / float(w)).alias("score"), F.lit(j).alias("shard")))
    if not draws:
        raise ValueError("at least one shard needs a positive weight")
    best = F.least(*draws) if len(draws) > 1 else draws[0]
    return best["shard"].cast("int")


def assign_shards(df: DataFrame, key: str, text: str, weights: Sequence[float], grown: Sequence[float] | None = None, slot_buckets: int = 1024) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 8; ``slot`` numbers a shard's rows from 0 without gaps, in
    order of (bucket, key). Law "key": only the key and the weights decide. Made columns replace input columns of their
    names. Empty table: no rows; repeated rows get slots of their own; null keys share a shard.

    Slots need no window over a whole shard: rows are counted by (shard, bucket), the counts are summed within a shard
    (``slot_buckets`` rows each), and rows are numbered within (shard, bucket). Only keys are read for the counts.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    k, b = f"_k{uuid.uuid4().hex[:6]}", f"_b{uuid.uuid4().hex[:6]}"
    body = F.coalesce(df[f"`{text}`"].cast("string"), F.lit(""))
    crc = F.crc32(body.cast("binary"))
    bucket = (F.conv(F.substring(F.md5(F.concat(F.coalesce(df[f"`{key}`"].cast("string"), F.lit("null")), F.lit(":slot"))), 1, 8), 16, 10).cast("long") % slot_buckets).cast("int")
    grown = list(grown) if grown is not None else [*weights, sum(weights) / len(weights)]
    kept = keep_columns(df, made)
    placed = df.select(
        *[df[f"`{c}`"] for c in kept],
        (F.octet_length(body) + 8).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(df[f"`{key}`"], weights).alias("shard"),
        shard_of(df[f"`{key}`"], grown).alias("grown_shard"),
        df[f"`{key}`"].alias(k),
        bucket.alias(b),
    )
    counts = placed.groupBy("shard", b).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("_s"), F.col(b).alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("shard", b).orderBy(k, "text_crc32", "size")
    numbered = placed.withColumn("_at", F.row_number().over(within))
    # at most shards x slot_buckets rows: a bound by parameters
    joined = numbered.join(F.broadcast(starts), (F.col("shard") == F.col("_s")) & (F.col(b) == F.col("_b")))
    return joined.select(*kept, "size", "text_crc32", "law", "shard", (F.col("_from") + F.col("_at") - 1).cast("long").alias("slot"), "grown_shard")
