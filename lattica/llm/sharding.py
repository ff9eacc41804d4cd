"""Op 1: weighted rendezvous hashing, with DataFrame functions only.

A record's score for a shard is -ln(u)/weight, with u in (0, 1) taken from the first 52 bits of
md5(key '#' shard); the least score wins. Scores depend on nothing but the key, the shard's number
and its weight, so a new shard takes records only into itself, and a changed weight moves records
only to or from that shard.

Defined cases: a null key is a key of its own (distinct from every string); equal keys share a
shard, and at equal scores the lower shard wins; a null text has size 16 and CRC 0; very long texts
count by their bytes, whole; rows equal in all order columns take any order among their own slots; an
empty table gives an empty result; columns with the names of the results raise, unless other names are
passed; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shards of the query, and lots into which a shard's rows are dealt to be numbered.
SHARDS, LOTS = 40, 64


def key_text(*columns: str) -> Column:
    """The key as text: null and strings never meet, and neither do ('a', 'bc') and ('ab', 'c')."""
    parts = [F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.regexp_replace(F.col(c).cast("string"), "([|\\\\])", "\\\\$1"))) for c in columns]
    return F.concat_ws("|", *parts)


def score(key: Column, shard: int, weight: float) -> Column:
    if not weight > 0:
        raise ValueError("weights must be above 0")
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{shard}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(weight))


def best(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, shard) of the winner; at equal scores the lower shard."""
    rivals = [F.struct(score(key, first + i, w).alias("score"), F.lit(first + i).alias("shard")) for i, w in enumerate(weights)]
    return F.least(*rivals) if len(rivals) > 1 else rivals[0]


def rendezvous(df: DataFrame, keys: Sequence[str], weights: Sequence[float] = (1.0,) * SHARDS, grown: float | None = None, shard_col: str = "shard", grown_col: str = "grown_shard") -> DataFrame:
    """df with its shard under `weights` and, with `grown`, the shard if one of that weight were added. No shuffle."""
    taken = {c.lower() for c in df.columns}
    if clash := [c for c in (shard_col, grown_col, "__won") if c.lower() in taken]:
        raise ValueError(f"columns exist already: {clash}")
    key = key_text(*keys)
    out = df.withColumn("__won", best(key, weights)).withColumn(shard_col, F.col("__won.shard"))
    rival = None if grown is None else best(key, [grown], len(weights))
    wider = F.lit(None).cast("int") if rival is None else F.when(rival < F.col("__won"), F.lit(len(weights))).otherwise(F.col(shard_col))
    return out.withColumn(grown_col, wider).drop("__won")


def with_slots(df: DataFrame, shard_col: str, order: Sequence[str], lots: int = LOTS, slot_col: str = "slot") -> DataFrame:
    """df with gapless places from 0 within each shard.

    A shard's rows are dealt into `lots` by a hash of the order columns; each lot is numbered by
    itself, after the rows of the lots before it. So a task holds a lot, not a shard. The counts
    (shards x lots rows, both given) are the only thing broadcast. Slots depend on `lots`, on nothing else of a session.
    """
    dealt = df.withColumn("__lot", F.pmod(F.xxhash64(*order), F.lit(lots)).cast("int"))
    counts = dealt.groupBy(F.col(shard_col).alias("__s"), F.col("__lot").alias("__l")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__s").orderBy("__l").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(shard_col, "__lot").orderBy(*order)
    placed = dealt.withColumn("__at", F.row_number().over(inside)).join(F.broadcast(starts), (F.col(shard_col) == F.col("__s")) & (F.col("__lot") == F.col("__l")))
    return placed.withColumn(slot_col, F.col("__start") + F.col("__at") - 1).drop("__s", "__l", "__start", "__at", "__lot")


def op1_rendezvous(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rendezvous(rows, ["doc_id"], grown=1.0)
    out = with_slots(rows, "shard", ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"))
