"""Op 2: exact duplicates by an exchange of Golomb-coded fingerprints.

1. The rows are written once to a table in the shared folder, bucketed by block (the task that wrote
   them), with a 64-bit fingerprint and SHA-256 of the normalised text.
2. Each block sends every owner (a range of fingerprints) its sorted distinct fingerprints as
   Golomb-Rice coded gaps: about log2(gap)+1.5 bits each, and one each however often it repeats.
3. Owners answer each block with a bitmap: which of those fingerprints another block has too.
4. A block joins its bitmap on its bucket, so text doesn't move; only texts of suspects are shuffled
   and grouped by their bytes, combined before the shuffle.

Defined cases: null text is empty; A-Z only are lower-cased; of equal texts the largest doc_id stays
(null counts as the least; among rows equal in that too, the first as written); texts are read whole,
however long; other columns pass through, and one with the name of a result raises (`added` gives the
results other names; keep_one() takes free ones); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, free_name, shuffle_partitions, slices, staged, staged_table

ADDED = ("keep_id", "group_size", "kept", "text_sha256")
#: Fingerprints that an owner is planned for.
OWNER_ROWS = 2_000_000


def golomb(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rice parameter, unary quotients, fixed-width remainders of the gaps of sorted uint64 values."""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, float(values[-1]) / len(values)))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = b""
    if k:
        bits = ((gaps[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        rest = np.packbits(bits).tobytes()
    return k, np.packbits(unary).tobytes(), rest


def ungolomb(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = np.diff(ones, prepend=-1).astype(np.uint64) - np.uint64(1)
    if k:
        bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k)
        low = np.zeros(n, np.uint64)
        for i in range(k):
            low = (low << np.uint64(1)) | bits[:, i]
        gaps = (gaps << np.uint64(k)) | low
    return np.cumsum(gaps, dtype=np.uint64)


def fingerprints(batches: Iterator) -> Iterator:
    """Adds the columns __fp and __sha to Arrow batches whose column `__text` is the text."""
    import hashlib

    import pyarrow as pa
    import xxhash

    for batch in slices(batches):
        texts = [x.lower() for x in as_bytes(batch.column("__text"))]
        names = [x for x in batch.schema.names if x != "__text"]
        fp = pa.array(np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64).view(np.int64))
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), fp, sha], names=[*names, "__fp", "__sha"])


def lowered(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches):
        names = [x for x in batch.schema.names if x != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array([x.lower() for x in as_bytes(batch.column("__text"))], pa.binary())], names=[*names, "__bytes"])


def owner_of(fp: np.ndarray, owners: int) -> np.ndarray:
    """Equal ranges of the top 32 bits."""
    return ((fp >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def send(owners: int):
    def of_block(rows):
        """A block's rows (__block, __fp) to messages for owners."""
        import pandas as pd

        fp = np.unique(rows["__fp"].to_numpy().view(np.uint64))
        to = owner_of(fp, owners).astype(np.int64)
        out = []
        for at in np.split(np.arange(len(fp)), np.flatnonzero(np.diff(to)) + 1):
            first = np.uint64(-(-(int(to[at[0]]) << 64) // owners) & 0xFFFFFFFF_00000000) if owners > 1 else np.uint64(0)
            first = min(first, fp[at[0]])
            out.append((int(rows["__block"].iloc[0]), int(to[at[0]]), len(at), int(first.astype(np.int64)), *golomb(fp[at] - first)))
        return pd.DataFrame(out, columns=["__block", "__owner", "n", "first", "k", "unary", "rest"])

    return of_block


def answer(messages):
    """An owner's messages to a bitmap for each: is the fingerprint in other blocks too?"""
    import pandas as pd

    blocks = [ungolomb(m.n, m.k, m.unary, m.rest) + np.array(m.first, np.int64).astype(np.uint64) for m in messages.itertuples()]
    values = np.sort(np.concatenate(blocks))
    twice = np.unique(values[1:][values[1:] == values[:-1]])
    bitmaps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in blocks]
    return pd.DataFrame({"__block": messages["__block"], "__owner": messages["__owner"], "n": messages["n"], "bitmap": bitmaps})


def receive(rows, bitmaps):
    """A block's rows (__pos, __fp) and its owners' bitmaps to one bitmap by position, duplicates inside the block included."""
    import pandas as pd

    fp, back, often = np.unique(rows["__fp"].to_numpy().view(np.uint64), return_inverse=True, return_counts=True)
    told = bitmaps.sort_values("__owner")
    seen = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(told["bitmap"], told["n"], strict=True)]).astype(bool)
    by_pos = np.zeros(int(rows["__pos"].max()) + 1, np.uint8)
    by_pos[rows["__pos"].to_numpy()] = (seen | (often > 1))[back]
    return pd.DataFrame({"__block": rows["__block"].iloc[:1], "__bits": [np.packbits(by_pos).tobytes()]})


def mark_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", added: Sequence[str] = ADDED) -> DataFrame:
    """docs with four more columns, called `added`: the id that stays, the group's size, whether the row stays, and the SHA-256."""
    spark = docs.sparkSession
    names = docs.columns
    if clash := {c.lower() for c in names} & {c.lower() for c in added}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    of = lambda name: F.col(f"__doc.`{name}`")
    parts = shuffle_partitions(spark)
    id_type = docs.schema[doc_id].dataType.simpleString()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__doc"), F.monotonically_increasing_id().alias("__row"), F.col(text).alias("__text"))
    kind = T.StructType([packed.schema["__doc"], T.StructField("__row", T.LongType()), T.StructField("__fp", T.LongType()), T.StructField("__sha", T.StringType())])
    rows = packed.mapInArrow(fingerprints, kind)
    rows = rows.withColumns({"__block": F.shiftright("__row", 33).cast("int"), "__pos": F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)).cast("int")}).drop("__row")
    rows = staged_table(rows, "exact_dedup", parts, "__block")
    owners = max(parts, rows.count() // OWNER_ROWS)

    own = rows.select("__block", "__pos", "__fp")
    sent = own.select("__block", "__fp").groupBy("__block").applyInPandas(send(owners), "__block int, __owner long, n int, first long, k int, unary binary, rest binary")
    answers = sent.groupBy("__owner").applyInPandas(answer, "__block int, __owner long, n int, bitmap binary")
    bits = staged(own.groupBy("__block").cogroup(answers.groupBy("__block")).applyInPandas(receive, "__block int, __bits binary"), "dedup-bits").hint("merge")

    def flagged(frame: DataFrame) -> DataFrame:
        byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__pos", 3) + 1, F.lit(1))), 16, 10).cast("int")
        return frame.join(bits, "__block").withColumn("__byte", byte).withColumn("__suspect", F.expr("shiftright(__byte, 7 - (__pos & 7)) & 1 = 1")).drop("__bits", "__byte")

    # Text moves for suspects alone, and as one row for each text and task.
    texts = flagged(rows.select("__block", "__pos", "__sha", of(doc_id).alias("__id"), of(text).alias("__text"))).filter("__suspect").select("__sha", "__id", "__text")
    texts = texts.mapInArrow(lowered, f"__sha string, __id {id_type}, __bytes binary")
    groups = texts.groupBy("__sha", "__bytes").agg(F.max("__id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1").drop("__bytes")
    groups = staged(groups, "dedup-groups")
    thin = flagged(rows.select("__block", "__pos", "__sha", of(doc_id).alias("__id"))).filter("__suspect")
    first = thin.join(groups.withColumnRenamed("__sha", "__g"), F.col("__sha").eqNullSafe(F.col("__g")) & F.col("__id").eqNullSafe(F.col("keep_id")))
    first = first.groupBy("__g").agg(F.min(F.struct("__block", "__pos")).alias("__first")).withColumnRenamed("__g", "__sha")
    groups = groups.join(first, "__sha")

    # Rows that nobody shares go past the join, so no null key gathers them.
    marked = flagged(rows)
    results = (F.col("keep_id"), F.col("group_size").cast("long"), F.col("kept"), F.col("__sha"))
    order = [*[of(c).alias(c) for c in names], *[x.alias(c) for x, c in zip(results, added, strict=True)]]
    alone = marked.filter("not __suspect").withColumns({"keep_id": of(doc_id), "group_size": F.lit(1), "kept": F.lit(True)})
    # A block asks once for each of its texts, so a hot text has a row for each block here, not for each copy.
    asked = flagged(rows.select("__block", "__pos", "__sha")).filter("__suspect").select("__block", "__sha").distinct()
    told = asked.join(groups, "__sha")
    shared = marked.filter("__suspect").join(told, ["__block", "__sha"], "left")
    shared = shared.withColumn("kept", F.col("__first").isNull() | ((F.col("__block") == F.col("__first.__block")) & (F.col("__pos") == F.col("__first.__pos"))))
    shared = shared.withColumn("keep_id", F.when(F.col("__first").isNull(), of(doc_id)).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1)))
    return alone.select(*order).unionByName(shared.select(*order))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without rows whose text a kept row has; the columns of docs."""
    added = [free_name(docs.columns, c) for c in ADDED]
    return mark_duplicates(docs, text, doc_id, added).filter(F.col(added[2])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_golomb_exchange(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mark_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""
