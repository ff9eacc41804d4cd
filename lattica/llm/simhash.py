"""Op 8: near-duplicates by SimHash, pigeonhole blocks and connected components.

A fingerprint's 64 bits are cut into `BLOCKS` blocks. Two fingerprints at most `distance` bits apart
agree on at least BLOCKS-distance of them, so every close pair meets under one choice of that many
blocks. Distinct fingerprints are joined on those keys (as a sort by key; each key's run is the
bucket) and verified by Hamming distance. A bucket yields a spanning forest of its links, not all
pairs, which keeps components whole. A run above `RUN` is not held: it is dealt again by a second
choice of blocks, of the bits that the first left open; 48 bits are then fixed, so such a bucket has
2^16 distinct fingerprints at most.

Defined cases: null text is empty; without words the fingerprint is zero and links like any other;
rows without doc_id keep their class (the smallest doc_id in it, null if there is none); repeated rows
share class and fingerprint; of rows that tie in doc_id the first as written stays; other columns pass
through, whatever their names; an empty table gives an empty result; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import similar
from .shared import as_bytes, few, majority, slices, staged

DISTANCE, BLOCKS, RUN, BRUTE = 3, 6, 65_536, 8_192


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if over half of the shingles' XXH64 have it."""
    import xxhash

    own = text.lower().split()  # bytes: A-Z, and splits at 0x20 and 0x09-0x0D
    if not own:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(own) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(own)) - 1 :].tolist()
    return majority(np.array([digest(line[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64))


def fingerprint_batches(words: int, seed: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            fp = np.array([simhash(x, words, seed) for x in as_bytes(batch.column("__text"))], np.uint64).view(np.int64)
            names = [x for x in batch.schema.names if x != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(fp)], names=[*names, "__fp"])

    return run


def fingerprinted(docs: DataFrame, text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """docs without their text as a struct `__doc`, and the fingerprint `__fp` as a signed long."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("__doc"), F.col(f"`{text}`").alias("__text"))
    return packed.mapInArrow(fingerprint_batches(words, seed), T.StructType([packed.schema["__doc"], T.StructField("__fp", T.LongType())]))


def cut(bits: list[int], blocks: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(bits, int), blocks)]


def masks(open_bits: list[int], distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Masks of the bits of each choice of blocks-distance blocks."""
    return [sum(1 << int(b) for block in some for b in block) for some in combinations(cut(open_bits, blocks), blocks - distance)]


def open_after(mask: int) -> list[int]:
    return [b for b in range(64) if not mask >> b & 1]


def forest(fp: np.ndarray, distance: int, open_bits: list[int]) -> list[tuple[int, int]]:
    """Links (uint64 pairs) that span the components of fp under Hamming distance; large sets by a further choice of blocks."""
    if len(fp) > BRUTE and len(open_bits) >= 2 * BLOCKS:
        out = []
        for mask in masks(open_bits, distance):
            keys = fp & np.uint64(mask)
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            rest = [b for b in open_bits if not mask >> b & 1]
            for at in np.split(order, cuts):
                if len(at) > 1:
                    out += forest(fp[at], distance, rest)
        return out
    out, left = [], fp
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return out


def bucket_links(distance: int, choices: list[int], again: bool):
    """Sorted rows (choice, key, fp) to rows (a, b, choice, key): links have choice -1; the rest are members of long runs, dealt anew."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def table(links, dealt=()):
            a = np.array([x for x, _ in links], np.uint64).view(np.int64)
            b = np.array([y for _, y in links], np.uint64).view(np.int64)
            got = [(a, b, np.full(len(a), -1, np.int32), np.zeros(len(a), np.int64))]
            got += dealt
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got, strict=True)], names=["a", "b", "choice", "key"])

        def anew(fp, choice):
            for i, mask in enumerate(masks(open_after(choices[choice]), distance)):
                fixed = mask | choices[choice]
                yield fp.view(np.int64), np.zeros(len(fp), np.int64), np.full(len(fp), choice * 1000 + i, np.int32), (fp & np.uint64(fixed)).view(np.int64)

        def finish(choice, fp):
            fp = np.unique(fp)
            return forest(fp, distance, open_after(choices[choice])) if again else forest(fp, distance, [])

        last, held, large = None, [], False
        for batch in batches:
            choice, key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            if not len(fp):
                continue
            cuts = np.flatnonzero((np.diff(choice) != 0) | (np.diff(key) != 0)) + 1
            edges = np.concatenate([[0], cuts, [len(fp)]])
            links, dealt = [], []
            # Only the first and last run may go on in another batch; of those between, lone ones have no link.
            for i in np.flatnonzero((np.diff(edges) > 1) | (np.arange(len(edges) - 1) == 0) | (np.arange(len(edges) - 1) == len(edges) - 2)):
                at = slice(edges[i], edges[i + 1])
                now = (int(choice[at.start]), int(key[at.start]))
                if now != last:
                    if last and not large and sum(map(len, held)) > 1:
                        links += finish(last[0], np.concatenate(held))
                    last, held, large = now, [], False
                if large:
                    dealt += anew(fp[at], now[0])
                    continue
                held.append(fp[at])
                if again and sum(map(len, held)) > RUN:
                    dealt += anew(np.concatenate(held), now[0])
                    held, large = [], True
            if links or dealt:
                yield table(links, dealt)
        if last and not large and sum(map(len, held)) > 1:
            yield table(finish(last[0], np.concatenate(held)))

    return run


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct fingerprints `fp` to links (a, b) that span every component."""
    choices = masks(list(range(64)), distance)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = distinct.select(F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(choices)])).alias("k"), "fp").select("k.choice", "k.key", "fp")
    schema = "a long, b long, choice int, key long"
    first = staged(keyed.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(bucket_links(distance, choices, True), schema), "simhash-links")
    second = first.filter("choice >= 0").select("choice", "key", F.col("a").alias("fp")).repartition("choice", "key").sortWithinPartitions("choice", "key")
    second = second.mapInArrow(bucket_links(distance, choices, False), schema)
    return first.filter("choice < 0").unionByName(second).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge: alternating large and small stars, each round in the shared folder.

    A round hangs every node on the least one it knows of. Edges shrink to stars in about log rounds;
    the least neighbours are combined before each shuffle.
    """
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"), "components-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = after = staged(small, "components-small")
        # Stars only: no node both hangs on one and carries another, and none hangs on two.
        ends = after.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("carries")).union(after.select("v", F.lit(0), F.lit(1)))
        odd = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("carries").alias("carries")).filter("hangs > 1 or hangs > 0 and carries > 0")
        if odd.isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, seed: int = 42, distance: int = DISTANCE) -> DataFrame:
    """docs without their text as `__doc`, with fingerprint (16 hex digits) and component_id (the class's smallest doc_id)."""
    rows = staged(fingerprinted(docs, text, words, seed), "simhash")
    by_fp = staged(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(F.col(f"__doc.`{doc_id}`")).alias("least")), "simhash-fp")
    nodes = components(links(by_fp.select("fp"), distance))
    rooted = by_fp.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = staged(rooted.join(roots, "root").select("fp", "component_id"), "simhash-classes")
    return rows.join(classes, F.col("__fp") == F.col("fp")).select("__doc", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs without near-duplicates: of each class the row with the smallest doc_id stays; the columns of docs.

    Of rows that repeat that doc_id, one stays; rows without doc_id stay if their class has no doc_id,
    one for each class."""
    ided = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.monotonically_increasing_id().alias("row")), "simhash-docs")
    plain = ided.select("row", F.col(f"d.`{text}`").alias("text"), F.col(f"d.`{doc_id}`").alias("id"))
    found = near_duplicates(plain, "text", "id", **options).select(F.col("__doc.row").alias("row"), F.col("__doc.id").alias("id"), "component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("f"))
    # Null classes are told apart by fingerprint; linked fingerprints without any doc_id count as classes of their own.
    first = F.min(F.when(F.col("id").eqNullSafe(F.col("component_id")), F.col("row"))).alias("first")
    classes = found.groupBy("component_id", "f").agg(F.count("*").alias("rows"), first).filter("rows > 1")
    classes = classes.select(F.col("component_id").alias("c"), F.col("f").alias("g"), "first")
    dropped = found.join(classes, F.col("component_id").eqNullSafe(F.col("c")) & F.col("f").eqNullSafe(F.col("g"))).filter("row <> first").select("row")
    # Documents move only where the rows to drop are too many to broadcast.
    return ided.join(few(dropped, "simhash-dropped"), "row", "left_anti").select("d.*")


def keep_one_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, seed: int = 42, similarity: float = similar.SIMILARITY) -> DataFrame:
    """As keep_one, but for similar texts that 64 bits can't tell: rows linked by fingerprints are verified by the Jaccard
    similarity of their shingles, and the links that fingerprints miss are completed from the shingles themselves."""
    ided = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.monotonically_increasing_id().alias("row")), "similar-docs")
    nodes = components(similar.links(ided.select("row", F.col(f"d.`{text}`").alias("text")), components, links, words, seed, similarity))
    members = ided.select("row", F.col(f"d.`{doc_id}`").alias("id")).join(few(nodes, "similar-nodes"), F.col("node") == F.col("row")).select("root", "id", "row")
    # Of each class the least doc_id (null last), and of rows that repeat it the first.
    first = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).getField("row").alias("first"))
    dropped = members.join(first, "root").filter("row <> first").select("row")
    return ided.join(few(dropped, "similar-dropped"), "row", "left_anti").select("d.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select(F.col("__doc.doc_id").alias("doc_id"), "fingerprint", "component_id")
