"""Links between texts whose word-shingle sets have a Jaccard similarity of `similarity` or more, without loss.

1. Census. A text of n shingles has at most n - ceil(similarity*n) that a similar one lacks. So a text
   with more shingles than that which no other text has is alone. Shingles in the least `SHARE` of hash
   values are counted: a task sends blocks of their sorted fingerprints, packed, to owners of hash ranges,
   and owners answer each block with the number of shared ones by row, packed too. (Fingerprints have 32 bits within their
   owner's range; two that meet by chance can only keep a text in, never leave one out.)
2. Fingerprints. Of the texts left, SimHash fingerprints few bits apart are linked by pigeonhole blocks.
3. Prefixes. Two similar texts share one of the first n - ceil(similarity*n) + 1 shingles of each, in any
   one order of all (prefix filter); rare shingles come first. Texts that share one form its bucket. A
   candidate a row (the first of about its size) lets large groups hang together as stars. Then buckets are
   compared in rounds: of rows in different components yet, less those ruled out by size or parity sketch
   (bit b says whether an odd number of shingles fall on it, so two sketches differ in no more bits than the
   sets do in shingles), each row gives its nearest, so a round makes no more pairs than buckets have rows.
   What is verified joins components, what is not is left out of the next round, and only buckets with pairs
   to spare go on. When most of a round's pairs are not similar, little is left to join: the last round gives
   every pair still open. A bucket above `LOT` rows is dealt into lots, and each pair of lots is compared by itself.

All candidates, fingerprints included, are verified on the texts themselves.

Rows without words have empty sets and equal each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_bytes, few, majority, shuffle_partitions, slices, staged

SIMILARITY, BITS = 0.8, 1024
#: Part of the range of hashes that the census counts, shingles that a task sends at a time, and those an owner is planned for.
SHARE, BLOCK, OWNER = 0.3, 1 << 20, 1 << 22
#: Rows of a bucket in a lot, and those that are compared with others at a time.
LOT, STEP = 1 << 14, 256
#: Rounds, at most, in which a row of a bucket gives its nearest only; then all pairs that are still open.
ROUNDS = 8
#: Place of a shingle that its own task knows to be shared.
KNOWN = 0xFFFFFFFF


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 of the distinct shingles, sorted; a text of fewer words is one shingle."""
    import xxhash

    own = text.lower().split()  # bytes: A-Z, and splits at 0x20 and 0x09-0x0D
    if not own:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(own[i : i + words]), seed) for i in range(max(1, len(own) - words + 1))], np.uint64))


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def counted(share: float) -> int:
    """Hashes below this are counted by the census."""
    return int(share * 2**64)


CENSUS = "owner int, block long, base long, tokens binary, low binary, high binary, rows binary, amounts binary"
ANSWER = "block long, rows binary, amounts binary"


def census_batches(words: int, seed: int, similarity: float, owners: int, share: float, block: int):
    """Rows (row, text) to messages. Of a row it tells -spare: it is alone if no more than `spare` of its counted shingles are shared."""
    most = counted(share)
    width = -(-most // owners)
    shift = np.uint64(max(0, width.bit_length() - 32))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() << 32

        def message(owner, base, tokens=b"", low=b"", high=b"", rows=b"", amounts=b""):
            return pa.RecordBatch.from_arrays([pa.array([owner], pa.int32()), pa.array([turn], pa.int64()), pa.array([base], pa.int64()), *(pa.array([x], pa.binary()) for x in (tokens, low, high, rows, amounts))], names=["owner", "block", "base", "tokens", "low", "high", "rows", "amounts"])

        def send(sets, rows, spares):
            base, rows = min(rows), np.array(rows, np.int64)
            token, place = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
            order = np.argsort(token)
            token, place = token[order], place[order]
            again = np.concatenate([[False], token[1:] == token[:-1]]) if len(token) else np.zeros(0, bool)
            known = again | np.concatenate([again[1:], [False]]) if len(token) else again
            amounts = np.bincount(place[known], minlength=len(sets)) - np.array(spares)
            yield message(((turn >> 32) + turn) % owners, base, rows=rows.tobytes(), amounts=amounts.astype(np.int32).tobytes())
            at = np.where(known, KNOWN, rows[place] - base).astype(np.uint32)[~again]
            token = token[~again]
            to = (token // np.uint64(width)).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = ((token[a:b] - np.uint64(int(to[a]) * width)) >> shift).astype("<u4")
                yield message(int(to[a]), base, part.tobytes(), (at[a:b] & 0xFFFF).astype("<u2").tobytes(), (at[a:b] >> 16).astype("<u2").tobytes())

        sets, rows, spares, held = [], [], [], 0
        for batch in slices(batches):
            for row, text in zip(batch.column("row").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if rows and (held >= block or not rows[0] <= row < rows[0] + KNOWN):
                    yield from send(sets, rows, spares)
                    sets, rows, spares, held, turn = [], [], [], 0, turn + 1
                h = shingles(text, words, seed)
                own = h[: np.searchsorted(h, np.uint64(most))]
                sets.append(own)
                rows.append(row)
                spares.append(len(own) - prefix_size(len(h), similarity))
                held += len(own) + 16
        if rows:
            yield from send(sets, rows, spares)

    return run


def census_answer(messages):
    """An owner's messages to (block, rows, amounts): how many of its shingles other rows have too. What a block tells of its own rows goes through."""
    import pyarrow as pa

    tokens, rows, blocks, out = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for i, (block, base, token, low, high, own, amounts) in enumerate(zip(*(messages.column(c).to_pylist() for c in ("block", "base", "tokens", "low", "high", "rows", "amounts")), strict=True)):
        if own:
            out.append((block, own, amounts))
        place = np.frombuffer(low, "<u2").astype(np.int64) | np.frombuffer(high, "<u2").astype(np.int64) << 16
        tokens.append(np.frombuffer(token, "<u4"))
        rows.append(np.where(place == KNOWN, -1, base + place))
        blocks.append(np.full(len(place), i))
    token, row, block = np.concatenate(tokens), np.concatenate(rows), np.concatenate(blocks)
    order = np.argsort(token)
    token = token[order]
    again = np.concatenate([[False], token[1:] == token[:-1]]) if len(token) else np.zeros(0, bool)
    shared = np.zeros(len(token), bool)
    shared[order] = again | np.concatenate([again[1:], [False]]) if len(token) else again
    shared &= row >= 0
    row, block = row[shared], block[shared]
    cuts = np.searchsorted(block, np.arange(messages.num_rows + 1))
    names = messages.column("block").to_pylist()
    for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if y > x:
            own, count = np.unique(row[x:y], return_counts=True)
            out.append((names[i], own.tobytes(), count.astype(np.int32).tobytes()))
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("block", "rows", "amounts"), zip(*out, strict=True) if out else ((), (), ()), (pa.int64(), pa.binary(), pa.binary()), strict=True)})


def census_sum(answers):
    """A block's answers to its rows that may have similar ones: those with more shared shingles than they can spare."""
    import pyarrow as pa

    row = np.concatenate([np.frombuffer(x, np.int64) for x in answers.column("rows").to_pylist()])
    amount = np.concatenate([np.frombuffer(x, np.int32) for x in answers.column("amounts").to_pylist()])
    rows, of = np.unique(row, return_inverse=True)
    return pa.table({"row": pa.array(rows[np.bincount(of, amount) > 0], pa.int64())})


def not_alone(docs: DataFrame, words: int, seed: int, similarity: float) -> DataFrame:
    """The rows of docs (row, text) that the census can't tell to be alone."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A shingle for every four bytes at most, as a rule; owners only share the work, so a wrong guess does no harm.
    owners = max(min(shuffle_partitions(spark), 64), math.ceil(SHARE * size / 4 / OWNER))
    sent = docs.mapInArrow(census_batches(words, seed, similarity, owners, SHARE, BLOCK), CENSUS)
    return sent.groupBy("owner").applyInArrow(census_answer, ANSWER).groupBy("block").applyInArrow(census_sum, "row long")


def prefix_batches(words: int, seed: int, similarity: float, share: float):
    """Rows (row, text) to their size, sketch, fingerprint, and counted shingles, others of least hash with them where those are too few for a prefix."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            sets = [shingles(x, words, seed) for x in as_bytes(batch.column("text"))]
            first = [h[: max(int(np.searchsorted(h, np.uint64(counted(share)))), prefix_size(len(h), similarity))] if len(h) else np.zeros(1, np.uint64) for h in sets]
            over = [len(x) - prefix_size(len(h), similarity) for x, h in zip(first, sets, strict=True)]
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)))
            sketch = [np.packbits((np.bincount((h % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes() for h in sets]
            fp = np.array([majority(h) for h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([len(h) for h in sets], pa.int32()), pa.array(over, pa.int32()), pa.array(fp), pa.array(sketch, pa.binary()), lists], names=["row", "n", "over", "fp", "sketch", "tokens"])

    return run


def buckets_of(rows: DataFrame) -> DataFrame:
    """Rows of prefix_batches() to (token, row, n, lots, lot): the prefix shingles that more than one row has in its prefix."""
    every = rows.select(F.explode("tokens").alias("token"), "row", "n", "over")
    often = staged(every.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"), "similar-often")
    of_row = Window.partitionBy("row")
    # Rare shingles first. (Rows that need shingles beyond the census' range have no others left over: `over` is 0.)
    rank = F.row_number().over(of_row.orderBy("often", "token"))
    met = every.join(often, "token").withColumns({"rank": rank, "shared": F.count("*").over(of_row)})
    # Shingles that nobody shares come before all others and fill the prefix by themselves.
    met = staged(met.where("rank <= shared - over").select("token", "row", "n"), "similar-prefixes")
    sizes = met.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token", F.ceil(F.col("size") / LOT).cast("int").alias("lots"))
    return staged(met.join(staged(sizes, "similar-sizes"), "token").withColumn("lot", F.pmod(F.xxhash64("row"), F.col("lots")).cast("int")), "similar-met")


def possible_batches(similarity: float):
    """Of pairs with sizes and sketches, those that these allow."""

    def run(batches: Iterator) -> Iterator:
        for batch in slices(batches, 4096):
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("x", "y"))
            fits = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6
            fits &= np.bitwise_count(x ^ y).sum(axis=1) <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6
            yield batch.select(["a", "b"]).take(np.flatnonzero(fits))

    return run


def runs(batches: Iterator, key: tuple[str, ...], rest: tuple[str, ...]) -> Iterator:
    """Batches sorted by the key columns (whole numbers) to the other columns of each key, as Arrow arrays; the key's values first."""
    import pyarrow as pa

    last, held = None, []

    def out():
        return last, [pa.concat_arrays([h.column(c) for h in held]) for c in rest]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in key]
        new = np.zeros(batch.num_rows - 1, bool)
        for x in keys:
            new |= np.diff(x) != 0
        edges = np.concatenate([[0], np.flatnonzero(new) + 1, [batch.num_rows]]).tolist()
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(int(x[i]) for x in keys)
            if held and now != last:
                yield out()
                held = []
            last = now
            held.append(batch.slice(i, j - i))
    if held:
        yield out()


def mixed_batches(batches: Iterator) -> Iterator:
    """Rows (token, lot, lots, n, row, root) sorted by token and lot: those of buckets with more than one root. A lot of several can't tell."""
    import pyarrow as pa

    def mixed(batch, edges):
        root, lots = batch.column("root").to_numpy(), batch.column("lots").to_numpy()
        kept = (np.minimum.reduceat(root, edges[:-1]) != np.maximum.reduceat(root, edges[:-1])) | (lots[edges[:-1]] > 1)
        return batch.filter(pa.array(np.repeat(kept, np.diff(edges))))

    held = None  # the last bucket so far, which may go on
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if batch.num_rows else held
        if not batch.num_rows:
            continue
        token, lot = batch.column("token").to_numpy(), batch.column("lot").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((np.diff(token) != 0) | (np.diff(lot) != 0)) + 1, [len(token)]])
        held = batch.slice(int(edges[-2]))
        if len(edges) > 2:
            yield mixed(batch.slice(0, int(edges[-2])), edges[:-1])
    if held is not None:
        yield mixed(held, np.array([0, held.num_rows]))


def pair_batches(similarity: float, step: int, every: bool):
    """Rows (token, a, b, lot, n, row, root, sketch, ruled), sorted by token, a, b and n, to pairs (a, b) of different roots that size and sketch allow.

    Where a and b differ, only rows of different lots are compared. A row's `ruled` are those that it is known not to be similar to.
    Unless `every`, a row gives its nearest by sketch only, at most a pair for each row; `open` is the token of a bucket that has more."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def table(token, found, more):
            pairs = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
            return pa.RecordBatch.from_arrays([*pairs, pa.array([token if more else None] * len(pairs[0]), pa.int64())], names=["a", "b", "open"])

        for (token, a, b), (lot, n, row, root, sketch, ruled) in runs(batches, ("token", "a", "b"), ("lot", "n", "row", "root", "sketch", "ruled")):
            lot, n, row, root = lot.to_numpy(), n.to_numpy().astype(np.int64), row.to_numpy(), root.to_numpy()
            roots, of, counts = np.unique(root, return_inverse=True, return_counts=True)
            if len(roots) < 2:
                continue
            sketch = np.frombuffer(b"".join(sketch.to_pylist()), np.uint64).reshape(len(n), BITS // 64)
            # Rows of the largest component are compared with the others only, not each with all.
            others = np.flatnonzero(of != counts.argmax())
            done = np.zeros(len(n), bool)
            found, held, more = [], 0, False
            for x in others:
                from_, to = np.searchsorted(n, [similarity * n[x] - 1e-6, n[x] / similarity + 1e-6])
                near = slice(int(from_), int(to))
                fits = (root[near] != root[x]) & ~done[near]
                if a != b:
                    fits &= lot[near] != lot[x]
                if ruled[x].is_valid:
                    fits &= ~np.isin(row[near], ruled[x].values.to_numpy())
                done[x] = True
                y = np.flatnonzero(fits) + near.start
                least, best = math.inf, None
                for i in range(0, len(y), step * 64):
                    z = y[i : i + step * 64]
                    apart = np.bitwise_count(sketch[z] ^ sketch[x]).sum(axis=1)
                    fits = apart <= (1 - similarity) / (1 + similarity) * (n[x] + n[z]) + 1e-6
                    z, apart = z[fits], apart[fits] / (n[x] + n[z][fits])
                    if not len(z):
                        continue
                    if not every:
                        more |= len(z) > 1 or best is not None
                        if apart.min() < least:
                            least, best = apart.min(), z[[apart.argmin()]]
                        continue
                    found.append((np.minimum(row[x], row[z]), np.maximum(row[x], row[z])))
                    held += len(z)
                if best is not None:
                    found.append((np.minimum(row[x], row[best]), np.maximum(row[x], row[best])))
                if held > 1 << 16:
                    yield table(token, found, False)
                    found, held = [], 0
            if found:
                yield table(token, found, more)

    return run


def verify_batches(words: int, seed: int, similarity: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            sides = [as_bytes(batch.column(c)) for c in ("x", "y")]
            good = pa.array([jaccard(shingles(x, words, seed), shingles(y, words, seed)) >= similarity for x, y in zip(*sides, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return run


def links(docs: DataFrame, components: Callable, fingerprint_links: Callable, words: int = 5, seed: int = 42, similarity: float = SIMILARITY) -> DataFrame:
    """docs (row, text) to links (a, b) of rows that span every component.

    components(links) gives (node, root); fingerprint_links(distinct fingerprints fp) gives pairs of them (a, b)."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must lie in (0, 1]")
    docs = staged(docs.join(few(not_alone(docs, words, seed, similarity), "similar-rows"), "row", "left_semi"), "similar-texts")
    rows = staged(docs.mapInArrow(prefix_batches(words, seed, similarity, SHARE), "row long, n int, over int, fp long, sketch binary, tokens array<long>"), "similar")
    known = rows.select("row", "n", "sketch")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar; texts are joined, since sets are larger and hardly compress."""
        both = pairs.join(docs.select(F.col("row").alias("a"), F.col("text").alias("x")), "a").join(docs.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")
        return staged(both.mapInArrow(verify_batches(words, seed, similarity), "a long, b long"), "similar-links")

    def possible(pairs: DataFrame) -> DataFrame:
        return staged(pairs.join(known.toDF("a", "n", "x"), "a").join(known.toDF("b", "m", "y"), "b").mapInArrow(possible_batches(similarity), "a long, b long"), "similar-pairs")

    by_fp = staged(rows.groupBy("fp").agg(F.min("row").alias("least")), "similar-fp")
    equal = rows.join(by_fp, "fp").where("row <> least").select(F.col("least").alias("a"), F.col("row").alias("b"))
    close = fingerprint_links(by_fp.select("fp")).join(by_fp.select(F.col("fp").alias("a"), F.col("least").alias("u")), "a")
    close = close.join(by_fp.select(F.col("fp").alias("b"), F.col("least").alias("v")), "b").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    met = buckets_of(rows)

    def voted(candidates: DataFrame) -> DataFrame:
        """Of the candidates (row, other) of each row, that of most buckets."""
        best = candidates.groupBy("row", "other").count().groupBy("row").agg(F.max_by("other", F.struct("count", "other")).alias("other"))
        return best.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b"))

    alike = Window.partitionBy("token", "lot", F.floor(F.log(F.col("n") + 1) / math.log(1.1))).orderBy("row")
    leading = voted(met.select("row", F.first("row").over(alike).alias("other")).where("row <> other"))
    found = verified(possible(equal.union(close).union(leading).distinct()))
    ruled, every, turn = None, False, 0
    while True:
        nodes = staged(components(found), "similar-nodes")
        mixed = with_roots(met, nodes).select("token", "lot", "lots", "n", "row", "root").repartition("token", "lot").sortWithinPartitions("token", "lot")
        mixed = mixed.mapInArrow(mixed_batches, "token long, lot int, lots int, n int, row long, root long").join(known.select("row", "sketch"), "row")
        mixed = mixed.join(ruled.groupBy("row").agg(F.collect_list("other").alias("ruled")), "row", "left") if ruled else mixed.withColumn("ruled", F.lit(None).cast("array<long>"))
        facing = F.explode(F.expr("transform(sequence(0, lots - 1), i -> struct(least(i, lot) as a, greatest(i, lot) as b))"))
        mixed = mixed.select("token", facing.alias("f"), "lot", "n", "row", "root", "sketch", "ruled").select("token", "f.a", "f.b", "lot", "n", "row", "root", "sketch", "ruled")
        mixed = mixed.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b", "n")
        pairs = staged(mixed.mapInArrow(pair_batches(similarity, STEP, every), "a long, b long, open long"), "similar-pairs")
        tried = staged(pairs.select("a", "b").distinct(), "similar-tried")
        good = verified(tried)
        # What hangs together by now, as stars, and what is new.
        found = nodes.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(good)
        left = few(pairs.where("open is not null").select(F.col("open").alias("token")).distinct(), "similar-open")
        if every or left.isEmpty():
            return found
        met = staged(met.join(left, "token", "left_semi"), "similar-met")
        apart = tried.join(good, ["a", "b"], "left_anti")
        apart = staged(apart.select(F.col("a").alias("row"), F.col("b").alias("other")).union(apart.select("b", "a")), "similar-ruled")
        ruled = ruled.unionByName(apart) if ruled else apart
        turn += 1
        every = turn == ROUNDS or 2 * good.count() < tried.count()


def with_roots(met: DataFrame, nodes: DataFrame) -> DataFrame:
    return met.join(nodes, F.col("row") == F.col("node"), "left").withColumn("root", F.coalesce("root", "row")).drop("node")
