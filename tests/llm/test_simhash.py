from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lattica.llm import simhash as sh

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps, distance=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    comp = plain_components(fps)
    least = defaultdict(lambda: 1 << 60)
    for r, c in zip(rows, comp, strict=True):
        least[c] = min(least[c], r.doc_id)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.op8_simhash(spark, SF).collect()}
    assert got == {r.doc_id: (f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, comp, strict=True)}


@pytest.mark.parametrize("text", ["", "a", "A b", "a b c", "x\ty\nz w", "É é É é", "w " * 70000])
def test_fingerprints(text):
    assert sh.simhash(text.encode()) == plain_fingerprint(text)


def clusters(rng, centers, each, flips):
    out = []
    for _ in range(centers):
        c = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(each):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
                x ^= 1 << int(b)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("run,brute", [(65536, 8192), (20, 8192), (20, 4)])
def test_links_span_the_same_components(spark, monkeypatch, run, brute):
    """Whole runs, runs dealt again, and buckets split inside a task give the same components."""
    monkeypatch.setattr(sh, "RUN", run)
    monkeypatch.setattr(sh, "BRUTE", brute)
    rng = np.random.default_rng(2)
    fps = clusters(rng, 6, 120, 3) + [int(x) for x in rng.integers(0, 2**64, 200, dtype=np.uint64)]
    fps = sorted(set(fps))
    comp = plain_components(fps)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long").repartition(3)
    found = sh.links(frame)
    edges = [(a % 2**64, b % 2**64) for a, b in found.select("a", "b").collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    nodes = {r.node % 2**64: r.root % 2**64 for r in sh.components(found).collect()}
    mine, theirs = defaultdict(set), defaultdict(set)
    for x, c in zip(fps, comp, strict=True):
        theirs[c].add(x)
        mine[nodes.get(x, x)].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(6, 40)] + [(7, 7), (200, 201), (201, 202), (200, 202)]
    got = {r.node: r.root for r in sh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(5, 40)} == {5} and {got[200], got[201], got[202]} == {200}
    assert sh.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows_and_keep_one(spark):
    words = " ".join(f"w{i}" for i in range(400))
    rows = [(3, words, "a"), (9, words.replace("w200", "zz"), "b"), (4, words.upper(), "c"), (1, None, "d"), (2, "", "e"), (None, words, "f"), (3, words, "a"), (7, "alone here now", "g"), (None, "null alone", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = [(r["__doc"].doc_id, r["__doc"].fingerprint, r.component_id, r.fingerprint) for r in sh.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    by = {x[1]: x for x in got}
    assert by["a"][2] == 3 and by["c"][2] == 3 and by["f"][2] == 3 and by["d"][2] == by["e"][2] == 1 and by["d"][3] == "0" * 16 and by["h"][2] is None
    kept = sh.keep_one(docs, words=5)
    assert kept.columns == docs.columns
    assert sorted(r.fingerprint for r in kept.collect() if r.fingerprint not in "bc") == ["a", "d", "g", "h"]
    assert sh.near_duplicates(docs.limit(0)).count() == 0 and sh.keep_one(docs.limit(0)).count() == 0
