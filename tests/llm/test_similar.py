import random

import numpy as np
import pytest

from lattica.llm import similar, simhash

SF = "/root/testdata/sf0.01"


def plain_set(text, n=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain_classes(texts, similarity=0.8):
    """Texts by id to classes, from all pairs."""
    sets, root = {i: plain_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j >= i:
                break
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and (a == b or len(a & b) / len(a | b) >= similarity):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def kept(spark, texts, **options):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in simhash.keep_one_similar(docs, **options).collect())


def test_table_equals_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert kept(spark, texts) == sorted(set(plain_classes(texts).values()))


@pytest.mark.parametrize("lot,share,block", [(3, 0.3, 2000), (7, 0.05, 500)])
def test_planted_copies_are_found(spark, monkeypatch, lot, share, block):
    """Copies of similarity 0.8 to 0.95, around one base and in chains, among texts with common passages."""
    for name, value in (("LOT", lot), ("SHARE", share), ("BLOCK", block)):
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    texts, planted = {}, 0
    for b in range(60):
        size = rng.choice([12, 40, 100, 200, 500])
        base = [f"w{rng.randrange(400)}" for _ in range(size)] + (passage.split() if b % 3 == 0 else [])
        texts[len(texts)] = " ".join(base)
        for _ in range(rng.choice([0, 1, 6])):
            copy = list(base)
            for _ in range(max(1, round(len(base) * rng.choice([0.006, 0.01, 0.015, 0.02, 0.03])))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.15:
                copy = copy[: -max(1, len(copy) // 10)]
            texts[len(texts)] = " ".join(copy)
            planted += 0.8 <= len(plain_set(texts[len(texts) - 1]) & plain_set(" ".join(base))) / len(plain_set(texts[len(texts) - 1]) | plain_set(" ".join(base))) <= 0.95
    assert planted > 30
    assert kept(spark, texts) == sorted(set(plain_classes(texts).values()))


def test_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(3, words, 1), (9, words.replace("w50 ", "zz "), 2), (4, words.upper(), 3), (1, None, 4), (2, " ", 5), (None, words, 6), (3, words, 7), (7, "alone here", 8), (None, "null alone", 9), (None, "Null  alone", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").coalesce(1)
    got = simhash.keep_one_similar(docs)
    assert got.columns == docs.columns
    assert sorted(r.row for r in got.collect()) == [1, 4, 8, 9]
    assert simhash.keep_one_similar(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.keep_one_similar(docs, similarity=0.0)


@pytest.mark.parametrize("parts", [[8], [1] * 8, [3, 5], [4, 1, 3]])
def test_runs_over_batches(parts):
    import pyarrow as pa

    tokens = np.array([1, 2, 2, 2, 3, 4, 4, 4])
    at = np.cumsum([0, *parts])
    batches = [pa.RecordBatch.from_arrays([pa.array(tokens[a:b]), pa.array(np.arange(a, b))], names=["token", "row"]) for a, b in zip(at, at[1:], strict=False)]
    got = [(key, [v for c in rest for v in c.to_pylist()]) for key, rest in similar.runs(iter(batches), ("token",), ("row",))]
    assert got == [((1,), [0]), ((2,), [1, 2, 3]), ((3,), [4]), ((4,), [5, 6, 7])]


def test_census_leaves_nothing_out(spark):
    """Whoever has a similar text stays; most texts that share little are left out."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    classes = plain_classes(texts)
    docs = spark.createDataFrame(list(texts.items()), "row long, text string").repartition(3)
    kept = {r.row for r in similar.not_alone(docs, 5, 42, 0.8).collect()}
    grouped = {i for i in texts if sum(c == classes[i] for c in classes.values()) > 1}
    assert grouped <= kept and len(kept) < len(texts) / 2


def test_pairs_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """One group, most of it linked only through a fifth of its texts, so that a leading text leaves most apart."""

    def group(size):
        rng, texts = random.Random(3), {}
        for i in range(size):
            words = [f"w{j}" for j in range(150)]
            for j in rng.sample(range(5, 145), 2 if i < 0.8 * size else 1):
                words[j] = f"x{i}_{j}"
            texts[i] = " ".join(words)
        return texts

    def made(size):
        counts, write = [], similar.staged

        def counting(df, name, keep=False):
            out = write(df, name, keep)
            if name == "similar-pairs":
                counts.append(out.count())
            return out

        texts = group(size)
        with monkeypatch.context() as m:
            m.setattr(similar, "staged", counting)
            assert kept(spark, texts) == sorted(set(plain_classes(texts).values()))
        return sum(counts)

    few, many = made(50), made(400)
    assert many < 16 * few  # eight times the texts: sixty-four times the pairs
