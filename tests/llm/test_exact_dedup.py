import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from lattica.llm import exact_dedup as ed
from lattica.llm import shared


@settings(max_examples=60, deadline=None)
@given(some.sets(some.integers(0, 2**64 - 1), min_size=1, max_size=300))
def test_golomb_codes_round_trip(values):
    x = np.array(sorted(values), np.uint64)
    np.testing.assert_array_equal(ed.ungolomb(len(x), *ed.golomb(x)), x)


def test_codes_are_short():
    x = np.sort(np.random.default_rng(0).integers(0, 2**40, 10000, dtype=np.uint64))
    x = np.unique(x)
    k, unary, rest = ed.golomb(x)
    assert 8 * (len(unary) + len(rest)) / len(x) < np.log2(2**40 / len(x)) + 2


def low(text):
    return (text or "").encode().lower()


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", "A b", "a B", "É x", "é x", "long " * 20000] + [f"t{rng.integers(0, 40)}" for _ in range(300)] + ["hot"] * 150
    rows = [(int(i), t, f"e{i}", True) for i, t in enumerate(texts)] + [(5, "hot", "dup", False), (459, "hot", "same", True), (459, "hot", "same", True), (None, "hot", "n", True), (None, "only null", "n", True), (None, "only null", "m", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string, kept boolean").repartition(7)
    with pytest.raises(ValueError):
        ed.mark_duplicates(docs)
    got = ed.mark_duplicates(docs.withColumnRenamed("kept", "mine")).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    assert len(got) == len(rows)
    alive = defaultdict(int)
    for r in got:
        own = groups[low(r.text)]
        top = max((x for x in own if x is not None), default=None)
        assert (r.keep_id, r.group_size) == (top, len(own)), r
        assert r.text_sha256 == hashlib.sha256(low(r.text)).hexdigest()
        alive[low(r.text)] += r.kept
        assert not r.kept or r.doc_id == top
    assert set(alive.values()) == {1}
    kept = ed.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert ed.mark_duplicates(docs.limit(0).drop("kept")).count() == 0


def test_columns_of_users_keep_their_values(spark):
    """Names of the results, in any case, are no names of keep_one()'s."""
    rows = [(i, f"t{i % 3}", f"k{i}", -i, i % 2 == 0, f"s{i}", f"d{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string, Group_Size long, kept boolean, text_sha256 string, __doc string")
    assert sorted(map(tuple, ed.keep_one(docs).collect())) == rows[6:]


def test_staged_tables_go_with_temporary(spark):
    from pathlib import Path

    docs = spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string")
    folder = Path(shared.shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    with shared.temporary(spark):
        assert ed.keep_one(docs).count() == 1
        assert set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("exact_dedup_") and t.name in {p.name for p in folder.iterdir()} - {p.name for p in before}]


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    """The bytes decide: with every fingerprint equal the result is the same."""
    import pyarrow as pa

    real = ed.fingerprints

    def same(batches):
        for b in real(batches):
            yield b.set_column(b.schema.get_field_index("__fp"), "__fp", pa.array([7] * b.num_rows, pa.int64()))

    monkeypatch.setattr(ed, "fingerprints", same)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in ed.mark_duplicates(docs).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}
