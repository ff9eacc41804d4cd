import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from lattica.llm import sharding

SF = "/root/testdata/sf0.001"


def winner(key: str, weights):
    scores = []
    for s, w in enumerate(weights):
        bits = int(hashlib.md5(f"{key}#{s}".encode()).hexdigest()[:13], 16)
        scores.append((-math.log((bits + 0.5) / 2**52) / w, s))
    return min(scores)[1]


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in sharding.op1_rendezvous(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    slots = defaultdict(list)
    for i, t in texts.items():
        r, b = got[i], (t or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(b) + 16, zlib.crc32(b), "key")
        assert r.shard == winner(f"v{i}", [1.0] * 40) and r.grown_shard == winner(f"v{i}", [1.0] * 41)
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_weights_and_growth(spark):
    df = spark.range(4000)
    weights = [1.0, 2.0, 1.0]
    rows = sharding.rendezvous(df, ["id"], weights, grown=1.0).collect()
    share = Counter(r.shard for r in rows)
    assert abs(share[1] / 4000 - 0.5) < 0.04 and abs(share[0] / 4000 - 0.25) < 0.04
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    assert abs(sum(r.grown_shard == 3 for r in rows) / 4000 - 0.2) < 0.04
    less = {r.id: r.shard for r in sharding.rendezvous(df, ["id"], [1.0, 1.0, 1.0]).collect()}
    assert all(r.shard == less[r.id] or r.shard == 1 for r in rows)  # more weight only attracts


def test_slots_do_not_depend_on_settings(spark):
    told = []
    for n in ("4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        told.append({r.doc_id: r.slot for r in sharding.op1_rendezvous(spark, SF).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert told[0] == told[1]


def test_edges(spark):
    rows = [(None, "a", "x"), (None, "a", "x"), ("n", None, "y"), ("1", "", "z"), ("1", "é" * 50000, "z")]
    df = spark.createDataFrame(rows, "k string, text string, other string")
    got = sharding.with_slots(sharding.rendezvous(df, ["k"]), "shard", ["k", "text"]).collect()
    assert len(got) == 5 and len({r.shard for r in got if r.k is None}) == 1 and len({r.shard for r in got if r.k == "1"}) == 1
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.with_slots(sharding.rendezvous(df.limit(0), ["k"]), "shard", ["k"]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(df.withColumnRenamed("other", "Shard"), ["k"])
    with pytest.raises(ValueError):
        sharding.rendezvous(df, ["k"], [1.0, 0.0])
    a, b = (spark.createDataFrame([x], "a string, b string") for x in (("a|", "b"), ("a", "|b")))
    assert a.select(sharding.key_text("a", "b")).first() != b.select(sharding.key_text("a", "b")).first()
