import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lattica.llm import sampling

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
SCORES = {"▁": -3.0, "▁a": -1.0, "a": -2.0, "b": -2.5, "ab": -1.5, "ba": -1.2, "▁ab": -2.2, "aba": -2.0, "▁b": -1.7}


def segmentations(pieces, text):
    if not text:
        return [((), 0.0)]
    out = []
    for n in range(1, len(text) + 1):
        got = pieces.ids.get(text[:n])
        if got:
            out += [((got[0], *rest), got[1] + w) for rest, w in segmentations(pieces, text[n:])]
    return out


def test_samples_follow_the_distribution_without_replacement():
    pieces = sampling.Pieces(theta=1.0, scores=SCORES)
    lattice = sampling.Lattice(pieces)
    text = "▁aba▁ab"
    every = segmentations(pieces, text)
    z = np.logaddexp.reduce([w for _, w in every])
    p = {s: np.exp(w - z) for s, w in every}
    assert np.isclose(sum(p.values()), 1)
    first, second, trials = Counter(), Counter(), 6000
    estimate = 0.0
    for t in range(trials):
        (got,) = sampling.sample_many(lattice, ["▁aba▁ab"], 3, [t * 7919])
        ids = [tuple(e.tolist()) for e, *_ in got]
        assert len(set(ids)) == 3 and [g for *_, g, _ in got] == sorted((g for *_, g, _ in got), reverse=True)
        for i, (_, lp, _, q) in zip(ids, got, strict=True):
            assert np.isclose(np.exp(lp), p[i]) and 0 < q <= 1
        estimate += sum(np.exp(lp) / q * len(i) for i, (_, lp, _, q) in zip(ids, got, strict=True)) / trials
        first[ids[0]] += 1
        second[ids[0], ids[1]] += 1
    for s, n in first.items():
        assert abs(n / trials - p[s]) < 0.025
    for (a, b), n in second.items():
        assert abs(n / trials - p[a] * p[b] / (1 - p[a])) < 0.02
    # Inclusion scores make the estimate of the mean number of pieces unbiased.
    assert abs(estimate - sum(len(s) * x for s, x in p.items())) < 0.1


def test_all_segmentations_come_out_once():
    pieces = sampling.Pieces(theta=1.0, scores=SCORES)
    every = segmentations(pieces, "▁abab")
    lattice = sampling.Lattice(pieces)
    got, _ = sampling.sample_many(lattice, ["▁abab", "▁a ab"], 1000, [1, 2])
    assert sorted(tuple(e.tolist()) for e, *_ in got) == sorted(s for s, _ in every)
    assert all(q == 1 for *_, q in got)


def test_round_trip_on_the_public_model(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [None, "", "Hello  wörld \n 中文 \U0001f600", "a" * 300, "the " * 3000, "  lead and trail  "]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "again"), (None, "null key", "n")], "doc_id long, text string, ids string")
    rows = sampling.sampled(docs, PATH, k=4).collect()
    assert len(rows) == 8
    same = [r["__samples"] for r in rows if r["__doc"].doc_id == 2]
    assert same[0] == same[1]
    for r in rows:
        text = r["__doc"].text or ""
        ids = [tuple(np.frombuffer(s.ids, "<u4").tolist()) for s in r["__samples"]]
        assert len(set(ids)) == len(ids) >= 1 and (not text or len(ids) == 4)
        for i in ids:
            assert model.decode(list(i)) == (model.decode(model.encode(text)) if text else "")
    back = spark.createDataFrame([(1, bytes(np.array(model.encode("some  tëxt 中"), "<u4").tobytes())), (2, None)], "k int, ids binary")
    assert {r.k: r.text for r in sampling.decoded(back, PATH).collect()} == {1: model.decode(model.encode("some  tëxt 中")), 2: ""}
    with pytest.raises(ValueError):
        sampling.decoded(back.withColumn("Text", F.lit(1)), PATH)
    assert sampling.sampled(docs.limit(0), PATH).count() == 0


def plain_log_p(pieces, text, ids):
    """Log of the share of a segmentation, from a sum over all of them, by words."""
    words = []
    for c in pieces.normal(text):
        if words and (c != "▁" or set(words[-1]) == {"▁"}):
            words[-1] += c
        else:
            words.append(c)
    by_id = {i: (len(p), w) for p, (i, w) in pieces.ids.items()}
    log_p, at = 0.0, 0
    for word in words:
        back = [0.0] * (len(word) + 1)
        for i in range(len(word) - 1, -1, -1):
            own = [pieces.ids[word[i:j]][1] + back[j] for j in range(i + 1, len(word) + 1) if word[i:j] in pieces.ids]
            back[i] = np.logaddexp.reduce(own if word[i] in pieces.ids else [pieces.unknown + back[i + 1], *own])
        place = 0
        while place < len(word):
            if ids[at] in by_id:
                size, w = by_id[ids[at]]
                assert pieces.ids[word[place : place + size]][0] == ids[at]
                at += 1
            else:
                size, w = 1, pieces.unknown
                assert [pieces.bytes[b] for b in word[place].encode()] == list(ids[at : at + len(word[place].encode())])
                at += len(word[place].encode())
            log_p += w
            place += size
        log_p -= back[0]
    assert at == len(ids)
    return log_p


def test_table_equals_plain_probabilities_and_decoding(spark):
    """Every sample of the table spells its text, has the probability of a plain sum over the lattice, and decodes as the model does."""
    model, pieces = sentencepiece.SentencePieceProcessor(model_file=PATH), sampling.Pieces(PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    told = {(r.doc_id, r["rank"]): r for r in sampling.op7_gumbel_top_k(spark, SF).collect()}
    rows = sampling.sampled(docs, PATH).collect()
    assert len(told) == sum(len(r["__samples"]) for r in rows)
    for r in rows:
        for rank, s in enumerate(r["__samples"]):
            ids, got = np.frombuffer(s.ids, "<u4").tolist(), told[r["__doc"].doc_id, rank]
            assert got.ids_crc32 == zlib.crc32(s.ids) and got.pieces == len(ids)
            assert got.decoded_crc32 == zlib.crc32(model.decode(ids).encode())
            if len(ids) < 2000:
                assert abs(plain_log_p(pieces, r["__doc"].text or "", ids) - s.log_p) < 1e-6
        values = [s.value for s in r["__samples"]]
        assert values == sorted(values, reverse=True)


@pytest.mark.parametrize("kept", [0, 40, 10**6])
def test_samples_do_not_depend_on_what_a_worker_keeps(monkeypatch, kept):
    monkeypatch.setattr(sampling, "KEPT", kept)
    pieces = sampling.Pieces(PATH)
    texts = ["some words of a text", "other words, of another text", "", "some words", "zu guter Letzt ein Wort"]
    want = [sampling.sample_many(sampling.Lattice(pieces), [t], 3, [i])[0] for i, t in enumerate(texts)]
    lattice = sampling.Lattice(pieces)
    got = [x for i in range(0, 5, 2) for x in sampling.sample_many(lattice, texts[i : i + 2], 3, list(range(i, min(5, i + 2))))]
    assert [[(e.tolist(), lp, g, q) for e, lp, g, q in one] for one in got] == [[(e.tolist(), lp, g, q) for e, lp, g, q in one] for one in want]


def test_segmentations_of_the_least_shares_come_out():
    """A share below the spacing of floats beside 1 is no reason to lose a segmentation."""
    scores = {"▁a": -1.0, "▁": -60.0, "a": -70.0, "b": -1.0, "▁b": -90.0}
    pieces = sampling.Pieces(theta=1.0, scores=scores)
    for text in ("▁a", "▁a▁a", "▁a▁b"):
        every = segmentations(pieces, text)
        (got,) = sampling.sample_many(sampling.Lattice(pieces), [text], 9, [5])
        assert sorted(tuple(e.tolist()) for e, *_ in got) == sorted(s for s, _ in every)
        z = np.logaddexp.reduce([w for _, w in every])
        for e, lp, _, q in got:
            assert q == 1 and abs(lp - (dict(every)[tuple(e.tolist())] - z)) < 1e-9


def test_columns_to_keep(spark):
    docs = spark.createDataFrame([(1, "some words", "x"), (2, None, "y")], "doc_id long, text string, lang string")
    whole, thin = (sampling.sampled(docs, PATH, keep=k).orderBy("__doc.doc_id").collect() for k in (None, ["doc_id"]))
    assert [r["__doc"].asDict().keys() for r in thin] == [{"doc_id"}] * 2 and set(whole[0]["__doc"].asDict()) == set(docs.columns)
    assert [r["__samples"] for r in whole] == [r["__samples"] for r in thin]


@pytest.mark.parametrize("kinds", [2047, 3])
def test_stretches_are_cut_where_no_piece_crosses(monkeypatch, kinds):
    """A comma is no part of the word before it, so a worker knows both already; fewer kinds of characters only join stretches."""
    monkeypatch.setattr(sampling, "KINDS", kinds)
    pieces = sampling.Pieces(PATH)
    inside = {p[i : i + 2] for p in pieces.ids for i in range(len(p) - 1)}
    for text in ("some words, of a text.", "  ünd  中文 \U0001f600\nx,y", "\u2581", "a"):
        whole = pieces.normal(text)
        got = pieces.split(whole)
        ends = np.cumsum([len(x) for x in got]).tolist()
        assert "".join(got) == whole
        cut, want = set(ends[:-1]), {i for i in range(1, len(whole)) if whole[i - 1 : i + 1] not in inside}
        assert cut == want if kinds > 3 else cut <= want
    assert pieces.split("") == []
    if kinds > 3:
        assert pieces.split(pieces.normal("words, words.")) == ["▁words", ",", "▁words", "."]


def test_words_asked_for_again_stay(monkeypatch):
    """A full worker drops the words of one batch only, and the numbers of those that stay are the same."""
    monkeypatch.setattr(sampling, "KEPT", 60)
    pieces = sampling.Pieces(PATH)
    lattice, learnt, learn = sampling.Lattice(pieces), [], sampling.Lattice.learn
    monkeypatch.setattr(sampling.Lattice, "learn", lambda self, words: learnt.append(words - self.root.keys()) or learn(self, words))
    texts = ["often here once", "often here twice", "often rareness incomprehensibilities of unforeseeable circumstances", "often here again"]
    got = [sampling.sample_many(lattice, [t], 3, [i])[0] for i, t in enumerate(texts)]
    assert learnt[0] == {"▁often", "▁here", "▁once"} and learnt[3] == {"▁again"}
    assert set(lattice.root) == {"▁often", "▁here", "▁again"} and lattice.nodes == sum(map(len, lattice.root))
    assert lattice.edges == lattice.count[: lattice.nodes].sum()
    for i, (t, one) in enumerate(zip(texts, got, strict=True)):
        (want,) = sampling.sample_many(sampling.Lattice(pieces), [t], 3, [i])
        assert [(e.tolist(), *x) for e, *x in one] == [(e.tolist(), *x) for e, *x in want]


def test_query_has_distinct_samples(spark):
    got = sampling.op7_gumbel_top_k(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == docs.keys()
    assert len({(r.doc_id, r.ids_crc32) for r in got}) == len(got)
    again = {(r.doc_id, r.rank): r.ids_crc32 for r in sampling.op7_gumbel_top_k(spark, SF).collect()}
    assert again == {(r.doc_id, r.rank): r.ids_crc32 for r in got}
    assert zlib.crc32(b"") == 0
