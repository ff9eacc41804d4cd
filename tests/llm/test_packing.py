import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as some
from tokenizers import Tokenizer

from lattica.llm import packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def check_pieces(pieces, texts):
    """Every id of each text in one piece, offsets without gaps, no padding."""
    t = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert by_doc.keys() == texts.keys()
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0


def test_query_holds_every_id_once(spark):
    check_pieces(packing.op9_sum_of_squares(spark, SF).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})


def test_words_are_coded_as_whole_texts():
    t = Tokenizer.from_file(PATH)
    w = packing.Words(PATH)
    texts = ["", " ", "Hello, World!!  x\t\ty\n\nz", "it's we're I'LL don't '", "<|endoftext|> a <|ENDOFTEXT|>b", "é É ΣΑΣ İi ß 中文字 é,", "a.b.c, (x), \"q\". 12 3,4!", "x" * 5000, "word, " * 3000, " nb sp 　 wide", "a,! b.,. c—, —."]
    for _ in range(2):
        for text, got in zip(texts, w.encode([x.encode() for x in texts]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=25, deadline=None)
@given(some.lists(some.text(alphabet="abzéßÉ'.,!? \n\t#12中́<|>", max_size=40), max_size=8))
def test_any_text_is_coded_as_a_whole(texts):
    from lattica.llm.shared import once_a_worker

    w = once_a_worker("test words", lambda: packing.Words(PATH))
    for text, got in zip(texts, w.encode([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids


def brute_level(count, size, window):
    def squares(c):
        return sum(int(x) ** 2 for x in c[1:window])

    best = None
    for h in range(0, window - size + 1):
        if h == 0 or count[h] > 0:
            c = list(map(int, count))
            if h:
                c[h] -= 1
            c[h + size] += 1
            key = (squares(c), -h)
            best = min(best, (key, h)) if best else (key, h)
    return best[1]


@settings(max_examples=40, deadline=None)
@given(some.lists(some.integers(1, 40), min_size=1, max_size=60))
def test_levels_make_the_sum_of_squares_least(sizes):
    p = packing.Packer(16, 6)
    for i, s in enumerate(sizes):
        if s % 16:
            assert p.best_level(s % 16) == brute_level(p.count, s % 16, 16)
        p.add(i, np.arange(s, dtype=np.uint32))
        assert p.open <= 6
    p.finish()
    seen, fill = defaultdict(list), defaultdict(int)
    for window, offset, (i, start, ids) in p.drain():
        assert offset == fill[window] and ids[0] == start
        fill[window] += len(ids)
        seen[i] += ids.tolist()
    assert all(sorted(seen[i]) == list(range(s)) for i, s in enumerate(sizes))
    assert all(f == 16 or f & (f - 1) == 0 for f in fill.values())


def plain_packing(sizes, window):
    """Lists of (document, start, length) by window, in the order of closing: the rule, as plainly as it goes."""
    open_, closed = [], []  # windows filled in part: lists of pieces

    def fill(w):
        return sum(n for _, _, n in w)

    def level_of(size):
        counts = [0] * (window + 1)
        for w in open_:
            counts[fill(w)] += 1
        return brute_level(counts, size, window)

    def settle(w):
        if fill(w) == window:
            closed.append(w)
        else:
            open_.append(w)

    for i, n in enumerate(sizes):
        whole = n // window * window
        closed += [[(i, at, window)] for at in range(0, whole, window)]
        if n > whole:
            level = level_of(n - whole)
            into = [w for w in open_ if level and fill(w) == level][-1:]
            for w in into:
                open_.remove(w)
            settle([*(into[0] if into else []), (i, whole, n - whole)])
    while len(open_) > 1:
        low = min(map(fill, open_))
        cut = [w for w in open_ if fill(w) == low][-1]
        open_.remove(cut)
        while cut and open_:
            high = max(map(fill, open_))
            into = [w for w in open_ if fill(w) == high][-1]
            open_.remove(into)
            while cut and fill(into) < window:
                i, start, n = cut.pop()
                room = min(n, window - fill(into))
                if n > room:
                    cut.append((i, start, n - room))
                into.append((i, start + n - room, room))
            settle(into)
        if cut:
            settle(cut)
    for w in open_:
        while w:
            size, part = 1 << (fill(w).bit_length() - 1), []
            while fill(part) < size:
                i, start, n = w.pop(0)
                room = min(n, size - fill(part))
                if n > room:
                    w.insert(0, (i, start + room, n - room))
                part.append((i, start, room))
            closed.append(part)
    return closed


@settings(max_examples=40, deadline=None)
@given(some.lists(some.integers(1, 40), max_size=50))
def test_packer_equals_a_plain_one(sizes):
    p = packing.Packer(16)
    for i, s in enumerate(sizes):
        p.add(i, np.arange(s, dtype=np.uint32))
    p.finish()
    got = defaultdict(list)
    for window, _, (i, start, ids) in p.drain():
        got[window].append((i, start, len(ids)))
    assert [got[w] for w in sorted(got)] == plain_packing(sizes, 16)


def test_query_equals_a_plain_packer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").coalesce(1)
    t = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect()]
    got = defaultdict(list)
    for r in packing.pack(docs, PATH).orderBy("sequence_id", "offset").collect():
        got[r.sequence_id].append((r.doc_id, r.start, r.length))
    want = [[(rows[i][0], start, n) for i, start, n in w] for w in plain_packing([n for _, n in rows], 4096)]
    assert [got[w] for w in sorted(got)] == want


def test_open_windows_do_not_grow_with_the_documents():
    rng = np.random.default_rng(0)
    p = packing.Packer(most_open=10**9)
    most = []
    for _ in range(3):
        top = 0
        for size in np.maximum(1, rng.lognormal(5.8, 1.2, 8000).astype(int)):
            p.add(0, np.zeros(size, "<u4"))
            top = max(top, p.open)
        p.drain()
        most.append(top)
    assert max(most) < 400 < packing.OPEN and most[2] < 1.2 * most[0]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (2, "", "b"), (3, "word " * 9000, "d")], "doc_id long, text string, start string")
    got = packing.pack(docs, PATH).collect()
    assert sum(r.length for r in got) == 1 + 1 + 3 + 1 + 9001
    assert packing.pack(docs.limit(0), PATH).count() == 0
