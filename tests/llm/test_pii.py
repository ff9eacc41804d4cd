"""Base spans against plain regular expressions, and the method's own parts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lattica.llm import pii

SF, WIDER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), list(PLAIN).index(kind), m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


TRICKY = [
    None, "", "a@b.c", "a@b.c_d@e.f", "x@y", "é à écrire: jo.e+x@mail-1.example.co.uk, ok", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 010.000.1.255",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "378282246310005 x 6011000990139424", "+1 (454) 555-9913.", "+49 30 1234567 89) tail", "++1 22", "tel (454) 555-9913 and 454-555-9913",
    "ssn 123-45-6789", "write joe [at] example [dot] com now", "\U0001f600 a@b.cd \U0001f600 1.1.1.1", "1" * 5000, "a" * 20000 + "@", "1.1.1." * 3000, "1 " * 4000, "a.a@" * 2000, "+1" + "(" * 4000,
    "99999999999999999999999.1.1.1 0000000000000000255.1.1.1", "a@b.c@d.e", "\n+12 345 678 901\n",
]


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_base_spans_are_those_of_the_plain_patterns(spark, model):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(len(TRICKY), TRICKY[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.annotate(docs, model).select("__doc.doc_id", "__spans").collect()
    assert len(got) == len(rows)
    for r in got:
        want = base_spans(rows[r.doc_id][1] or "")
        assert [(s.start, s.end, pii.KINDS[s.kind]) for s in r["__spans"] if s.kind < 4] == want, rows[r.doc_id][1]


def test_query_on_the_whole_table(spark):
    got = {r.doc_id: r for r in pii.op6_weak_supervision(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for r in texts:
        want = base_spans(r.text or "")
        told = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in PLAIN] == [sum(x[2] == k for x in want) for k in PLAIN]
        assert not want or set(told.split(",")) <= set(got[r.doc_id].spans.split(","))


def test_added_kinds_and_redaction(spark, model):
    docs = spark.createDataFrame([(1, "call tel (454) 555-9913 or write a@b.com", "x"), (2, "plain words only", "y"), (3, None, None)], "doc_id long, text string, kind string")
    out = {r.doc_id: r for r in pii.redacted(docs, model=model).collect()}
    assert out[1].text == "call tel <LOCAL> or write <EMAIL>"
    assert out[2].text == "plain words only" and out[3].text is None and out[1].kind == "x"


def test_reliabilities_recover_a_planted_bad_labeler():
    patterns = []
    for truth, n in ((1, 300), (0, 100)):
        base = dict.fromkeys(pii.LABELERS, 2) | dict.fromkeys(pii.OWN, 0) | {"kind": 0}
        patterns.append((base | {"shape": 1, "gazetteer": truth, "speaks_for": 1 if truth else 2, "speaks_against": 2 if truth else 0, "edge": 2 if truth else 0}, n))
    model = pii.learn(patterns)
    assert model.reliabilities["gazetteer"][0] > 0.9 and model.reliabilities["gazetteer"][1] > 0.9
    assert model.reliabilities["shape"][1] == 0.5
    assert model.weights["gazetteer", 1] > model.weights["gazetteer", 0]


def plain_redaction(text, spans):
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{pii.KINDS[s.kind].upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("block,piece", [(128, 4096), (2, 5)])
def test_redaction_equals_brute_force(spark, model, monkeypatch, block, piece):
    """Overlaps of kinds, code points beyond the first plane, spans at the edges and over pieces' bounds."""
    monkeypatch.setattr(pii, "BLOCK", block)
    monkeypatch.setattr(pii, "PIECE", piece)
    texts = [*TRICKY, "a@b.cd " * 700, "x" * 4090 + " a@b.cd " + "\U0001f600" * 5000 + " 1.1.1.1", "a@b.cd", "1.2.3.4@host.org +1 454 555 9913@x.de"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r["__spans"] for r in pii.annotate(docs, model).select("__doc.doc_id", "__spans").collect()}
    got = {r.doc_id: r.text for r in pii.redacted(docs, model=model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (plain_redaction(t, spans[i]) if t is not None else None), t


def test_time_grows_with_the_spans(spark, model):
    import time

    took = []
    for n in (5000, 5000, 40000):
        docs = spark.createDataFrame([(1, " ".join(f"u{i}@host{i % 7}.org" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        (row,) = pii.redacted(docs, model=model).collect()
        took.append(time.time() - began)
        assert row.text == " ".join(["<EMAIL>"] * n)
    assert took[2] < 12 * took[1] + 5


ADDED = {
    "local": r"(?<![0-9+().-])(?<![0-9+().-]\x20)(\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9])",
    "idnum": r"(?<![0-9+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![.-]?[0-9])",
    "masked": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]+(\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]+)+",
}


def plain_features(text, start, end, kind):
    """Votes and features of a span, by plain Python."""
    hit, before, after = text[start:end], text[:start][-24:], text[end : end + 1]
    digits = re.sub("[^0-9]", "", hit)
    codes, domains = set(pii.DIALLING_CODES), set(pii.DOMAINS)
    alnum = lambda c: c.isascii() and c.isalnum()
    gazetteer = {
        "email": lambda: int(hit.rsplit(".", 1)[-1].lower() in domains),
        "ip": lambda: int(not re.match(r"(0|10|127|255|22[4-9]|23[0-9]|192[.]168|169[.]254|172[.](1[6-9]|2[0-9]|3[01]))[.]", hit)),
        "card": lambda: int(bool(re.match("4|5[1-5]|2[2-7]|3[47]|3[068]|35|6011|65|64[4-9]|62", digits))),
        "phone": lambda: 1 if digits[:1] in codes or digits[:2] in codes else 2,
        "local": lambda: int(bool(re.match("[2-9][0-9]{2}[2-9]", digits))),
        "idnum": lambda: int(not (re.match("000|666|9", hit) or "-00-" in hit or hit.endswith("-0000"))),
        "masked": lambda: int(re.search("[A-Za-z]*$", hit)[0].lower() in domains),
    }[kind]()
    k = pii.KINDS.index(kind)
    said = lambda words: bool(re.search(f"(^|[^a-z])({words})([^a-z]|$)", before.lower()))
    side = lambda c: 0 if not c else 1 if c in " \t\n\x0b\f\r" else 2 if alnum(c) else 3
    return {
        "kind": k, "size": sum(len(hit) >= x for x in (9, 15, 21)), "share": 0 if not digits else 1 if 2 * len(digits) < len(hit) else 2,
        "left": side(before[-1:]), "right": side(after),
        "shape": 1 if k <= 3 or k == 4 and hit[0] == "(" or k == 6 and not re.search("[0-9]{9}", hit) else 2,
        "edge": 0 if after and (alnum(after) or after == "_") or before and (alnum(before[-1]) or before[-1] in "_#") else 2,
        "gazetteer": gazetteer, "speaks_for": 1 if said(pii.FOR) else 2, "speaks_against": 0 if said(pii.AGAINST) else 2,
    }


def test_method_equals_brute_force(spark):
    """Candidates, votes, patterns' counts, the fit's decisions and the query's spans against plain Python over the whole table."""
    from collections import Counter

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{WIDER}/documents.parquet").select("doc_id", "text").collect()}
    every = {i: [*base_spans(t), *((m.start(), m.end(), k) for k, p in ADDED.items() for m in re.finditer(p, t))] for i, t in texts.items()}
    told = {(i, *x): plain_features(texts[i], *x) for i, spans in every.items() for x in spans}
    counts = Counter(tuple(f[n] for n in pii.FEATURES) for f in told.values())
    patterns = sorted(((dict(zip(pii.FEATURES, p, strict=True)), n) for p, n in counts.items()), key=lambda x: sorted(x[0].items()))
    model = pii.learn(patterns)
    fitted = pii.fit(spark.read.parquet(f"{WIDER}/documents.parquet"))
    assert fitted == model and len(told) > 50

    def stays(f):
        return f["kind"] < 4 or model.bias + sum(model.weights.get((n, f[n]), 0.0) for n in pii.FEATURES) >= 0

    for r in pii.op6_weak_supervision(spark, WIDER).collect():
        want = sorted((s, pii.KINDS.index(k), e) for s, e, k in every[r.doc_id] if stays(told[r.doc_id, s, e, k]))
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert pii.redacted(docs).count() == 0


def test_plan_has_no_python(spark):
    plan = pii.annotate(spark.read.parquet(f"{SF}/documents.parquet"), pii.Model(0.5, {}, {}, 0.0)).select(F.size("__spans"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
