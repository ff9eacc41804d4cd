"""Op 6: personal data by weak supervision, with DataFrame functions only.

Candidates are the spans of four base kinds (email, ip, card, phone), which always stay, and of three
further kinds that the method may add: local (a telephone number without +), idnum (three, two and
four digits) and masked (an address with its at and dot spelt out). Five labelers vote on each:
shape and edge (regex), gazetteer (dialling codes, domains, card issuers, address ranges) and two of
context (words before the span that speak for or against). Expectation-maximisation estimates each
labeler's reliability and every vote pattern's posterior. Those train a logistic span classifier that
sees, beside the votes, what no labeler looks at: the span's length, how much of it is digits, and the
kinds of characters on its left and right. It decides over all candidates; base spans stay in any case.

All candidates of the corpus are counted, by pattern: the rows that reach the driver are at most the
product of the features' values (KINDS x 3^5 x 4 x 3 x 4 x 4), whatever the input. Rows are never
shuffled; texts are read twice, to fit and to annotate.

Defined cases: null text is empty and has no spans; repeated rows get equal spans; other columns pass
through; an empty table gives an empty result; positions are code points, end exclusive; spans of
different kinds may overlap; spans that tie in start and end go by kind. The patterns are written so that
time is linear in the text: a start inside a run is skipped unless the last match ended there, and repeats
don't give back. Running sums start anew in each block of `BLOCK` spans, and parts are cut from pieces of
`PIECE` code points, since a substring is counted off from the start; so texts with very many spans take
time nearly in proportion, too. Columns of docs stay inside `__doc`
(redacted: as they are), whatever their names; only `text` may not be called otherwise than said.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import exp, log
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local", "idnum", "masked")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local": r"(?<![0-9+().-])(?<![0-9+().-]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9])",
    "idnum": r"(?<![0-9+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![.-]?[0-9])",
    "masked": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)++",
}
#: A text without any of these has no span of the kind.
NEEDS = {"email": ("@",), "phone": ("+",), "masked": ("at]", "at)")}
LABELERS = ("shape", "edge", "gazetteer", "speaks_for", "speaks_against")
DIALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
DOMAINS = "com net org edu gov mil int info biz io co uk de fr es it nl pl ru jp cn in br au ca us ch at be se no dk fi pt ie cz gr".split()
FOR = "mail|e-mail|email|correo|courriel|contact|kontakt|phone|telephone|tel|teléfono|téléphone|telefon|mobile|cell|call|ring|fax|write|reach|card|visa|mastercard|amex|credit|carte|tarjeta|karte|ip|address|adresse|host|ssn|social|identity"
AGAINST = "version|release|isbn|issn|doi|figure|fig|table|section|chapter|page|pages|order|invoice|part|serial|article|equation|build"
#: Code points before a span that count as its context.
NEAR = 24
#: Numbers that are summed up by themselves, and code points of a piece of text.
BLOCK, PIECE = 128, 4096


def hits_of(text: Column, kind: str) -> Column:
    """All matches of a kind."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    if kind in NEEDS:
        some = reduce(or_, [F.contains(text, F.lit(x)) for x in NEEDS[kind]])
        hits = F.when(some, hits).otherwise(F.array().cast("array<string>"))
    return hits


def luhn(digits: str) -> str:
    """SQL: does the string of digits pass?"""
    doubled = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + if(i % 2 = 1, if({doubled} > 4, 2 * {doubled} - 9, 2 * {doubled}), {doubled})) % 10 = 0"


DIGITS = "x.digits"
VALID = {
    "email": "true",
    "ip": "forall(split(x.hit, '[.]'), p -> length(trim(leading '0' from p)) <= 3 and cast(concat('0', trim(leading '0' from p)) as int) <= 255)",
    "card": f"length({DIGITS}) between 14 and 19 and {luhn(DIGITS)}",
    "phone": f"length({DIGITS}) between 10 and 15",
    "local": "true",
    "idnum": "true",
    "masked": "true",
}
words = lambda of: "'" + "','".join(of) + "'"
VOTES = {
    # 1: personal, 0: not, 2: abstains.
    "shape": "case when x.kind <= 3 then 1 when x.kind = 4 and x.hit like '(%' then 1 when x.kind = 6 and x.hit not rlike '[0-9]{9}' then 1 else 2 end",
    "edge": "case when x.after rlike '^[A-Za-z0-9_]' or x.before rlike '[A-Za-z0-9_#]$' then 0 else 2 end",
    "gazetteer": f"""case when x.kind = 0 then if(lower(substring_index(x.hit, '.', -1)) in ({words(DOMAINS)}), 1, 0)
        when x.kind = 1 then if(x.hit rlike '^(0|10|127|255|22[4-9]|23[0-9]|192[.]168|169[.]254|172[.](1[6-9]|2[0-9]|3[01]))[.]', 0, 1)
        when x.kind = 2 then if({DIGITS} rlike '^(4|5[1-5]|2[2-7]|3[47]|3[068]|35|6011|65|64[4-9]|62)', 1, 0)
        when x.kind = 3 then if(substring({DIGITS}, 1, 1) in ({words(DIALLING_CODES)}) or substring({DIGITS}, 1, 2) in ({words(DIALLING_CODES)}), 1, 2)
        when x.kind = 4 then if({DIGITS} rlike '^[2-9][0-9]{{2}}[2-9]', 1, 0)
        when x.kind = 5 then if(x.hit rlike '^(000|666|9)' or x.hit like '%-00-%' or x.hit like '%-0000', 0, 1)
        else if(lower(regexp_extract(x.hit, '([A-Za-z]+)$', 1)) in ({words(DOMAINS)}), 1, 0) end""",
    "speaks_for": f"if(lower(x.before) rlike '(^|[^a-z])({FOR})([^a-z]|$)', 1, 2)",
    "speaks_against": f"if(lower(x.before) rlike '(^|[^a-z])({AGAINST})([^a-z]|$)', 0, 2)",
}
#: What the classifier sees of a span itself: length, digits, and what stands on its left and right.
OWN = {
    "size": "case when length(x.hit) < 9 then 0 when length(x.hit) < 15 then 1 when length(x.hit) < 21 then 2 else 3 end",
    "share": "case when x.digits = '' then 0 when 2 * length(x.digits) < length(x.hit) then 1 else 2 end",
    "left": "case when x.before = '' then 0 when x.before rlike '\\\\s$' then 1 when x.before rlike '[A-Za-z0-9]$' then 2 else 3 end",
    "right": "case when x.after = '' then 0 when x.after rlike '^\\\\s' then 1 when x.after rlike '^[A-Za-z0-9]' then 2 else 3 end",
}
FEATURES = ("kind", *OWN, *LABELERS)


def bound(name: str, value: str, result: str) -> str:
    """SQL: result, with value, made once, under a name. (A column named inside a lambda might be made anew at each step.)"""
    return f"transform(array({value}), {name} -> {result})[0]"


def before_each(values: str, op: str) -> str:
    """SQL: for each of an array of ints what op(a, v) makes of 0 and all ints before it.

    An aggregate copies its state at each step, so the state is one int, and it starts anew in each block of `BLOCK`."""
    fold = lambda array, start: f"aggregate({array}, {start}, (a, v) -> {op})"
    inside = bound("start", fold("slice(folds, 1, j)", "0"), f"transform(block, (v, i) -> {fold('slice(block, 1, i)', 'start')})")
    blocks = f"transform(sequence(0, (size(all) - 1) div {BLOCK}), j -> slice(all, j * {BLOCK} + 1, {BLOCK}))"
    each = bound("blocks", blocks, bound("folds", f"transform(blocks, block -> {fold('block', '0')})", f"flatten(transform(blocks, (block, j) -> {inside}))"))
    return bound("all", values, each)


def part(pieces: str, start: str, end: str | None) -> str:
    """SQL: code points from start to end (null: all) of a text cut into pieces of PIECE."""
    first = f"cast(({start}) div {PIECE} as int)"
    head = f"coalesce(substring(get({pieces}, {first}), ({start}) % {PIECE} + 1), '')"
    if end is None:
        return f"concat({head}, concat_ws('', slice({pieces}, {first} + 2, greatest(0, size({pieces}) - {first} - 1))))"
    last = f"cast(({end}) div {PIECE} as int)"
    one = f"coalesce(substring(get({pieces}, {first}), ({start}) % {PIECE} + 1, ({end}) - ({start})), '')"
    tail = f"coalesce(substring(get({pieces}, {last}), 1, ({end}) % {PIECE}), '')"
    return f"if({first} = {last}, {one}, concat({head}, concat_ws('', slice({pieces}, {first} + 2, greatest(0, {last} - {first} - 1))), {tail}))"


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """docs as `__doc` with `__spans`: structs of start, kind, end, five votes and four features."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumns({f"__h{k}": hits_of(F.col("__text"), kind) for k, kind in enumerate(KINDS)})
    for k, kind in enumerate(KINDS):
        # Arrays meet in zip_with(), never as columns inside a lambda: the optimizer might move what makes them in there.
        some, n = F.size(f"__h{k}") > 0, f"size(__h{k})"
        pairs = f"zip_with(__h{k}, slice(__p{k}, 1, {n}), (h, b) -> struct(h as hit, b as piece))"
        found = f"zip_with({pairs}, slice(__p{k}, 2, {n}), (x, a) -> struct(cast({k} as int) as kind, x.hit as hit, regexp_replace(x.hit, '[^0-9]', '') as digits, length(x.piece) as gap, substring(x.piece, -{NEAR}, {NEAR}) as before, substring(a, 1, 1) as after))"
        starts = before_each(f"transform(__f{k}, x -> x.gap + length(x.hit))", "a + v")
        placed = f"zip_with(__f{k}, __e{k}, (x, e) -> struct(x.kind as kind, x.hit as hit, x.digits as digits, x.before as before, x.after as after, e + x.gap + length(x.hit) as to))"
        votes = ", ".join(f"cast({VOTES[v]} as int) as {v}" for v in LABELERS)
        own = ", ".join(f"cast({x} as int) as {name}" for name, x in OWN.items())
        told = f"transform(filter({placed}, x -> {VALID[kind]}), x -> struct(cast(x.to - length(x.hit) as int) as start, x.kind as kind, cast(x.to as int) as end, {votes}, {own}))"
        rows = rows.withColumn(f"__p{k}", F.when(some, F.split("__text", PATTERNS[kind], -1)))
        rows = rows.withColumn(f"__f{k}", F.when(some, F.expr(found))).withColumn(f"__e{k}", F.when(some, F.expr(starts)))
        rows = rows.withColumn(f"__s{k}", F.when(some, F.expr(told)))
    kept = [F.col(f"__s{k}") for k in range(len(KINDS))]
    rows = rows.withColumn("__spans", F.array_sort(F.flatten(F.filter(F.array(*kept), lambda a: a.isNotNull()))))
    return rows.select("__doc", "__text", "__spans")


@dataclass
class Model:
    """reliabilities: of each labeler, P(votes 1 | personal) and P(votes 0 | not); weights of the classifier by feature."""

    prior: float
    reliabilities: dict[str, tuple[float, float]]
    weights: dict[tuple[str, int], float]
    bias: float

    def logit(self) -> Column:
        """The classifier over a span struct `x`, as a SQL expression."""
        cases = []
        for name in FEATURES:
            own = {v: w for (n, v), w in self.weights.items() if n == name}
            if own:
                cases.append(f"case x.{name} " + " ".join(f"when {v} then {w!r}D" for v, w in sorted(own.items())) + " else 0D end")
        return " + ".join([f"{self.bias!r}D", *cases])


def sigmoid(x: float) -> float:
    return 1 / (1 + exp(-max(-40.0, min(40.0, x))))


def learn(patterns: list[tuple[dict, int]], rounds: int = 50, steps: int = 200, rate: float = 0.5) -> Model:
    """EM over vote patterns with counts, then a logistic classifier on their posteriors."""
    total = sum(n for _, n in patterns)
    prior, right = 0.7, {v: [0.8, 0.7] for v in LABELERS}
    after = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (p, _) in enumerate(patterns):
            a, b = log(prior), log(1 - prior)
            for v in LABELERS:
                if p[v] != 2:
                    a += log(right[v][0] if p[v] == 1 else 1 - right[v][0])
                    b += log(right[v][1] if p[v] == 0 else 1 - right[v][1])
            after[i] = sigmoid(a - b)
        # Pseudo-counts keep labelers better than chance and rare patterns from 0 and 1.
        prior = (7 + sum(q * n for q, (_, n) in zip(after, patterns, strict=True))) / (10 + total)
        for v in LABELERS:
            yes = [(q * n, (1 - q) * n, p[v]) for q, (p, n) in zip(after, patterns, strict=True) if p[v] != 2]
            good = (8 + sum(a for a, _, x in yes if x == 1)) / (10 + sum(a for a, _, _ in yes))
            bad = (7 + sum(b for _, b, x in yes if x == 0)) / (10 + sum(b for _, b, _ in yes))
            right[v] = [max(0.5, good), max(0.5, bad)]
        prior = min(0.99, max(0.01, prior))
    weights, bias = {}, 0.0
    for p, _ in patterns:
        weights |= {(k, p[k]): 0.0 for k in FEATURES if not (k in LABELERS and p[k] == 2)}
    for _ in range(steps if total else 0):
        slope, slope0 = dict.fromkeys(weights, 0.0), 0.0
        for q, (p, n) in zip(after, patterns, strict=True):
            own = [k for k in ((name, p[name]) for name in FEATURES) if k in weights]
            e = (q - sigmoid(bias + sum(weights[k] for k in own))) * n / total
            slope0 += e
            for k in own:
                slope[k] += e
        bias += rate * slope0
        weights = {k: w * (1 - 1e-4) + rate * slope[k] for k, w in weights.items()}
    return Model(prior, {v: tuple(x) for v, x in right.items()}, weights, bias)


def fit(docs: DataFrame, text: str = "text") -> Model:
    names = list(FEATURES)
    spans = candidates(docs, text).select(F.explode("__spans").alias("x")).select(*[f"x.{n}" for n in names])
    counts = spans.groupBy(*names).agg(F.count("*").alias("n")).collect()
    return learn(sorted((({n: r[n] for n in names}, r["n"]) for r in counts), key=lambda x: sorted(x[0].items())))


def annotate(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs as `__doc` with `__text` and `__spans`: structs of start, kind (an index of KINDS) and end, sorted."""
    cut = log(least / (1 - least))
    kept = f"transform(filter(__spans, x -> x.kind < {len(BASE)} or ({model.logit()}) >= {cut!r}D), x -> struct(x.start as start, x.kind as kind, x.end as end))"
    return candidates(docs, text).withColumn("__spans", F.expr(kept))


def redacted(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """docs with spans replaced by their kind in angle brackets; overlapping spans by that of the first."""
    found = annotate(docs, model or fit(docs, text), text)
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    reached = before_each("transform(__spans, x -> x.end)", "greatest(a, v)")
    told = f"if(x.start >= e, concat({part('pieces', 'e', 'x.start')}, {names}[x.kind]), '')"
    rest = part("pieces", "array_max(transform(spans, x -> x.end))", None)
    parts = bound("pieces", f"regexp_extract_all(__text, '(?s).{{1,{PIECE}}}', 0)", bound("spans", "__spans", f"concat(concat_ws('', zip_with(spans, {reached.replace('__spans', 'spans')}, (x, e) -> {told})), {rest})"))
    clean = F.when(F.size("__spans") == 0, F.col(f"__doc.`{text}`")).otherwise(F.expr(parts))
    return found.select(*[clean.alias(c) if c == text else F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])


def told(which: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"concat_ws(',', transform({which}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)))"


def op6_weak_supervision(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = annotate(docs, fit(docs)).withColumn("__base", F.expr(f"filter(__spans, x -> x.kind < {len(BASE)})"))
    counts = [F.expr(f"cast(size(filter(__base, x -> x.kind = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("__doc.doc_id", *counts, F.sha2(F.expr(told("__base")), 256).alias("base_sha256"), F.expr(told("__spans")).alias("spans"))
