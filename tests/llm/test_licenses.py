import random

import pytest

from lattica.llm import licenses

SF = "/root/testdata/sf0.001"


def test_copies_edits_and_prose():
    t = licenses.Templates(licenses.TEMPLATES)
    names = list(licenses.TEMPLATES)
    prose = " ".join(random.Random(1).choice("the of and software is in a any permission copy".split()) for _ in range(4000))
    for name, text in licenses.TEMPLATES.items():
        for wrapped in (text, f"{prose}\n\n{text.upper()}\n{prose}", "# " + text.replace(" ", "\n * ")):
            assert name in [names[i] for i, *_ in t.matches(wrapped)], name
        words = text.split()
        if len(words) > 40:
            changed = list(words)
            changed[10], changed[30] = "foo", "bar"
            (got,) = [m for m in t.matches(" ".join(changed)) if names[m[0]] == name]
            assert 0.8 <= got[3] < 1
    assert t.matches(prose) == [] and t.matches("") == []


def test_several_copies_are_all_found():
    t = licenses.Templates(licenses.TEMPLATES)
    got = t.matches("Released under the MIT License. " * 3 + "word " * 20 + "Licensed under CC BY-NC 4.0.")
    assert [list(licenses.TEMPLATES)[m[0]] for m in got] == ["MIT-notice"] * 3 + ["CC-BY-NC-4.0-notice"]


def test_pruning_loses_nothing():
    """Against every window of every size within the bounds."""
    rng = random.Random(3)
    templates = {"a": "one two three four five six seven", "b": "one two three nine ten", "c": "x y"}
    t = licenses.Templates(templates)
    vocabulary = "one two three four five six seven nine ten x y z".split()
    for _ in range(150):
        words = [rng.choice(vocabulary) for _ in range(6)] + [w if rng.random() > 0.1 else rng.choice(vocabulary) for w in templates[rng.choice("ab")].split()] + ["z"] * 9 + [rng.choice(vocabulary) for _ in range(3)]
        found = {m[0] for m in t.matches(" ".join(words))}
        exact = {i for i, c in enumerate(t.counts) for at in range(len(words)) if licenses.Counter(licenses.bigrams(words[at : at + c.total() + 1])) == c}
        assert {i for i in exact if i != 2} <= found | {m for m in range(3) if found}
        for i, a, b, s in t.matches(" ".join(words)):
            assert s == licenses.dice(licenses.Counter(licenses.bigrams(words[a:b])), t.counts[i]) >= 0.8


def test_query_and_odd_rows(spark):
    got = {r.doc_id: r for r in licenses.op3_dice_licenses(spark, SF).collect()}
    t, names = licenses.Templates(licenses.TEMPLATES), list(licenses.TEMPLATES)
    texts = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(texts)
    for x in texts:
        want = [f"{names[i]}:{a}:{b}" for i, a, b, _ in t.matches(x.text or "")]
        assert [y.rsplit(":", 1)[0] for y in got[x.doc_id].licenses.split(",") if y] == want and got[x.doc_id].n_licenses == len(want)
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "Released under the MIT License " + "w " * 100000, 3)], "doc_id long, text string, dice int")
    rows = licenses.scanned(docs).collect()
    assert len(rows) == 4 and sum(len(r["__licenses"]) for r in rows) == 1 and licenses.scanned(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.Templates({"short": "one"})


@pytest.mark.parametrize("name", ["Apache-2.0-header", "ISC", "BSD-2-Clause", "GPL-3.0-header"])
@pytest.mark.parametrize("extra", [7, 8, 10])
def test_long_insertions(name, extra):
    words = licenses.normal_words(licenses.TEMPLATES[name])
    t, at = licenses.Templates(licenses.TEMPLATES), len(words) // 2
    text = [*words[:at], *(f"foo{i}" for i in range(extra)), *words[at:]]
    want = licenses.dice(licenses.Counter(licenses.bigrams(text)), licenses.Counter(licenses.bigrams(words)))
    assert want >= 0.8 and t.matches(" ".join(["before", *text, "after"])) == [(t.names.index(name), 1, len(text) + 1, want)]


def every_window(t, words):
    """The matches by the rule alone: every template, every window of every size, the best of those that overlap."""
    pairs, found = licenses.bigrams(words), []
    for i, c in enumerate(t.counts):
        for a in range(len(pairs)):
            for b in range(a + 1, len(pairs) + 1):
                n = licenses.Counter(pairs[a:b])
                score = licenses.dice(n, c)
                if score >= t.threshold:
                    found.append(((n & c).total(), score, i, a, b + 1))
    kept = []
    for _, s, i, a, b in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
        if all(b <= x[1] or a >= x[2] for x in kept):
            kept.append((i, a, b, s))
    return sorted(kept, key=lambda x: x[1])


def test_equals_every_window_of_every_size():
    rng = random.Random(4)
    t = licenses.Templates({"a": "one two three four five six seven one two", "b": "one two three nine ten", "c": "x y", "d": "in the one of the two in the three of the four of the five in the six"})
    vocabulary, some = "one two three four five six seven nine ten x y z of in the".split(), 0
    for _ in range(120):
        words = []
        for _ in range(rng.choice([1, 2, 3])):
            own = "one two three four five six seven one two|one two three nine ten|in the one of the two in the three of the four of the five in the six".split("|")[rng.randrange(3)].split()
            words += [w if rng.random() > 0.08 else rng.choice(vocabulary) for w in own[: rng.choice([len(own), len(own) * 3 // 4])]] + [rng.choice(vocabulary) for _ in range(rng.randrange(8))]
        want = every_window(t, words)
        some += len(want)
        assert t.matches(" ".join(words)) == want
    assert some > 100


@pytest.mark.parametrize("share,after", [(0.75, "and the number of the pages in the book "), (0.7, "The history of the town is told in the second part of the book ")])
def test_shortened_copy_before_prose(share, after):
    words = licenses.normal_words(licenses.TEMPLATES["MIT"])
    t = licenses.Templates(licenses.TEMPLATES)
    got = t.matches(" ".join(words[: int(len(words) * share)]) + " " + after * 20)
    assert [t.names[m[0]] for m in got] == ["MIT"]
