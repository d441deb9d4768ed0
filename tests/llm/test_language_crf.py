import random

import numpy as np

from leafmill.llm import language_crf as crf

WORDS = {"en": "the thing with other having been should would could their and that this from where".split(), "de": "der die das nicht haben werden können schön über ein eine und auch wieder zwischen".split(), "fr": "le la les être avoir très où était aussi dans pour avec cette leur deux".split()}
RNG = random.Random(4)


def line(lang, n):
    return " ".join(RNG.choice(WORDS[lang]) for _ in range(n))


DOCS = [(i, "\n".join(line(lang, 12) for _ in range(3)), lang) for i in range(240) for lang in [RNG.choice(list(WORDS))]]


def test_posteriors_against_enumeration():
    rng = np.random.default_rng(0)
    e, t = rng.random((7, 3)) + 0.1, rng.random((3, 3)) + 0.1
    got = crf.posteriors(e, t, np.array([0, 4]), np.array([4, 3]))
    for start, n in ((0, 4), (4, 3)):
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            p = np.prod([e[start + i, y] for i, y in enumerate(path)]) * np.prod([t[a, b] for a, b in zip(path, path[1:])])
            for i, y in enumerate(path):
                want[i, y] += p
        want /= want.sum(1, keepdims=True)
        assert np.allclose(got[start : start + n], want)


def test_switched_text():
    model = crf.fit_chains([(t, x) for _, t, x in DOCS])
    assert model.predict([line("en", 30) + " " + line("de", 6), line("fr", 5), "", "12 34 ²", None or ""])[0][0] == "en"
    assert model.predict([line("fr", 5)])[0][0] == "fr"
    label, share = model.predict([line("en", 20) + " " + line("de", 20)])[0]
    assert share < 0.8
    assert model.predict(["", "12 ² _"]) == [("und", 0.0)] * 2


def test_documents(spark):
    rows = [(i, t, x, 1) for i, t, x in DOCS] + [(500, None, "en", 1), (501, "1 2", None, 1), (None, "der die das", None, 1), (502, "the " * 30_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    model = crf.fit(docs)
    got = {r.doc_id: r for r in crf.predict(docs, model).collect()}
    assert np.mean([got[i].lang_pred == x for i, _, x in DOCS]) > 0.97
    assert (got[500].lang_pred, got[501].lang_pred, got[502].lang_pred) == ("und", "und", "en")
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = docs.limit(0)
    assert [r.lang_pred for r in crf.predict(docs, crf.fit(empty)).collect()] == ["und"] * len(rows)
    assert crf.predict(empty, model).count() == 0


def test_long_documents_are_learned_from(spark):
    rows = [(i, line("de", 40), "de") for i in range(40)] + [(100 + i, line("fr", 9000), "fr") for i in range(40)]
    model = crf.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "fr"]
    assert [x for x, _ in model.predict([line("fr", 30), line("de", 30), line("fr", 8000)])] == ["fr", "de", "fr"]


def test_many_languages(monkeypatch):
    monkeypatch.setattr(crf, "WEIGHTS", 1 << 20)
    monkeypatch.setattr(crf, "STEPS", 60)
    rng = random.Random(8)
    own = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)] for i in range(210)}
    model = crf.fit_chains([(" ".join(rng.choice(ws) for _ in range(40)), x) for x, ws in own.items() for _ in range(3)])
    assert len(model.languages) == 210 and model.slots == 1 << 12
    found = model.predict([" ".join(rng.choice(ws) for _ in range(30)) for ws in own.values()])
    assert np.mean([x == y for (x, _), y in zip(found, own)]) > 0.95


def test_table_stays_within_its_bound():
    assert crf.slots_for(2) == crf.SLOTS and crf.slots_for(100_000) == 1 << 12
    for k in (300, 1000, 5000):
        assert crf.slots_for(k) * k <= crf.WEIGHTS < 2 * crf.slots_for(k) * k


def test_spans_and_score(spark):
    model = crf.fit_chains([(t, x) for _, t, x in DOCS])
    parts = [("en", line("en", 14)), ("de", line("de", 12)), ("fr", line("fr", 15))]
    text = "-- \u0130! " + ", ".join(t for _, t in parts) + "\n\n12 ²\n" + parts[1][1]
    (lang, score, spans), empty = model.label([text, ""])
    assert empty == ("und", 0.0, [])
    assert all(a < z <= b for (a, z, _, _), (b, _, _, _) in zip(spans, spans[1:])) and all(0 < p <= 1 for *_, p in spans)
    for want, t in [*parts, parts[1]]:
        at = text.index(t) if (want, t) != parts[1] else text.rindex(t)
        inside = sum(min(z, at + len(t)) - max(a, at) for a, z, x, _ in spans if x == want and a < at + len(t) and z > at)
        assert inside > 0.8 * len(t)
    # no span runs over the end of a line, and each begins and ends with a letter
    assert all("\n" not in text[a:z] and text[a].isalpha() and text[z - 1].isalpha() for a, z, _, _ in spans)
    # the document's share is the mean of its words' distributions, line by line
    words = [crf.words_of(x) for x in crf.lowered(text).split("\n")]
    mass = np.zeros(3)
    for ws in words:
        if ws:
            e = np.exp(model.emissions(ws)) * 1.0
            for i, w in enumerate(ws):
                if not any(map(str.isalpha, w)):
                    e[i] = 1
            mass += (crf.posteriors(e, np.exp(model.transitions), np.array([0]), np.array([len(ws)])) * np.array([any(map(str.isalpha, w)) for w in ws])[:, None]).sum(0)
    assert model.languages[int(mass.argmax())] == lang and abs(mass.max() / mass.sum() - score) < 1e-6
    docs = spark.createDataFrame([(1, text), (2, None), (2, None)], "doc_id long, text string")
    rows = crf.label(docs, model).orderBy("doc_id").collect()
    assert [tuple(x) for x in rows[0].spans] == spans and rows[1] == rows[2] and rows[1].spans == []
