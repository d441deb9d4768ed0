import re

from leafmill.llm import quality_rules

SCHEMA = "doc_id long, text string, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "one", "a b c d e", "a b c d e f", "x " * 40, "a b c d e\na b c d e\n\na b c d e", "  lead # & \x0b\x0c ü é 日本 ", "p q r s t u v p q r s t z z z", "the of and to in is that it was on\n" * 3]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)], SCHEMA)
    for r in quality_rules.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.text
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert quality_rules.judge(docs.limit(0)).collect() == []


def test_clean_and_junk(spark):
    clean = "The house by the river was old and it had been empty for a long time before they came to see it."
    docs = spark.createDataFrame([(1, clean, ""), (2, re.sub(r"(\w+)", r"\1&&&", clean), ""), (3, "zxqv " + " ".join(f"qq{i}" for i in range(40)), "")], SCHEMA)
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == {1}


def test_columns_of_any_name(spark):
    names = ["__q_n_words", "__q_words", "__Q_kept", "___q_text", "kept", "base_failed"]
    rows = [(i, t, "old", *range(len(names))) for i, t in enumerate([*TEXTS, *TEXTS])]  # rows that repeat, too
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{x}` int" for x in names))
    judged = quality_rules.judge(docs).collect()
    assert len(judged) == len(rows)
    assert all((r["__q_n_words"], r["__q_words"], r["__Q_kept"], r["___q_text"]) == (0, 1, 2, 3) and r.n_words == brute(r.text)[0] for r in judged)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and all(tuple(r)[3:] == tuple(range(len(names))) for r in kept.collect())


def test_very_long_text(spark):
    text = "the house of the river " + " ".join(f"w{i}" for i in range(60_000))
    (r,) = quality_rules.judge(spark.createDataFrame([(1, text, "")], SCHEMA)).collect()
    assert (r.n_words, r.n_repeat_words, r.word_chars) == (60_005, 0, len(text) - 60_004)
