import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from leafmill.llm import quality_rules
from tests.llm.test_near_copies import brute_kept

STOP = set(quality_rules.STOP_WORDS.split())


def brute_good(text):
    """The threshold table by hand."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeat = len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)})
    if len(words) < 10 or 100 * repeat > 20 * len(words):
        return False
    n, lines = len(words), [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    stop = sum(w in STOP for w in re.split(r"[^a-zäöüß]+", text.lower()))
    mean, symbols = sum(map(len, words)) / n, sum(c in "#*$%&|<>" for c in text) / n
    return 2 <= mean <= 15 and symbols <= 0.3 and stop / n >= 0.03 and (len(lines) - len(set(lines))) / len(lines) <= 0.4 and repeat / n <= 0.2


def documents():
    """Prose with toxic, junk, repeated and nearly equal texts; (doc_id, text, toxic)."""
    rng = random.Random(12)
    plain = ["".join(rng.choice("ab eo rt in st lu mo".split()) for _ in range(3)) for _ in range(400)]
    common = "the of and to in is that it was on".split()

    def prose(toxic):
        words = [rng.choice(common) if rng.random() < 0.3 else rng.choice(plain) for _ in range(rng.randrange(60, 160))]
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["grumbal", "vexolar", "Grumbal!"]))
        return " ".join(words)

    rows = [(i, prose(i % 7 == 0), int(i % 7 == 0)) for i in range(420)]
    for i in range(40):  # copies: exact ones, and ones with a few other words
        words = rows[i * 3 + 1][1].split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = rng.choice(plain)
        rows.append((500 + i, " ".join(words), rows[i * 3 + 1][2]))
    rows += [(600, None, 0), (601, "", 0), (602, "too short", 0), (603, "zxqv ### " * 30, 0), (604, "&&& $$$ ### *** of the and to in is that it " * 3, 0), (605, "word by word the same line of text here\n" * 9, 0)]
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame([(i, t, None, "s", None, "own") for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long, node string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labelled = [(i, 1, y) for i, _, y in rows if i % 5]  # a fifth has no label
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, text, toxic = spark.read.parquet(f"{tmp_path}/documents.parquet"), {i: t for i, t, _ in rows}, {i for i, _, y in rows if y}
    names, kept = at.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == names and at.filter("node = 'own' AND source = 's'").count() == at.count()
        kept.append(sorted(r.doc_id for r in at.collect()))
    assert kept[0] == sorted(i for i, t, _ in rows if brute_good(t))
    # the labels are what a word that only toxic texts have says, so the score has to follow them, for the unlabelled and the held out too
    assert kept[1] == [i for i in kept[0] if i not in toxic] and len(kept[0]) - len(kept[1]) > 50
    assert any(zlib.crc32(str(i).encode()) % 4 == 2 or not i % 5 for i in toxic)
    assert set(kept[2]) == brute_kept([(i, text[i], 0) for i in kept[1]]) and len(kept[2]) < len(kept[1])
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert sorted(pieces) == kept[2]
    for i, mine in pieces.items():
        mine.sort(key=lambda r: r.start)
        ids = t.encode(text[i], add_special_tokens=False).ids + [1]
        assert [x for r in mine for x in r.ids] == ids and all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_dedup", "packing"]


def test_empty_table(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
