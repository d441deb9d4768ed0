"""Quality rules: a threshold table compiled into one projection of built-in functions.

Contract for odd input: a null or empty text has no words, so every count is 0 and it fails the
base rule; rows that repeat are judged alike and kept as often as they come; other columns of
the input are carried or ignored as the caller asks, never read, whatever their names (the
measures' own names get a prefix that no column has). An empty table gives an empty
result. Texts of any length are judged whole, inside their own row, with no shuffle. The
stop-word rule knows four languages: a text in none of them fails it, so for a corpus in others
pass `rules` without it or with words of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that ends a word: the bytes 0x20 and 0x09 to 0x0D.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or re that the this to was with you "
    "aber auf das dem den der des die du ein eine er es für ich im ist mit nicht sich sie und von war zu "
    "au aux ce dans de des elle en est et il je la le les mais ne pas pour que qui se sur un une "
    "al como con del el ella en era es la las lo los más no para pero por que se su sus un una y"
)


@dataclass(frozen=True)
class Rule:
    """A measure has to lie between two bounds, both included; None is no bound."""

    measure: str
    least: float | None
    most: float | None


#: The verdict beyond the base rule. Measures are those of `measures`.
RULES = (
    Rule("n_words", 10, None),
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.3),
    Rule("stop_word_share", 0.03, None),
    Rule("dup_line_share", None, 0.4),
    Rule("repeat_word_share", None, 0.2),
)


def free_prefix(docs: DataFrame) -> str:
    """One that no column of docs begins with."""
    prefix = "__q_"
    while any(x.lower().startswith(prefix) for x in docs.columns):
        prefix = "_" + prefix
    return prefix


def measures(docs: DataFrame, text: str = "text", prefix: str = "__q_") -> DataFrame:
    """docs with the measures as columns named prefix + name; no column of docs may begin with prefix."""
    p = prefix
    whole, stop = F.coalesce(F.col(text), F.lit("")), F.array(*[F.lit(x) for x in sorted(set(STOP_WORDS.split()))])
    q = {}

    def c(name: str) -> Column:
        return F.col(p + name)

    def windows(words: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    docs = docs.withColumns({p + "text": whole, p + "bare": F.btrim(whole, F.lit(SPACE))})
    docs = docs.withColumns(
        {
            p + "words": F.when(c("bare") == "", F.array().cast("array<string>")).otherwise(F.split(c("bare"), r"[\x20\x09-\x0D]+")),
            p + "lines": F.filter(F.split(c("text"), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
        }
    )
    docs = docs.withColumns({p + "n_words": F.size(c("words")).cast("long"), p + "hashes": F.when(F.size(c("words")) > WINDOW, windows(c("words"), F.size(c("words"))))})
    # most texts repeat no window: only the others are sorted
    docs = docs.withColumn(
        p + "sorted",
        F.when(F.size(F.array_distinct(c("hashes"))) < F.size(c("hashes")), F.sort_array(F.transform(c("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    same = lambda e, j: F.get(c("sorted"), j)["h"] == e["h"]
    docs = docs.withColumn(
        p + "at",
        F.sort_array(F.transform(F.filter(c("sorted"), lambda e, j: F.coalesce(same(e, j + 1), F.lit(False)) | ((j > 0) & same(e, j - 1))), lambda e: e["i"])),
    )
    covered = F.aggregate(F.transform(c("at"), lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(c("at"), k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    q[p + "word_chars"] = F.char_length(F.translate(c("text"), SPACE, "")).cast("long")
    q[p + "n_symbols"] = (F.char_length(c("text")) - F.char_length(F.translate(c("text"), SYMBOLS, ""))).cast("long")
    q[p + "n_dup_lines"] = (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long")
    q[p + "n_repeat_words"] = F.coalesce(covered, F.lit(0)).cast("long")
    q[p + "n_stop_words"] = F.when(c("n_words") == 0, 0).otherwise(F.size(F.filter(F.split(F.lower(c("bare")), r"[^\p{L}]+"), lambda w: F.array_contains(stop, w))))
    docs = docs.withColumns(q)
    per_word = lambda x: c(x) / F.greatest(c("n_words"), F.lit(1))
    return docs.withColumns(
        {
            p + "mean_word_chars": per_word("word_chars"),
            p + "symbols_per_word": per_word("n_symbols"),
            p + "stop_word_share": per_word("n_stop_words"),
            p + "repeat_word_share": per_word("n_repeat_words"),
            p + "dup_line_share": c("n_dup_lines") / F.greatest(F.size(c("lines")), F.lit(1)),
        }
    )


def verdict(rules: tuple[Rule, ...] = RULES, prefix: str = "__q_") -> Column:
    """The table as one condition."""
    out = F.lit(True)
    for r in rules:
        x = F.col(prefix + r.measure)
        if r.least is not None:
            out = out & (x >= r.least)
        if r.most is not None:
            out = out & (x <= r.most)
    return out


def base_failed(prefix: str = "__q_") -> Column:
    n = F.col(prefix + "n_words")
    return (n < 10) | (100 * F.col(prefix + "n_repeat_words") > 20 * n)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every column of docs, then the counts, base_failed and kept; same-named columns of docs are replaced."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    p = free_prefix(docs)
    out = measures(docs, text, p)
    own = [F.col(x) for x in map(_quoted, docs.columns) if x.strip("`") not in (*names, "base_failed", "kept")]
    failed = base_failed(p)
    return out.select(*own, *[F.col(p + x).alias(x) for x in names], failed.alias("base_failed"), _held(~failed & verdict(rules, p)).alias("kept"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _held(condition: Column) -> Column:
    """A condition that no filter above can be pushed below: there, each measure's whole expression
    would stand wherever another one uses it. A row number, never negative, pins it to its projection."""
    return condition & (F.monotonically_increasing_id() >= 0)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, with the columns they had."""
    p = free_prefix(docs)
    out = measures(docs, text, p).withColumn(p + "kept", _held(~base_failed(p) & verdict(rules, p)))
    return out.filter(F.col(p + "kept")).select(*[F.col(x) for x in map(_quoted, docs.columns)])
