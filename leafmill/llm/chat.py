"""Chat formatting with a grammar that is read back before the output counts as done.

A formatted conversation is, for each turn, ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. A literal
control string in a text is written with one backslash more after its ``<`` (``<\\|im_end|>``
stands for ``<|im_end|>``, ``<\\\\|im_end|>`` for ``<\\|im_end|>``), so every text can be told from
the marks around it. Formatting is a round trip: each turn is rendered bare, parsed by the
grammar, and compared with its source; a turn that doesn't come back is escaped, and the whole
conversation is parsed and compared again. One that still differed would raise an error.

Everything is made of built-in functions, on the main path and for the masks. A conversation is
one row, which is what its output is; only one exchange, by conv_id, gathers its turns.

Contract for odd input: null texts and roles are empty; a role's newlines and backslashes are
written ``\\n`` and ``\\\\``; turns are in order of (turn, role, text), nulls first, and repeated
rows are repeated turns; a null conv_id is a conversation of its own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: A control string with any number of backslashes, and one with a backslash at least.
_ANY, _ESCAPED = r"<(\\*)\|(im_start|im_end)\|>", r"<\\(\\*)\|(im_start|im_end)\|>"
_TURN = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, _ANY, r"<\\$1|$2|>")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, _ESCAPED, r"<$1|$2|>")


def _write_role(x: Column) -> Column:
    return escape(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _read_role(x: Column) -> Column:
    # between doubled backslashes, which stand for one, every other pair is a newline
    parts = F.transform(F.split(F.replace(unescape(x), F.lit("\\\\"), F.lit("\n")), "\n"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def _render(turns: Column, text: str) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["head"], F.lit("\n"), t[text], F.lit(END + "\n"))), "")


def _parse(formatted: Column) -> Column:
    """The turns as the grammar reads them, still escaped: heads and bodies."""
    return F.arrays_zip(F.regexp_extract_all(formatted, F.lit(_TURN), 1).alias("head"), F.regexp_extract_all(formatted, F.lit(_TURN), 2).alias("body"))


def _digest_text(turns: Column, role: str, text: str) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t[role], F.lit("\n"), t[text], F.lit("\n"))), "")


def format_conversations(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """A row per conversation: conv_id, formatted, and loss_spans, the code points [start, stop) of
    the texts to train on."""
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    whole = rows.groupBy(F.col("conv_id").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("__turns"))
    # bare, read back: what the grammar takes for something else, or unescapes to something else, is escaped
    whole = whole.withColumn(
        "__turns",
        F.transform(
            "__turns",
            lambda t: F.struct(
                t["role"].alias("role"),
                t["text"].alias("text"),
                _write_role(t["role"]).alias("head"),
                F.when(_comes_back(t["text"]), t["text"]).otherwise(escape(t["text"])).alias("body"),
            ),
        ),
    )
    whole = whole.withColumn("formatted", _render(F.col("__turns"), "body"))
    whole = whole.withColumn("__read", _parse(F.col("formatted")))
    read = F.transform("__read", lambda t: F.struct(_read_role(t["head"]).alias("role"), unescape(t["body"]).alias("text")))
    source = F.transform("__turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    fixed = len(START) + 1 + len(END) + 1
    # where each turn's text starts: the running length of what is before it
    step = F.aggregate(
        "__read",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + fixed + F.char_length(t["head"]) + F.char_length(t["body"])).alias("at"),
            F.when(
                _read_role(t["head"]) == trained_role,
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            (a["at"] + len(START) + F.char_length(t["head"]) + 1).alias("start"),
                            (a["at"] + len(START) + F.char_length(t["head"]) + 1 + F.char_length(t["body"])).alias("stop"),
                        )
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )
    whole = whole.withColumn("__step", step)
    same = (read == source) & (F.col("__step.at") == F.char_length("formatted"))
    return whole.select(
        "conv_id",
        F.when(same, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("not read back: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))).alias("formatted"),
        F.col("__step.spans").alias("loss_spans"),
    )


def _comes_back(text: Column) -> Column:
    """Whether a text rendered bare as one turn is read back as it was."""
    alone = F.concat(F.lit(START + "r\n"), text, F.lit(END + "\n"))
    bodies = F.regexp_extract_all(alone, F.lit(_TURN), 2)
    return (F.size(bodies) == 1) & (unescape(F.get(bodies, F.lit(0))) == text) & ~F.contains(text, F.lit(START)) & ~F.contains(text, F.lit(END))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Digests of what format_conversations wrote, taken from its output alone."""
    out = formatted.withColumn("__turns", F.transform(_parse(F.col("formatted")), lambda t: F.struct(_read_role(t["head"]).alias("role"), unescape(t["body"]).alias("text"))))
    out = out.withColumn("__loss", F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))), ""))
    return out.select(
        "conv_id",
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(_digest_text(F.col("__turns"), "role", "text"), 256).alias("turns_sha256"),
        F.char_length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
