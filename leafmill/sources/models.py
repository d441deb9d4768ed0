"""Model calls behind an injected function: registry, retries, check and second try."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: generate(system, user) -> text, by provider name.
PROVIDERS: dict[str, Callable[[str, str], str]] = {}
WAITS = (5.0, 10.0, 20.0)
_AGAIN = re.compile(r"(?i)429|503|500|rate|internal")


def provider(name: str) -> Callable[[str, str], str]:
    if name not in PROVIDERS:
        raise KeyError(f"unknown provider {name}; known: {', '.join(sorted(PROVIDERS)) or 'none'}")
    return PROVIDERS[name]


def call(generate: Callable[[str, str], str], system: str, user: str, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(answer, error) after retries of errors that may pass."""
    for wait in (*WAITS, None):
        try:
            return generate(system, user), None
        except Exception as e:  # any failure of a foreign function is a row's error
            if wait is None or not _AGAIN.search(str(e)):
                return None, str(e)
            sleep(wait)
    return None, None


def answers(rows: DataFrame, generate: Callable[[str, str], str], sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """rows (key, system, user) to (key, answer, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [call(generate, s, u, sleep) for s, u in zip(b["system"], b["user"])]
            yield pd.DataFrame({"key": b["key"], "answer": [a for a, _ in got], "error": [e for _, e in got]})

    return rows.select("key", "system", "user").mapInPandas(run, "key string, answer string, error string")


def ask_twice(rows: DataFrame, generate: Callable[[str, str], str], issues: Callable[[DataFrame], DataFrame], sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Answers whose issues (an added array column `issues`) go back once with the question."""
    first = issues(answers(rows, generate, sleep))
    good = first.filter("size(issues) = 0")
    bad = rows.join(first.filter("size(issues) > 0").select("key", "issues"), "key")
    again = bad.withColumn("user", F.concat("user", F.lit("\nFix: "), F.array_join("issues", "; ")))
    return good.unionByName(issues(answers(again, generate, sleep)))


def known_first(rows: DataFrame, known: DataFrame, generate: Callable[[str, str], str], sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Known answers (key, answer) where there are some; the model only for the rest."""
    rest = answers(rows.join(known.select("key"), "key", "left_anti"), generate, sleep)
    return rows.select("key").join(known, "key").select("key", "answer", F.lit(None).cast("string").alias("error")).unionByName(rest)
