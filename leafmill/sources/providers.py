"""Clients of model servers over HTTP, and a log of answers by what was asked, so that no paid call is made twice."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import models

#: What is asked not to be blocked.
CATEGORIES = ("HARM_CATEGORY_HATE_SPEECH", "HARM_CATEGORY_DANGEROUS_CONTENT", "HARM_CATEGORY_HARASSMENT", "HARM_CATEGORY_SEXUALLY_EXPLICIT")


def _post(url: str, body: dict, headers: Mapping[str, str], timeout: float) -> dict:
    """The JSON that a server answers; an error status is an error that names it."""
    request = Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except HTTPError as e:
        said = e.read(2000).decode("utf-8", "replace")
        raise RuntimeError(f"HTTP {e.code}: {said}") from None  # no URL: its words aren't the error's


@dataclass(frozen=True)
class LocalChat:
    """A chat server of one's own: POST {base}/api/chat."""

    model: str
    base_url: str = "http://localhost:11434"
    temperature: float = 0.0
    timeout_seconds: float = 300.0

    def __call__(self, system: str, user: str) -> str:
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "stream": False, "options": {"temperature": self.temperature}}
        return _post(f"{self.base_url.rstrip('/')}/api/chat", body, {}, self.timeout_seconds)["message"]["content"].strip()


@dataclass(frozen=True)
class HostedModel:
    """A hosted model with a key: POST {base}/v1beta/models/{model}:generateContent. The key goes in a header and is in no error and no log."""

    model: str
    api_key: str = field(repr=False)
    base_url: str = "https://generativelanguage.googleapis.com"
    temperature: float = 0.0
    max_tokens: int = 4096
    timeout_seconds: float = 300.0

    def __call__(self, system: str, user: str) -> str:
        if not self.api_key:
            raise ValueError("no key for the hosted model")
        body = {
            "system_instruction": {"parts": [{"text": system}]}, "contents": [{"parts": [{"text": user}]}],
            "generationConfig": {"temperature": self.temperature, "maxOutputTokens": self.max_tokens}, "safetySettings": [{"category": c, "threshold": "BLOCK_NONE"} for c in CATEGORIES],
        }
        got = _post(f"{self.base_url.rstrip('/')}/v1beta/models/{self.model}:generateContent", body, {"x-goog-api-key": self.api_key}, self.timeout_seconds)
        found = got.get("candidates") or []
        if not found:
            blocked = got.get("promptFeedback", {}).get("blockReason")
            raise RuntimeError(f"blocked: {blocked}" if blocked else "no candidates in the answer")
        # thoughts are no part of the answer
        return "".join(p.get("text", "") for p in found[0].get("content", {}).get("parts", []) if not p.get("thought")).strip()


def register(env: Mapping[str, str], temperature: float = 0.0, max_tokens: int = 4096) -> None:
    """Put both clients into the registry of `sources.models`, by settings such as the environment's."""
    models.PROVIDERS["ollama"] = LocalChat(env.get("OLLAMA_MODEL", ""), env.get("OLLAMA_BASE_URL") or LocalChat.base_url, temperature)
    models.PROVIDERS["gemini"] = HostedModel(env.get("GEMINI_MODEL", ""), env.get("GEMINI_API_KEY", ""), env.get("GEMINI_BASE_URL") or HostedModel.base_url, temperature, max_tokens)


def question(system: str, user: str, model: str) -> str:
    """The name of a question in the log."""
    return hashlib.sha256(json.dumps([model, system, user]).encode()).hexdigest()


class AnswerLog:
    """Answers in a folder that all executors share, a file a question, there before the task that asked goes on.

    A task that finds an answer doesn't ask. One that finds only the claim of another waits for its answer, and takes over when the claim is older than any call can last, which
    is when its owner is gone. Errors aren't kept: a question that failed is asked again.
    """

    def __init__(self, folder: str, model: str, call_seconds: float = 600.0, sleep: Callable[[float], None] = time.sleep):
        self.folder, self.model, self.call_seconds, self._sleep = folder, model, call_seconds, sleep

    def _path(self, name: str, kind: str) -> str:
        return os.path.join(self.folder, name[:2], f"{name}.{kind}")

    def known(self, name: str) -> str | None:
        try:
            with open(self._path(name, "json"), encoding="utf-8") as f:
                return json.load(f)["answer"]
        except FileNotFoundError:
            return None

    def _claim(self, name: str) -> bool:
        """Whether the question is now this task's to ask."""
        path = self._path(name, "asked")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return True
        except FileExistsError:
            try:
                if time.time() - os.stat(path).st_mtime > self.call_seconds:
                    os.utime(path)
                    return True
            except FileNotFoundError:
                pass
        return False

    def ask(self, generate: Callable[[str, str], str], system: str, user: str) -> tuple[str | None, str | None]:
        """(answer, error), with a call only where the log has no answer."""
        name = question(system, user, self.model)
        while (found := self.known(name)) is None and not self._claim(name):
            self._sleep(0.2)
        if found is not None:
            return found, None
        answer, error = models.call(generate, system, user, self._sleep)
        if answer is not None:
            part = self._path(name, f"{uuid.uuid4().hex}.tmp")
            with open(part, "w", encoding="utf-8") as f:
                json.dump({"question": name, "model": self.model, "answer": answer}, f, ensure_ascii=False)
            os.replace(part, self._path(name, "json"))
        else:
            os.unlink(self._path(name, "asked"))
        return answer, error


def logged_answers(rows: DataFrame, generate: Callable[[str, str], str], log: AnswerLog) -> DataFrame:
    """rows (key, system, user) to (key, answer, error); what the log knows costs no call, whoever asked it: an earlier run, an attempt of this task that was lost, or another row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [log.ask(generate, s or "", u or "") for s, u in zip(b["system"], b["user"])]
            yield pd.DataFrame({"key": b["key"], "answer": [a for a, _ in got], "error": [e for _, e in got]}, dtype=object)

    return rows.select("key", "system", "user").mapInPandas(run, "key string, answer string, error string")


def log_table(spark: SparkSession, folder: str) -> DataFrame:
    """The log as rows: question, model, answer."""
    return spark.read.schema("question string, model string, answer string").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(folder)
