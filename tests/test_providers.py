"""Two providers against a server on this machine, and the log of answers."""

import json
import os
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from leafmill.sources import models, providers


@pytest.fixture
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body, self.headers.get("x-goog-api-key")))
            if self.path == "/api/chat":
                user = body["messages"][1]["content"]
                out = {"message": {"content": f" {body['messages'][0]['content']}|{user} \n"}}
            else:
                user = body["contents"][0]["parts"][0]["text"]
                parts = [{"text": "hm", "thought": True}, {"text": " a"}, {"text": "b "}]
                out = {"promptFeedback": {"blockReason": "SAFETY"}} if user == "bad" else {} if user == "none" else {"candidates": [{"content": {"parts": parts}}]}
            status = 503 if user == "busy" else 400 if user == "wrong" else 200
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_providers(server):
    root, asked = server
    providers.register({"OLLAMA_MODEL": "m1", "OLLAMA_BASE_URL": root, "GEMINI_MODEL": "m2", "GEMINI_API_KEY": "secret-key", "GEMINI_BASE_URL": root}, 0.5, 77)
    local, hosted = models.provider("ollama"), models.provider("gemini")
    assert local("s", "u") == "s|u" and hosted("s", "u") == "ab"
    assert asked[0][:2] == ("/api/chat", {"model": "m1", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}], "stream": False, "options": {"temperature": 0.5}})
    path, body, key = asked[1]
    assert (path, key) == ("/v1beta/models/m2:generateContent", "secret-key") and body["generationConfig"] == {"temperature": 0.5, "maxOutputTokens": 77} and len(body["safetySettings"]) == 4
    waits = []
    assert models.call(local, "s", "busy", waits.append)[1].startswith("HTTP 503") and waits == [5.0, 10.0, 20.0]
    error = models.call(hosted, "s", "wrong", waits.append)[1]
    assert error.startswith("HTTP 400") and "secret" not in error + repr(hosted) and len(waits) == 3
    assert models.call(hosted, "s", "bad")[1] == "blocked: SAFETY" and models.call(hosted, "s", "none")[1] == "no candidates in the answer"
    assert "no key" in models.call(providers.HostedModel("m", ""), "s", "u")[1]


def test_no_call_is_made_twice(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def generate(system, user):
        with open(calls, "a") as f:
            f.write(user + "\n")
        if user == "kill" and open(calls).read().count("kill") == 1:
            time.sleep(1)
            os._exit(1)  # the worker is gone in the middle of its task
        if user == "fails":
            raise RuntimeError("no")
        return user.upper()

    rows = spark.createDataFrame([(str(i), "s", u) for i, u in enumerate(["a", "b", "kill", "c", "a", "fails"])], "key string, system string, user string").coalesce(1)
    log = providers.AnswerLog(str(tmp_path / "log"), "m", call_seconds=0.5)
    with pytest.raises(Exception):  # noqa: B017  the job fails with its task
        providers.logged_answers(rows, generate, log).collect()
    got = {r.key: (r.answer, r.error) for r in providers.logged_answers(rows, generate, log).collect()}
    assert got == {"0": ("A", None), "1": ("B", None), "2": ("KILL", None), "3": ("C", None), "4": ("A", None), "5": (None, "no")}
    providers.logged_answers(rows, generate, log).collect()
    assert Counter(open(calls).read().split()) == {"a": 1, "b": 1, "kill": 2, "c": 1, "fails": 2}
    assert sorted(r.answer for r in providers.log_table(spark, str(tmp_path / "log")).collect()) == ["A", "B", "C", "KILL"]
    # two tasks with one question at once: one asks, the other gets its answer
    same = spark.createDataFrame([(str(i), "s", "slow") for i in range(4)], "key string, system string, user string").repartition(4)

    def slow(system, user):
        with open(calls, "a") as f:
            f.write(user + "\n")
        time.sleep(1)
        return "done"

    assert {r.answer for r in providers.logged_answers(same, slow, providers.AnswerLog(str(tmp_path / "log"), "m")).collect()} == {"done"}
    assert open(calls).read().split().count("slow") == 1
