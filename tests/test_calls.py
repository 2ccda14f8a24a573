"""Client calls: a real endpoint with its failures, and answers that outlive tasks and runs."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from siltstone.operators import verify as V

GOOD = {"choices": [{"message": {"content": '{"verdict": "benign", "confidence": 0.7}'}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}


@pytest.fixture
def endpoint():
    """A server on a local socket that answers as the script says, a (status, body, seconds) a call."""
    script, seen = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.path, self.headers["Authorization"], json.loads(body)))
            status, answer, wait = script.pop(0) if script else (200, json.dumps(GOOD), 0)
            time.sleep(wait)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(answer.encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", script, seen
    server.shutdown()
    server.server_close()


def test_an_endpoint_that_fails(endpoint):
    url, script, seen = endpoint
    waits = []
    client = V.ChatClient(url, "m", "s3cret", seconds=0.5, wait=waits.append)
    ask = [{"role": "user", "content": "é"}]
    script += [(429, "", 0), (500, "oops", 0)]
    assert client(ask) == ('{"verdict": "benign", "confidence": 0.7}', 3, 1)
    assert waits == [2.0, 4.0] and len(seen) == 3 and seen[0][:2] == ("/v1/chat/completions", "Bearer s3cret") and seen[0][2]["messages"] == ask
    script += [(200, json.dumps(GOOD), 1.5)]  # longer than the client waits; the next answer is in time
    assert client(ask)[1] == 3
    script += [(503, "", 0)] * 3
    with pytest.raises(V.ChatError, match="failed 3 times, at last with status 503"):
        client(ask)
    for bad in ("no json", "[]", '{"choices": []}'):
        script.append((200, bad, 0))
        with pytest.raises(V.ChatError, match="malformed"):
            client(ask)
    script.append((401, "s3cret", 0))
    with pytest.raises(V.ChatError, match="^status 401$"):
        client(ask)


def test_verdicts_over_a_socket(spark, endpoint, tmp_path):
    url, _, seen = endpoint
    config = V.VerifierConfig(model="m", top_k=None, concurrency=3)
    p = spark.createDataFrame([(str(i), "s", f"prompt {i}") for i in range(12)], "sample_id string, system string, prompt string")
    r = V.verify(p, V.chat_clients(url, config, "k"), config, journal=str(tmp_path / "log"))
    for _ in range(3):  # evaluated again and again, called once
        assert {(x["verdict"], x["confidence"], x["prompt_tokens"]) for x in r.collect()} == {("benign", 0.7, 3)}
    assert len(seen) == 12


def test_what_was_answered_is_not_asked_again(spark, tmp_path):
    calls, journal = str(tmp_path / "calls"), f"file:{tmp_path}/journal"
    fatal = str(tmp_path / "fatal")
    open(fatal, "w").close()

    def client():
        def call(messages):
            text = messages[-1]["content"]
            if text == "prompt 7" and os.path.exists(fatal):
                os._exit(1)  # the worker dies with its task
            with open(calls, "a") as f:
                f.write(text + "\n")
            return '{"verdict": "vulnerable", "confidence": 1}', 5, 2

        return call

    p = spark.createDataFrame([(str(i), "s", f"prompt {i}") for i in range(10)], "sample_id string, system string, prompt string").coalesce(1)
    config = V.VerifierConfig(model="m", top_k=None, concurrency=1)
    with pytest.raises(Exception, match=r"."):
        V.verify(p, client, config, journal).collect()
    with open(calls) as f:
        before = f.read().split("\n")[:-1]
    assert 0 < len(before) < 10
    os.remove(fatal)
    assert {r["verdict"] for r in V.verify(p, client, config, journal).collect()} == {"vulnerable"}
    with open(calls) as f:
        assert sorted(f.read().split("\n")[:-1]) == sorted(f"prompt {i}" for i in range(10))  # each once, those of the dead task as well
    V.verify(p, client, V.VerifierConfig(model="other", top_k=None), journal).collect()
    with open(calls) as f:
        assert len(f.read().split("\n")) == 21  # another model is another question
