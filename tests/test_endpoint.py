"""The endpoint provider and the synthesise command against a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from corpusloom import cli
from corpusloom.operators import endpoint


class Server(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Server.asked.append((self.path, body))
        bad = "broken" in body["messages"][1]["content"]
        self.send_response(500 if bad else 200)
        self.end_headers()
        if not bad:
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "<think>x</think>An answer that is long enough to be kept as a sample."}}]}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture()
def url():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Server.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_chat(url):
    ask = endpoint.chat(url, "m", tokens=7)
    assert ask("s", "hello", 0.25).endswith("as a sample.")
    path, body = Server.asked[0]
    assert path == "/v1/chat/completions" and (body["model"], body["temperature"], body["max_tokens"]) == ("m", 0.25, 7)
    assert [x["role"] for x in body["messages"]] == ["system", "user"]
    with pytest.raises(Exception):
        ask("s", "broken", 0.1)


def test_synthesise_resumes(spark, url, tmp_path):
    rows = [{"id": str(i), "source": "s", "repo": "r", "file": "f", "lang": "c", "kind": "raw_code", "title": "t", "body": "", "code": [("broken " if i == 2 else "fine ") * 40]} for i in range(4)]
    (tmp_path / "chunks").mkdir()
    (tmp_path / "chunks" / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    args = ["synthesise", *(str(tmp_path / x) for x in ("chunks", "samples", "failures")), "--url", url, "--model-name", "m", "--tries", "1"]
    assert cli.main(args).split("\n") == ["Chunks pending : 4", "Samples        : 3", "Failures       : 1"]
    assert cli.main(args).split("\n") == ["Chunks pending : 1", "Samples        : 0", "Failures       : 1"]
    assert {r["source_chunk_id"] for r in spark.read.json(str(tmp_path / "samples")).collect()} == {"0", "1", "3"}


def test_query_has_no_server_of_its_own_on_the_driver(spark, monkeypatch):
    """Every worker answers its own calls; a server on the driver would be made in this process."""
    import http.server

    from corpusloom.plans import source_catalogue

    def none(*_):
        raise AssertionError("a server on the driver")

    monkeypatch.setattr(http.server, "ThreadingHTTPServer", none)
    rows = source_catalogue.endpoint_answers(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 100 and {r["error"] for r in rows} == {"", "HTTP Error 500: Internal Server Error"}
    assert sum(r["error"] == "" for r in rows) > 100
