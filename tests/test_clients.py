import io
import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from threading import Thread
from urllib import error

import pytest
from pyspark.sql import functions as F

from tempora import cli, schemas
from tempora.plans import model_review
from tempora.sources import clients
from tests.records import entity, event, frame, person, relation


def opener(*replies):
    todo = list(replies)

    def open_(call, timeout):
        reply = todo.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return io.BytesIO(json.dumps(reply).encode())

    return open_


def http(code, **headers):
    return error.HTTPError("u", code, "why", headers, None)


def test_nominatim():
    slept = []
    ask = lambda *replies: clients.Nominatim("a", pause=0, retries=1, opener=opener(*replies), sleep=slept.append).one("Rome")
    assert ask([{"lat": "41.9", "lon": "12.5", "importance": 0.8, "addresstype": "city"}])["latitude"] == 41.9
    assert ask([])["notes"] == "No Nominatim result."
    assert ask(http(429, **{"Retry-After": "7"}), http(429))["notes"] == "Nominatim rate limit exceeded after retries." and 7.0 in slept
    assert ask(http(500))["notes"] == "Nominatim HTTP error 500: why"
    assert ask(error.URLError("x"), [{"lat": 1, "lon": 2}])["source"] == "nominatim"


def test_chat_and_memory():
    asked = []

    def post(url, payload, headers=None, timeout=0):
        asked.append(payload)
        return {"message": {"content": "hi"}}

    client = clients.Remembered(clients.LocalChat("http://x/", post=post), {})
    for _ in range(2):
        assert client.chat(model="m", messages=[], response_format={"type": "object"}, options={})["message"]["content"] == "hi"
    assert len(asked) == 1 and asked[0]["stream"] is False
    with pytest.raises(RuntimeError):
        clients.LocalChat(post=lambda *a, **k: {}).chat(model="m", messages=[])
    assert clients.response_text({"output": [{"content": [{"text": "a"}, {"text": "b"}]}]}) == "ab" and clients.model_name("p/m") == "m"


def test_model_review(spark):
    packets = spark.createDataFrame([(0, "a", "t"), (1, "b", "t")], "rec_ord long, article_id string, text string").withColumn("draft", F.struct("article_id"))
    done = spark.createDataFrame([("a",)], "article_id string")
    out = model_review.review(packets, lambda: lambda packet: {"entities": []}, done).collect()
    assert [(r["article_id"], r["status"], json.loads(r["record"])["annotation_status"]) for r in out] == [("b", "ok", "model_reviewed")]


def test_commands(spark, tmp_path, capsys):
    e = event("AttackEvent", participants=[person("Iran", "NationState", "target"), person("US", "NationState", "initiator")], relations=[relation("US", "Iran", "ATTACKED")])
    record = {"article_id": "a1", "title": "T", "url": "u", "published_at": "2026-04-10", "annotation_status": "gold", "entities": [entity("US", "NationState"), entity("Iran", "NationState")], "relations": [], "events": [e]}
    path = tmp_path / "x.jsonl"
    path.write_text(json.dumps(record) + "\n")
    p = str(path)
    out = lambda n: str(tmp_path / n)
    assert cli.main(["postprocess", "--extractions", p, "--output", out("post"), "--overrides", out("none.csv"), "--cache", out("none.json"), "--offline"], spark) == 0
    assert json.loads(capsys.readouterr().out)["cleaned_event_count"] == 1
    edges = [json.loads(x) for f in (tmp_path / "post/graph/edges").glob("part*") for x in f.read_text().splitlines()]
    assert [x["id"] for x in edges] == ["NationState:united-states|ATTACKED|NationState:iran"]
    assert cli.main(["score", "--gold", p, "--predictions", p, "--output", out("r.md"), "--log", out("log.md")], spark) == 0
    assert "1.000" in (tmp_path / "r.md").read_text() and (tmp_path / "log.md").read_text().count("\n") == 5
    assert cli.main(["candidates", "--predictions", p, "--output", out("cand")], spark) == 0
    assert cli.main(["finalize", "--reviewed", p, "--output", out("gold")], spark) == 0
    assert cli.main(["aggregate", "--records", out("post/article_extractions_clean"), "--output", out("graph"), "--node-link"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"node_count": 2, "edge_count": 1, "skipped_relations": 0, "event_count": 1}
    assert sorted(x.name for x in (tmp_path / "graph").iterdir()) == ["edges", "events", "metadata", "node_link", "nodes", "summary"]
    summary = json.loads(next((tmp_path / "graph/summary").glob("part*")).read_text())
    assert summary["event_type_counts"] == {"AttackEvent": 1}
    (tmp_path / "rev").mkdir()
    assert cli.main(["review", "--gold", p, "--predictions", p, "--output", out("rev")], spark) == 0 and (tmp_path / "rev/a1.md").exists()
    assert "| [a1](a1.md) | 1 | 1 | 1 | 0 | 0 |" in (tmp_path / "rev/index.md").read_text()
    assert frame(spark, [record], schemas.GOLD).count() == 1


@pytest.fixture
def service():
    """The url of a service on this machine that annotates packets."""

    class Annotates(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = self.rfile.read(int(self.headers["Content-Length"])).decode()
            reply = json.dumps({"output_text": json.dumps({"events": [], "seen": "Body." in asked and "US" in asked})}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(reply)))
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Annotates)
    Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()
    server.server_close()


def test_packets_and_their_review(spark, service, tmp_path, monkeypatch, capsys):
    draft = {"article_id": "a/1", "title": "T", "annotation_status": "needs_human_review", "entities": [entity("US", "NationState")], "relations": [], "events": [event()]}
    (tmp_path / "c.jsonl").write_text(json.dumps(draft) + "\n")
    (tmp_path / "a.jsonl").write_text(json.dumps({"article_id": "a/1", "title": "other", "url": "u", "text": "Body."}) + "\n")
    (tmp_path / "p").mkdir()
    assert cli.main(["packets", "--candidates", str(tmp_path / "c.jsonl"), "--articles", str(tmp_path / "a.jsonl"), "--output", str(tmp_path / "p")], spark) == 0
    shown = (tmp_path / "p/a-1.packet.md").read_text()
    assert shown.startswith("# T\n") and "Body." in shown and '"name": "US"' in shown
    monkeypatch.setenv("SOME_KEY", "k")
    command = ["model-review", "--packets", str(tmp_path / "p/packets"), "--output", str(tmp_path / "p"), "--url", service, "--model", "m", "--key-name", "SOME_KEY"]
    capsys.readouterr()
    assert cli.main(command, spark) == 0 and cli.main(command, spark) == 0  # the second finds it done
    assert capsys.readouterr().out.splitlines() == ['{"ok": 1}', "{}"]
    records = [json.loads(x) for f in (tmp_path / "p/records").glob("part*") for x in f.read_text().splitlines()]
    assert records == [{"events": [], "seen": True, "article_id": "a/1", "annotation_status": "model_reviewed"}] and (tmp_path / "p/a-1.review.md").exists()


def test_page_fetcher():
    slept = []
    fetch = clients.page_fetcher(5, opener=lambda call, timeout: io.BytesIO(b"x\xff"), sleep=slept.append)
    assert fetch("http://x/") == fetch("http://x/") == "x\ufffd" and slept[0] == 0 and 4 < slept[1] <= 5
