"""Requests from tasks to an endpoint of this machine, and the table of its replies."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tabulens.assist import advice
from tabulens.assist.providers import HttpProvider, Provider, ask_all
from tabulens.assist.replies import Replies
from tabulens.functions import lint
from tabulens.operators import health, resolve

DOWN = {"on": True}


class Endpoint(BaseHTTPRequestHandler):
    seen: list[dict] = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        text = body["messages"][-1]["content"]
        self.seen.append({"text": text, "key": self.headers.get("api-key"), "body": body})
        if "Fails" in text and DOWN["on"]:
            self.send_response(500)
            self.end_headers()
            return
        said = "no json" if "Odd" in text else json.dumps({"has_improvement": "Fine" not in text, "issue": "Slow", "severity": "High", "suggested_dax": "[M1] + 1", "issues": [{"type": "Size", "severity": "Low"}]})
        reply = json.dumps({"choices": [{"message": {"content": f"```json\n{said}\n```"}}]}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(reply)))
        self.end_headers()
        self.wfile.write(reply)

    def log_message(self, *args):
        pass


@pytest.fixture()
def provider():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Endpoint.seen.clear()
    DOWN["on"] = True
    yield HttpProvider(f"http://127.0.0.1:{server.server_port}/chat", {"api-key": "k"}, "m1", "Local", timeout=10)
    server.shutdown()


def model(spark, rows):
    found = spark.createDataFrame([(p, "Measure", "T", n, dax, i) for i, (p, n, dax) in enumerate(rows)], "project_id string, kind string, table_name string, name string, dax string, ord int")
    found = found.withColumn("issues", F.array().cast(f"array<{lint.ISSUE}>"))
    tables = found.select("project_id", "table_name").distinct().withColumn("ord", F.lit(0))
    columns = tables.withColumn("column_name", F.lit("C"))
    cat = resolve.catalog(tables, columns, found.withColumnRenamed("name", "measure_name"), columns.filter("false"))
    edges = spark.createDataFrame([], "project_id string, source_kind string, source_table string, source_name string, target_kind string, target_table string, target_name string, resolved boolean")
    return found, edges, cat


def test_a_rerun_sends_nothing_twice(spark, provider, tmp_path):
    rows = [("a", "M1", "1"), ("a", "M1", "1"), ("b", "M1", "1"), ("a", "Fails", "2"), ("a", "Odd", 'Password="p"'), ("b", "Fine", "4")]
    made = model(spark, rows)
    table = Replies(spark, f"file://{tmp_path}/replies")
    met, sent, failed = ask_all(provider, *made, table=table)
    got = [(r["project_id"], r["name"], r["reply"]["issue"], r["reply"]["severity"], r["reply"]["validation_status"]) for r in met.collect()]
    assert set(got) == {("a", "M1", "Slow", "High", "Validated"), ("b", "M1", "Slow", "High", "Validated")}
    assert (sent, failed, len(Endpoint.seen)) == (4, 1, 4)  # M1 of both projects is one request
    assert all(s["key"] == "k" and s["body"]["model"] == "m1" for s in Endpoint.seen) and not any('"p"' in s["text"] for s in Endpoint.seen)
    assert sorted(r["status"] for r in table.read().collect()) == ["answered", "failed", "silent", "silent"]
    DOWN["on"] = False
    met, sent, failed = ask_all(provider, *made, table=table)
    assert (sent, failed, len(Endpoint.seen)) == (1, 0, 5) and "Fails" in Endpoint.seen[-1]["text"]
    assert {(r["project_id"], r["name"]) for r in met.collect()} == {("a", "M1"), ("b", "M1"), ("a", "Fails")}
    assert ask_all(provider, *made, table=table)[1:] == (0, 0) and len(Endpoint.seen) == 5
    assert table.rows().count() == 5 and table.read().count() == 4


def test_budget_of_a_project_holds_over_tasks(spark, provider, tmp_path):
    found, edges, cat = model(spark, [(p, f"N{k}", str(k) + p) for k in range(40) for p in "ab"])
    table = Replies(spark, f"file://{tmp_path}/replies")
    _, sent, _ = ask_all(provider, found.repartition(7), edges, cat, most=15, table=table)
    assert sent == len(Endpoint.seen) == 30
    assert {s["text"].count("N39") for s in Endpoint.seen} == {0}


def test_table_and_driver_give_the_same(spark, provider, tmp_path):
    made = model(spark, [("a", "M1", "1"), ("b", "M2", "2"), ("b", "Odd", "3")])
    rows = lambda met: sorted(map(str, met.collect()))
    assert rows(ask_all(provider, *made, table=Replies(spark, f"file://{tmp_path}/replies"))[0]) == rows(ask_all(provider, *made)[0])


def test_advice_from_tasks(spark, provider, tmp_path):
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "project_id string, n long")
    models = health.health(counts.select("project_id", *[(F.col("n") if c == "tables" else F.lit(7).cast("long")).alias(c) for c in health.COUNTS]))
    table = Replies(spark, f"file://{tmp_path}/replies")
    for _ in range(2):
        got = advice.model_advice(provider, models, table).collect()
        assert sorted((r["project_id"], r["place"], r["type"], r["severity"]) for r in got) == [(p, 0, "Size", "Low") for p in "abc"]
        assert len(Endpoint.seen) == 2  # projects with the same counts share a request


def test_http_provider_gives_none_where_it_fails(provider):
    assert HttpProvider("http://127.0.0.1:9/none", {"api-key": "k"}, None, "Gone", timeout=1).chat([{"role": "user", "content": "x"}]) is None
    assert provider.chat([{"role": "user", "content": "Fails"}]) is None and provider.chat([{"role": "user", "content": "hi"}]).startswith("```json")
    assert isinstance(provider, Provider) and provider.is_available()
