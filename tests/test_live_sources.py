import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from feedloom.plans import flows
from feedloom.schema import ARTICLE
from feedloom.sources import feeds, fetch, replies
from feedloom.streaming import engine

AT = "/root/testdata/sf0.001"


@pytest.fixture
def server():
    """A local stub: ``server.answers`` maps a path to a function of the query and the number of the request."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlparse(self.path)
            stub.asked.append(at.path)
            status, body = stub.answers[at.path]({k: v[0] for k, v in parse_qs(at.query).items()}, stub.asked.count(at.path))
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    stub = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    stub.answers, stub.asked = {}, []
    stub.url = f"http://127.0.0.1:{stub.server_port}"
    threading.Thread(target=stub.serve_forever, daemon=True).start()
    yield stub
    stub.shutdown()


def feed(ids, kind="new"):
    item = "<item><title>T {0}</title><link>https://arxiv.org/abs/{0}</link><description>arXiv:{0}v1 Announce Type: {1} \nAbstract: About {0} &amp; more</description></item>"
    return "<rss><channel>" + "".join(item.format(i, kind) for i in ids) + "</channel></rss>"


def test_feeds_are_tried_again_and_equal_the_file_source(spark, server, tmp_path):
    ids = {"cs.AI": [f"2401.0000{i}" for i in range(5)], "cs.LG": ["2401.00003", "2401.00009", "2401.00010"]}
    body = {c: feed(ids[c]) for c in ids}
    server.answers["/cs.ai"] = lambda q, k: (500, "") if k == 1 else (200, "<rss><item>") if k == 2 else (200, body["cs.AI"])  # down, then cut off
    server.answers["/cs.lg"] = lambda q, k: (200, body["cs.LG"])
    fetch.register(spark)
    stored = spark.createDataFrame([("2401.00001",)], "id string")
    got = fetch.fetched_feeds(spark, list(ids), stored, most=4, url=server.url + "/{category}", back_off="0.01").orderBy("id").collect()
    assert server.asked.count("/cs.ai") == 3
    assert server.asked.count("/cs.lg") == 1
    assert [(r.id, r.category) for r in got] == [("2401.00000", "cs.AI"), ("2401.00002", "cs.AI"), ("2401.00003", "cs.AI"), ("2401.00009", "cs.LG"), ("2401.00010", "cs.LG")]
    frames = []
    for c in ids:
        items = feeds.items_of_texts(spark.createDataFrame([(body[c],)], "body string"))
        frames.append(feeds.parsed(items, c))
    assert got == feeds.fetched(frames, stored, 4).select(*got[0].__fields__).orderBy("id").collect()


def test_a_feed_that_never_answers_fails_the_job(spark, server):
    server.answers["/a"] = lambda q, k: (503, "")
    fetch.register(spark)
    with pytest.raises(Exception, match="fetch category A: after 2 retries"):
        spark.read.format("feeds").option("categories", "A").option("url", server.url + "/{category}").option("back_off", "0.01").load().collect()
    assert server.asked.count("/a") == 3


def test_feeds_of_a_file_and_no_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text(feed(["2401.00001"]))
    fetch.register(spark)
    stored = spark.createDataFrame([], ARTICLE)
    assert [r.id for r in fetch.fetched_feeds(spark, ["x", "y"], stored, file=str(tmp_path / "f.xml")).collect()] == ["2401.00001"]
    assert spark.read.format("feeds").load().collect() == []


def test_relayed_lines_come_in_several_batches_and_once(spark, server, tmp_path):
    lines = flows.reply_lines(spark, AT).orderBy("seq", "reply").collect()
    log = [(r.reply, r.line) for r in lines]  # all replies at once, line by line
    third, shown = len(log) // 3, [0]
    server.answers["/end"] = lambda q, k: (200, str(shown[0]))
    server.answers["/lines"] = lambda q, k: (200, json.dumps([{"at": i, "reply": log[i][0], "line": log[i][1]} for i in range(int(q["from"]), int(q["to"]))]))
    replies.register(spark)

    def run(*ends):
        rows = spark.readStream.format("relay").option("url", server.url).option("lines_per_task", "40").load()
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            for shown[0] in ends:
                q.processAllAvailable()
        finally:
            q.stop()

    run(third, 2 * third)
    run(len(log))  # goes on where it stopped
    assert len([x for x in (tmp_path / "cp/commits").iterdir() if x.name.isdigit()]) >= 3
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.seq, r.reply, r.line) for r in got.collect()) == [(i, *x) for i, x in enumerate(log)]
    assert sorted(replies.completed(replies.parsed_chunks(got)).collect()) == sorted(flows.s13_streamed_replies(spark, AT).collect())
    assert sorted(replies.completed_calls(replies.parsed_chunks(got)).collect()) == sorted(flows.s13_streamed_calls(spark, AT).collect())


def test_chunks_without_usage_or_end_and_gaps_in_calls(spark):
    delta = lambda **d: "data: " + json.dumps({"choices": [{"delta": d}]})
    lines = [("a", delta(content="x")), ("a", "data: {bad"), ("a", "event: y"), ("a", delta(content=""))]
    lines += [("b", delta(content="not heard", tool_calls=[{"index": 2, "id": "i", "function": {"name": "n", "arguments": "{"}}, {"index": 0, "function": {"arguments": "z"}}]))]
    lines += [("b", delta(tool_calls=[{"index": 2, "id": "", "function": {"arguments": "}"}}])), ("b", "data: [DONE]"), ("b", delta(content="late")), ("c", "data: [DONE]")]
    chunks = replies.parsed_chunks(spark.createDataFrame([(r, i, x) for i, (r, x) in enumerate(lines)], "reply string, seq int, line string"))
    assert sorted(tuple(r) for r in replies.completed(chunks).collect()) == [("a", "x", False, 0, 0, 0, 0), ("b", "", True, 0, 0, 0, 0), ("c", "", True, 0, 0, 0, 0)]
    assert sorted((r["index"], r.id, r.name, r.arguments) for r in replies.completed_calls(chunks).collect()) == [(0, "", "", "z"), (2, "i", "n", "{}")]
    none = chunks.limit(0)
    assert replies.completed(none).collect() == replies.completed_calls(none).collect() == []


def test_replies_are_answers_of_the_engine(spark):
    delta = lambda **d: "data: " + json.dumps({"choices": [{"delta": d}]})
    usage = "data: " + json.dumps({"choices": [], "usage": {"prompt_tokens": 5, "completion_tokens": 6}})
    lines = [("p/1.1", delta(content="See: ")), ("p/1.1", delta(tool_calls=[{"index": 0, "id": "c", "type": "function", "function": {"name": "up", "arguments": "x"}}])), ("p/1.1", "data: [DONE]"), ("p/1.2", delta(content="fine")), ("p/1.2", usage), ("p/1.2", "data: [DONE]")]
    rows = spark.createDataFrame([(r, i, x) for i, (r, x) in enumerate(lines, 1)], "reply string, seq int, line string")
    asked = spark.createDataFrame([{"paper": "p", "at": 0, "kind": "question", "content": "q"}], engine.EVENT)
    log = engine.folded_log(asked.unionByName(replies.as_events(replies.parsed_chunks(rows))), {"up": str.upper}).orderBy("seq").collect()
    assert [(r.role, r.content, r.prompt_tokens, r.completion_tokens) for r in log] == [("user", "q", 0, 0), ("assistant", "", 0, 0), ("tool", "X", 0, 0), ("assistant", "See: fine", 5, 6)]
    assert log[3].seq == 3
    assert log[0].reply is None
