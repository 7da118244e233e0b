import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from feedloom.operators.recommend import scoring_prompts
from feedloom.functions.json import exploded_scores
from feedloom.schema import ARTICLE, conformed, evolved
from feedloom.sources import archives, feeds, models, pages, papers, params


def item(i, announce="new", link=True):
    shown = f"<link>https://arxiv.org/abs/2401.0000{i}v1</link>" if link else "<link>x</link>"
    return f"<item><title>T&amp;amp; {i}</title>{shown}<description>arXiv:2401.0000{i} Announce Type: {announce}\nAbstract: About {i}</description><dc:creator>A, B</dc:creator></item>"


def test_feed_files(spark, tmp_path):
    kinds = ["new", "cross", "replace", "new"]
    body = "".join(item(i, k) for i, k in enumerate(kinds)) + item(9, link=False)
    (tmp_path / "f.xml").write_text(f'<rss xmlns:dc="x"><channel>{body}</channel></rss>')
    rows = feeds.parsed(feeds.read_feed(spark, str(tmp_path)), "cs.AI").orderBy("id").collect()
    assert [r.id for r in rows] == ["2401.00000", "2401.00001", "2401.00003"]
    assert (rows[0].title, rows[0].abstract, rows[0].author, rows[0].announce) == ("T& 0", "About 0", "A, B", "new")


def test_feed_texts_caps_first_wins_and_stored(spark):
    texts = lambda *n: spark.createDataFrame([("".join(item(i) for i in n),)], "body string")
    a = feeds.parsed(feeds.items_of_texts(texts(1, 2, 3)), "a")
    b = feeds.parsed(feeds.items_of_texts(texts(3, 4)), "b")
    stored = spark.createDataFrame([("2401.00004",)], "id string")
    got = {r.id: r.category for r in feeds.fetched([a, b], stored, most=2).collect()}
    assert got == {"2401.00001": "a", "2401.00002": "a", "2401.00003": "b"}


def test_json_papers(spark, tmp_path):
    talk = [{"round_number": 0, "role": "user", "content": "doc"}, {"round_number": 0, "role": "assistant", "content": "sum"}, {"round_number": 1, "role": "user", "content": "q", "skip_context": True}]
    (tmp_path / "a.json").write_text(json.dumps({"session_id": "s1", "title": "A", "source_url": "https://arxiv.org/abs/2401.00001v2", "updated_at": "2024-01-02T03:04:05Z", "messages": talk}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"id": 7, "title": " ", "pinned": True, "messages": []}))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text(json.dumps({"session_id": "s1", "title": "again"}))
    read = papers.read_papers(spark, str(tmp_path))
    rows = papers.listed(read).collect()
    assert [(r.ref, r.title, r.pinned) for r in rows] == [("7", "Untitled", True), ("s1", "A", False)]
    one = read.where("file = 'a.json'").first()
    assert (one.arxiv_id, one.content, one.initial_summary) == ("2401.00001v2", "doc", "sum")
    assert [(r.seq, r.round, r.skip_context) for r in papers.messages_of(read.where("file = 'a.json'")).orderBy("seq").collect()] == [(0, 0, False), (1, 0, False), (2, 1, True)]
    chat = papers.as_chat_papers(read).collect()
    assert [(r.id, r.updated_at) for r in chat] == [("s1", "2024-01-02 03:04")]
    papers.write_papers(read.where("file = 'a.json'"), str(tmp_path / "out"))
    again = papers.upgraded(spark.read.schema(papers.PAPER).json(str(tmp_path / "out"))).first()
    assert again.content == "doc"


def tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


def test_archives(spark, tmp_path):
    files = {"a/long.tex": "x" * 500, "a/main.tex": "\\documentclass{x}\\begin{document}\\input{sub/one} \\include{two}\\end{document}", "a/sub/one.tex": "ONE \\input{main}", "a/two.tex": "TWO", "../evil.tex": "no"}
    (tmp_path / "1.tar.gz").write_bytes(gzip.compress(tar(files)))
    (tmp_path / "2.gz").write_bytes(gzip.compress(b"plain \\TeX"))
    (tmp_path / "3.tar").write_bytes(tar({"r.txt": "none"}))
    got = {r.path[-8:]: r.tex for r in archives.read_archives(spark, str(tmp_path)).collect()}
    one = next(t for p, t in got.items() if p.endswith("1.tar.gz"[-8:]))
    assert "ONE" in one
    assert "TWO" in one
    assert "evil" not in one
    assert sorted(map(str, got.values()))[1:] == ["plain \\TeX"] or "plain \\TeX" in got.values()
    assert None in got.values()


def test_pages(spark):
    html = '<html><title>[2401.1]  A &amp; B</title><meta name="citation_abstract" content="M &lt;x"><blockquote class="abstract mathjax">Abstract: Q</blockquote>'
    row = spark.createDataFrame([(html,)], "h string").select(pages.page_title(F.col("h")).alias("t"), pages.page_abstract(F.col("h")).alias("a")).first()
    assert (row.t, row.a) == ("A & B", "M <x")
    rows = spark.createDataFrame([("x" * 1000, 200, "text/html; x"), ("x" * 1000, 302, "text/html"), ("x", 200, "text/html")], "html string, http_status int, content_type string")
    assert pages.usable_pages(rows).count() == 1
    pick = spark.createDataFrame([("", "tex", "e1", ""), ("", "", "e1", "e2")], "a string, b string, c string, d string").select(pages.first_success(*map(F.col, "abcd")).alias("x")).collect()
    assert [tuple(r.x) for r in pick] == [("tex", None), (None, "e1; e2")]


def test_models(spark):
    rows = spark.createDataFrame([(str(i), f"t{i}", None) for i in range(25)], "id string, title string, abstract string").withColumn("created_at", F.col("id").cast("int"))
    prompts = scoring_prompts(rows, "likes x", size=10)
    assert prompts.count() == 3
    scores = exploded_scores(models.replied(prompts, models.stub_scorer)).collect()
    assert {r.id for r in scores} == {str(i) for i in range(25)}
    assert all(-1 <= r.score <= 1 for r in scores)

    def failing(prompt):
        raise OSError("timeout")

    assert models.replied(prompts, failing).count() == 0
    texts = spark.createDataFrame([("1", "a", "b"), ("2", "", None)], "id string, title string, abstract string")
    assert [tuple(r) for r in models.translations(texts, models.stub_translator).collect()] == [("1", "A", "B")]


def test_parameters_and_state(tmp_path, monkeypatch):
    monkeypatch.setenv("CAT", "10:00")
    p = params.parameters({"enabled": False, "daily_papers": None, "scheduled_time": "${CAT}"})
    assert (p.enabled, p.daily_papers, p.scheduled_time) == (False, 20, "10:00")
    with pytest.raises(ValueError, match="unknown"):
        params.parameters({"nope": 1})
    at = str(tmp_path / "state")
    assert params.read_state(at) == ""
    params.write_state(at, "x")
    assert params.read_state(at) == "x"


def test_schema_evolution(spark):
    old = spark.createDataFrame([("1", "T", "旧", None)], "id string, title string, title_cn string, translated_title string")
    new = evolved(old, version=1)
    assert new.first().translated_title == "旧"
    assert conformed(new, ARTICLE).columns == ARTICLE.names
