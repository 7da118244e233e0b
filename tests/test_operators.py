import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators import aggregates, context, joins, logs, recommend, render, select, store

SCHEMA = "id string, title string, abstract string, score double, status int, created_at timestamp, recommend_date date, recommendation_type string, batch_order int, pushed_at timestamp, translated_title string, translated_abstract string"


def articles(spark, scores, status=0):
    rows = [(f"a{i:02d}", f"t{i}", None, float(s), status, None, None, None, None, None, None, None) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(
    ("count", "ratio", "want"),
    [(5, 0.0, (5, 0)), (10, 2.5, (7, 3)), (10, -1, (10, 0)), (10, 0.9, (0, 10)), (10, 0.5, (5, 5))],
)
def test_slots(count, ratio, want):
    assert recommend.slots(count, ratio) == want


def test_hybrid_topk(spark):
    own = articles(spark, [1 - i / 20 for i in range(20)])
    got = recommend.hybrid_topk(own, 10, 0.3, "s").orderBy("batch_order").collect()
    assert [r.batch_order for r in got] == list(range(10))
    assert [r.id for r in got[:7]] == [f"a{i:02d}" for i in range(7)]
    assert [r.recommendation_type for r in got] == ["score"] * 7 + ["random"] * 3
    again = recommend.hybrid_topk(own, 10, 0.3, "s").orderBy("batch_order").collect()
    assert got == again
    other = {r.id for r in recommend.hybrid_topk(own, 10, 0.3, "t").collect()}
    assert len(other) == 10
    assert recommend.hybrid_topk(articles(spark, [1, 0.5, 0]), 10, 0.3, "s").count() == 3
    assert recommend.hybrid_topk(articles(spark, [1, 0.5], status=3), 10, 0.3, "s").count() == 0


def test_marking_a_date_again_replaces_its_picks(spark):
    day = F.lit("2024-02-05").cast("date")
    once = recommend.mark_daily(articles(spark, range(20)), day, 5, 0.0, "s")
    twice = recommend.mark_daily(once, day, 3, 0.0, "s")
    assert once.where("recommend_date is not null").count() == 5
    assert {r.id for r in twice.where("recommend_date is not null").collect()} == {"a17", "a18", "a19"}


def test_backlog_order(spark):
    rows = [("a1", "2024-01-01", 1, None), ("a2", "2024-01-02", 0, None), ("a3", None, None, None), ("a4", "2024-01-02", 1, None), ("a5", "2024-01-02", 1, None), ("a6", "2024-01-01", 0, "2024-01-01"), ("a7", "2024-01-01", 0, None)]
    own = spark.createDataFrame(rows, "id string, recommend_date string, batch_order int, pushed_at string")
    assert [r.id for r in select.backlog(own, 10).collect()] == ["a7", "a1", "a2", "a4", "a5"]


def test_upserts(spark):
    table = spark.createDataFrame([("1", "old", 5), ("2", "keep", 6)], "id string, title string, rating int")
    new = spark.createDataFrame([("1", "x", 1), ("1", "y", 2), ("3", "z", 1)], "id string, title string, v int")
    after, inserted = store.insert_ignore(table, new, "id", [F.col("v")])
    assert sorted(tuple(r) for r in after.collect()) == [("1", "old", 5), ("2", "keep", 6), ("3", "z", None)]
    assert inserted.count() == 1
    replaced = store.replace_rows(table, new, "id", [F.col("v")])
    assert sorted(tuple(r) for r in replaced.collect()) == [("1", "y", None), ("2", "keep", 6), ("3", "z", None)]
    columns = store.upsert_columns(table, new, "id", ["title"], [F.col("v")])
    assert sorted(tuple(r) for r in columns.collect()) == [("1", "y", 5), ("2", "keep", 6), ("3", "z", None)]
    with pytest.raises(ValueError, match="at most"):
        store.mark_pushed(table, ["x"] * 901, F.current_timestamp())


def test_ratings(spark):
    papers = spark.createDataFrame([("1", "A", 0, False), ("2", "B", 3, True)], "id string, title string, rating int, pinned boolean")
    asked = spark.createDataFrame([("1", None, 11, None), ("2", " C ", 10, True)], "id string, title string, rating int, pin boolean")
    after, rejected = store.rated(papers, asked, [])
    assert sorted(tuple(r) for r in after.collect()) == [("1", "A", 0, False), ("2", "C", 10, False)]
    assert [r.id for r in rejected.collect()] == ["1"]


def test_keyword_filter(spark):
    rows = [("1", "Federated Learning", None), ("2", "other", "on federated learning"), ("3", "x", None), ("4", None, None)]
    own = spark.createDataFrame(rows, "id string, title string, abstract string")
    assert {r.id for r in select.without_keywords(own, [" federated learning ", ""]).collect()} == {"3", "4"}
    words = spark.createDataFrame([("X",), ("",)], "keyword string")
    assert {r.id for r in select.without_keyword_table(own, words).collect()} == {"1", "2", "4"}
    assert select.without_keywords(own, [" "]).count() == 4


def test_pages_and_scrolling(spark):
    rows = spark.range(20)
    ids = lambda n, clamp=True: [r.id for r in select.page(rows, [F.col("id")], n, 8, clamp).collect()]
    assert ids(2) == ids(9) == [16, 17, 18, 19]
    assert ids(9, clamp=False) == ids(0) == list(range(8))
    assert select.page_limits(500, -1) == (50, 0)
    assert select.scrolled(rows, [F.col("id")], 0, 20)[1] is False
    assert select.scrolled(rows, [F.col("id")], 0, 19)[1] is True


def naive_context(log):
    """Walk backwards; from each assistant row that counts, take its run of the same round."""
    keep, i = set(), len(log) - 1
    while i >= 0:
        _, rnd, role, skip = log[i]
        if role == "assistant" and not skip:
            j = i
            while j >= 0 and log[j][1] == rnd:
                keep.add(j)
                j -= 1
            i = j
        else:
            i -= 1
    return keep


def test_context_equals_a_backward_walk(spark):
    r = random.Random(0)
    logs_ = {p: [(i, r.randrange(3), r.choice(["user", "assistant", "tool"]), r.random() < 0.3) for i in range(r.randrange(1, 14))] for p in range(200)}
    rows = [(p, *m) for p, log in logs_.items() for m in log]
    own = spark.createDataFrame(rows, "paper int, seq int, round int, role string, skip_context boolean")
    got = {(x.paper, x.seq) for x in context.context_messages(own).collect()}
    assert got == {(p, i) for p, log in logs_.items() for i in naive_context(log)}


def test_anchor(spark):
    rounds = spark.createDataFrame([(1, 9, 30_000, 0), (1, 10, 30_000, 20_000), (1, 11, 1, 1)], "paper int, round int, prompt int, completion int")
    got = {r.round: r.anchor for r in context.anchors(rounds, 30_000, 3).collect()}
    assert got == {9: 0, 10: 8, 11: 8}


def test_tool_results_and_answer_order(spark):
    calls = [("c1", "function", ("search", "{}"))]
    rows = [(1, 0, "assistant", "", calls, None), (1, 1, "tool", "found", None, "c1")]
    own = spark.createDataFrame(rows, "paper int, seq int, role string, content string, tool_calls array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>, tool_call_id string")
    assert [tuple(r) for r in joins.tool_results(own).collect()] == [(1, "c1", "search", "{}", "found")]


def test_batches_number_rows_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id")).repartition(7)
    got = recommend.in_batches(rows, 30, F.col("id")).collect()
    assert sorted((r.id, r.pos, r.batch) for r in got) == [(i, i, i // 30) for i in range(1000)]


def test_cards_and_pages(spark):
    own = articles(spark, range(20)).withColumn("recommend_date", F.lit("2024-02-05").cast("date")).withColumn("batch_order", F.substring("id", 2, 2).cast("int"))
    pages = {r.page: r.ids for r in recommend.cards(own).collect()}
    assert pages[3] == "a16,a17,a18,a19"
    assert recommend.page_of(own, "a08").first().page == 2
    assert recommend.page_of(own, "none").first().page == 1


def test_rendering(spark):
    template = "{{.Title}}{{- if .Tag}} [{{.Tag}}{{if .X}}!{{else}}?{{end}}]{{end}}."
    assert render.rendered(template, {"Title": "T", "Tag": "g"}) == "T [g?]."
    assert render.rendered(template, {"Title": "T"}) == "T."
    rows = spark.createDataFrame([("T", None, "1")], "Title string, Tag string, X string")
    assert render.templated(rows, template).first().body == "T."
    papers = spark.createDataFrame([("r", 'A "b"/c', "u", "sum")], "ref string, title string, source_url string, initial_summary string")
    talk = spark.createDataFrame([("r", 0, 0, "user", "doc"), ("r", 1, 1, "user", "q"), ("r", 2, 1, "tool", "t"), ("r", 3, 1, "assistant", "a")], "paper string, seq int, round int, role string, content string")
    out = render.exported(papers, talk).first()
    assert out.file == 'A _b__c.md'
    assert out.body == '---\ntitle: "A \\"b\\"/c"\nsource: "u"\n---\n\n## Summary\n\nsum\n\n## Q: q\n\n## A\n\na'
    assert render.sse(spark.range(1)).first().event == 'data: {"id":0}\n\n'
    parts = render.overflow(spark.createDataFrame([("x" * 50,)], "t string"), "t", F.lit("> "), 20).orderBy("part").collect()
    assert [len(p.chunk) for p in parts] == [22, 20, 10]


def test_logs(spark, tmp_path):
    names = spark.createDataFrame([("app-2024-01-01.log",), ("app-2024-01-25.log",), ("other.log",), ("app-2024-99-99.log",)], "name string")
    kept = {r.name for r in logs.kept_days(names, F.lit("2024-01-31").cast("date"), 7).collect()}
    assert kept == {"app-2024-01-25.log", "other.log", "app-2024-99-99.log"}
    lines = spark.createDataFrame([(i, f"2024-01-01 23:{i:02d}:00", str(i)) for i in range(5)], "id int, ts string, line string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.id for r in logs.recent(lines, 2).collect()] == [3, 4]
    logs.write_daily(lines.select("ts", "line"), str(tmp_path / "log"), "Asia/Shanghai")
    assert str(spark.read.parquet(str(tmp_path / "log")).first().day) == "2024-01-02"


def test_repeated_keys_of_a_side_do_not_repeat_rows(spark):
    table = spark.createDataFrame([("1", 0.0, None, None), ("2", 0.5, None, None)], "id string, score double, hf_upvotes int, ax_net_votes int")
    scores = spark.createDataFrame([("1", 0.3, 1), ("1", 0.2, 2), ("9", 1.0, 1)], "id string, score double, at int")
    assert sorted((r.id, r.score) for r in store.update_scores(table, scores, []).collect()) == [("1", 0.3), ("2", 0.5)]
    assert sorted((r.id, r.score) for r in store.update_scores(table, scores, [F.col("at")]).collect()) == [("1", 0.2), ("2", 0.5)]
    votes = spark.createDataFrame([("1", 3, 4, 2), ("1", 3, 5, 1)], "id string, hf_upvotes int, ax_net_votes int, at int")
    assert store.update_matched(table, votes, ["hf_upvotes", "ax_net_votes"], [F.col("at")]).where("id = '1'").collect()[0][2:] == (3, 4)


def test_requests_are_done_in_their_order(spark):
    papers = spark.createDataFrame([("1", "T", 1, False), ("2", "U", 2, True), ("3", "V", 3, True)], "id string, title string, rating int, pinned boolean")
    asked = [(4, "1", None, None, True), (1, "1", "Z", 9, None), (2, "1", "A", None, True), (3, "1", " ", 8, True), (5, "1", None, 7, None), (6, "2", None, 0, True), (7, "2", None, None, True), (8, "9", None, 5, True)]
    requests = spark.createDataFrame(asked, "at int, id string, title string, rating int, pin boolean")
    after, rejected = store.rated(papers, requests, [F.col("at")])
    assert sorted(tuple(r) for r in after.collect()) == [("1", "A", 7, False), ("2", "U", 2, False), ("3", "V", 3, True)]
    assert sorted(r["at"] for r in rejected.collect()) == [3, 6]


def test_the_last_value_of_a_source_counts(spark):
    papers = spark.createDataFrame([("p", "1"), ("q", "2")], "id string, arxiv_id string")
    side = spark.createDataFrame([("1", "b", 1), ("1", "a", 2), ("1", None, 3)], "arxiv_id string, abstract string, at int")
    assert sorted(tuple(r) for r in joins.with_abstracts(papers, side, [F.col("at")]).select("id", "abstract").collect()) == [("p", "a"), ("q", "")]
    one = spark.createDataFrame([("1", 9, 1), ("1", 3, 2)], "arxiv_id string, v int, at int")
    two = spark.createDataFrame([("1", 5, 1), ("2", 4, 1)], "arxiv_id string, v int, at int")
    got = joins.first_answer(papers, "arxiv_id", [("one", one), ("two", two)], "v", [F.col("at")]).collect()
    assert sorted(tuple(r) for r in got) == [("1", 3, "one"), ("2", 4, "two")]


def test_batches_of_wide_rows_keep_all_rows(spark):
    rows = spark.range(3000).select(F.col("id").cast("string"), (F.col("id") % 7).alias("created_at"), F.repeat(F.lit("x"), 500).alias("abstract"), F.lit("t").alias("title"))
    got = recommend.in_batches(rows.repartition(9), 10, F.desc("created_at"), F.col("id")).select("pos", "batch", "id", "created_at", "abstract").collect()
    assert sorted(r.pos for r in got) == list(range(3000)) and all(r.batch == r.pos // 10 for r in got)
    by = sorted(got, key=lambda r: r.pos)
    assert [(r.created_at, r.id) for r in by] == sorted(((r.created_at, r.id) for r in got), key=lambda x: (-x[0], x[1]))


def test_main_file_is_a_common_name_then_the_longest(spark):
    head = r"\documentclass{x}\begin{document}"
    files = [("a", "z.tex", head + "long long", 1), ("a", "paper.tex", head, 2), ("b", "x.tex", head, 1), ("b", "y.tex", head + "12", 2), ("b", "notes.tex", "n" * 99, 3), ("c", "n.tex", "none", 1)]
    got = aggregates.main_file(spark.createDataFrame(files, "archive string, path string, content string, walk int"))
    assert {r.archive: r.path for r in got.collect()} == {"a": "paper.tex", "b": "y.tex"}


def test_template_variables_without_a_dot():
    assert render.rendered("# {{Title}}{{if Tag}} [{{Tag}}]{{end}}", {"Title": "T"}) == "# T"


def test_keyword_table_equals_the_list_at_any_length_and_size(spark):
    rows = [("1", "Deep Learning", "on graphs"), ("2", None, "ABC"), ("3", "x", None), ("4", None, None), ("5", "graph", "s on"), ("1", "other", "text"), (None, "graphs", ""), ("1", "Deep Learning", "on graphs")]
    own = spark.createDataFrame(rows, "id string, title string, abstract string")
    for words in (["graphs"], ["x"], ["bc", " "], ["ab", "ing o"], ["graphs on", "GRAPH"], [], ["zzz"], ["deep learning on"]):
        table = spark.createDataFrame([(w,) for w in words], "keyword string")
        got = sorted(map(str, select.without_keyword_table(own, table).collect()))
        assert got == sorted(map(str, select.without_keywords(own, words).collect()))
    assert select.without_keyword_table(own.limit(0), table).collect() == []


def test_keyword_table_of_a_hundred_thousand(spark):
    from feedloom.plans.fixtures import articles

    at = "/root/testdata/sf0.001"
    own = articles(spark, at)
    words = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.explode(F.split("text", r"[\\n.,]+")).alias("keyword")).where("length(trim(keyword)) > 25").distinct().limit(100_000)
    assert words.count() > 80_000
    gone = select.without_keyword_table(own, words)
    kept = {r.id for r in gone.select("id").collect()}
    texts = {r.id: [(x or "").lower() for x in (r.title, r.abstract)] for r in own.collect()}
    lines = [r.keyword.strip().lower() for r in words.collect()]
    some = set(lines[:2000])
    hit = {i for i, t in texts.items() if any(w in x for x in t for w in some)}
    assert kept.isdisjoint(hit)
    part = select.without_keyword_table(own, spark.createDataFrame([(w,) for w in some], "keyword string"))
    assert {r.id for r in part.select("id").collect()} == set(texts) - hit


def test_old_days_go_and_others_are_not_read(spark, tmp_path):
    path = str(tmp_path / "log")
    days = [f"2024-01-{d:02d}" for d in range(20, 29)]
    lines = spark.createDataFrame([(f"{d} 10:00:00", d) for d in days] + [(None, "no day")], "ts string, line string").withColumn("ts", F.col("ts").cast("timestamp"))
    logs.write_daily(lines, path)
    assert logs.without_old_days(spark, path, "2024-01-28", 5) == days[:3]
    left = spark.read.parquet(path)
    assert {r.line for r in left.collect()} == {*days[3:], "no day"}
    kept = logs.kept_lines(left, F.lit("2024-01-28").cast("date"), 2)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert {r.line for r in kept.collect()} == set(days[-3:])
    assert logs.without_old_days(spark, path, "2024-01-28", 5) == []


def test_keyword_table_moves_no_row(spark):
    own = spark.createDataFrame([("1", "Deep Learning", "on graphs"), ("2", None, "ABC")], "id string, title string, abstract string")
    words = spark.createDataFrame([("deep learning",), ("abc",), ("none of these",)], "keyword string")
    left = select.without_keyword_table(own, words)
    assert left.collect() == []
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()


def test_keyword_table_in_parts_equals_the_list(spark, monkeypatch):
    rows = [(str(i), f"title {i} of many", f"an abstract that says {i * 7} things") for i in range(60)]
    own = spark.createDataFrame(rows, "id string, title string, abstract string")
    words = [f"title {i} of" for i in range(0, 60, 7)] + ["says 21 things", "says 28", "x"]
    monkeypatch.setattr(select, "_KEYWORD_BYTES", 30)
    got = select.without_keyword_table(own, spark.createDataFrame([(w,) for w in words], "keyword string"))
    assert sorted(got.collect()) == sorted(select.without_keywords(own, words).collect()) != []


@pytest.mark.parametrize("step", [7, 1 << 19])
def test_keywords_occur_as_python_says(monkeypatch, step):
    import pyarrow as pa

    from feedloom.functions import keywords

    monkeypatch.setattr(keywords, "_STEP", step)
    rng = random.Random(step)
    for letters in ("ab", "aé ", "abcdefgh漢"):
        make = lambda n, letters=letters: "".join(rng.choice(letters) for _ in range(n))
        texts = [make(rng.choice([0, 1, 5, 9, 30, 200])) for _ in range(200)] + [None, "", "\0\0\0"]
        words = [make(rng.randint(1, 40)) for _ in range(30) if letters != "ab"] + [make(n) for n in (7, 8, 9, 12, 16, 17, 25)] + ["a" * 8 + "\0"]
        for some in (words, words[-6:], [w for w in words if len(w) > 9], words[:1], []):
            column = pa.array([None, *texts], pa.string())[1:]
            got = keywords.Keywords(some).occur(column)
            assert got.tolist() == [any(w in (t or "") for w in some) for t in texts]


def test_clearing_deletes_every_stored_article(spark, monkeypatch):
    from feedloom.plans import catalog
    from feedloom.plans.fixtures import articles

    at, seen, clear = "/root/testdata/sf0.001", [], store.cleared

    def watched(spark, path, schema):
        seen.append((path, spark.read.parquet(path).count()))
        return clear(spark, path, schema)

    monkeypatch.setattr(store, "cleared", watched)
    assert catalog.QUERIES["k9_clear_all"](spark, at).collect() == []
    ((path, stored),) = seen
    assert stored == articles(spark, at).count() > 0
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == articles(spark, at).columns
