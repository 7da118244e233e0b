"""Every query of the store's operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.functions import calendar, fit, html, ids, json, text
from feedloom.functions.state import merged_status, merged_status_bulk
from feedloom.operators import aggregates, context, joins, recommend, select, store
from feedloom.plans.fixtures import articles, chat_papers, messages, table, with_articles, with_both, with_messages, with_papers
from feedloom.sources import pages
from feedloom.streaming import status, windows
from feedloom.tables import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}



def _as_of():
    return F.lit("2024-01-31 12:00:00").cast("timestamp")


def _day():
    return F.lit("2024-02-05").cast("date")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- store


def _new_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as incoming articles; some ids are in the store."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("title"), F.col("url").alias("link"))


@query("k1_save_articles", with_articles("SELECT CAST(p.page_id AS VARCHAR) AS id, url AS title FROM pages p WHERE CAST(p.page_id AS VARCHAR) NOT IN (SELECT id FROM articles)"))
def k1(spark, sf_dir):
    own = articles(spark, sf_dir).where("category <> 'en'")
    return store.insert_ignore(own, _new_articles(spark, sf_dir), "id", [F.col("title")])[1].select("id", "title")


SQL["k1_save_articles"] = with_articles("SELECT CAST(p.page_id AS VARCHAR) AS id, url AS title FROM pages p WHERE CAST(p.page_id AS VARCHAR) NOT IN (SELECT id FROM articles WHERE category <> 'en')")


@query(
    "k2_replace_chat_papers",
    with_papers("""SELECT p.id, p.title, CAST(NULL AS INT) AS rating FROM papers p JOIN labels l ON p.arxiv_id = CAST(l.doc_id AS VARCHAR)
    UNION ALL SELECT p.id, p.title, p.rating FROM papers p WHERE p.arxiv_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"""),
)
def k2(spark, sf_dir):
    own = chat_papers(spark, sf_dir)
    new = own.join(table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("arxiv_id")), "arxiv_id").select("id", "title")
    return store.replace_rows(own, new, "id", [F.col("title")]).select("id", "title", "rating")


@query(
    "k3_upsert_abstracts",
    with_articles("""SELECT coalesce(a.id, b.arxiv_id) AS arxiv_id, coalesce(b.abstract, a.abstract) AS abstract
    FROM (SELECT id, abstract FROM articles WHERE abstract <> '') a
    FULL JOIN (SELECT CAST(page_id AS VARCHAR) AS arxiv_id, url AS abstract FROM pages WHERE url <> '') b ON a.id = b.arxiv_id"""),
)
def k3(spark, sf_dir):
    own = articles(spark, sf_dir).where("abstract <> ''").select(F.col("id").alias("arxiv_id"), "abstract")
    new = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("arxiv_id"), F.col("url").alias("abstract"))
    return store.upsert_columns(own, new, "arxiv_id", ["abstract"], [F.col("abstract")])


def _twice(first: DataFrame, again: DataFrame) -> DataFrame:
    """Two rounds of updates in one table; ``at`` tells which came first."""
    return again.withColumn("at", F.lit(2)).unionByName(first.withColumn("at", F.lit(1)))


@query("k4_update_scores", with_articles("SELECT a.id, coalesce(CAST(o.s AS DOUBLE), a.score) AS score FROM articles a LEFT JOIN (SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN length(url) % 2 = 0 THEN 0.125 ELSE length(url) / 100.0 END AS s FROM pages) o USING (id)"))
def k4(spark, sf_dir):
    pages_ = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), "url", (F.length("url") / 100.0).alias("score"))
    scores = _twice(pages_, pages_.where("length(url) % 2 = 0").withColumn("score", F.lit(0.125)))
    return store.update_scores(articles(spark, sf_dir), scores, [F.col("at")]).select("id", "score")


@query("k5_update_translations", with_articles("SELECT a.id, CASE WHEN l.toxic = 1 THEN NULL WHEN l.doc_id IS NOT NULL THEN nullif(repeat('x', l.quality), '') ELSE a.translated_title END AS translated_title FROM articles a LEFT JOIN labels l ON a.id = CAST(l.doc_id AS VARCHAR)"))
def k5(spark, sf_dir):
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), "toxic", F.expr("repeat('x', quality)").alias("translated_title"))
    new = _twice(new, new.where("toxic = 1").withColumn("translated_title", F.lit("")))
    return store.update_matched(articles(spark, sf_dir), new, ["translated_title"], [F.col("at")], empty_is_null=True).select("id", "translated_title")


@query("k6_update_votes", with_articles("SELECT a.id, CASE WHEN l.quality = 1 THEN NULL WHEN l.doc_id IS NOT NULL THEN nullif(l.toxic, 0) ELSE a.hf_upvotes END AS hf_upvotes, CASE WHEN l.quality = 1 THEN l.toxic - 4 WHEN l.doc_id IS NOT NULL THEN NULL ELSE a.ax_net_votes END AS ax_net_votes, CASE WHEN l.doc_id IS NOT NULL THEN TIMESTAMP '2024-01-31 12:00:00' ELSE a.votes_updated_at END AS votes_updated_at FROM articles a LEFT JOIN labels l ON a.id = CAST(l.doc_id AS VARCHAR)"))
def k6(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("id", F.col("doc_id").cast("string"))
    none = F.lit(None).cast("int")
    first = labels.select("id", F.nullif("toxic", F.lit(0)).cast("int").alias("hf_upvotes"), none.alias("ax_net_votes"))
    again = labels.where("quality = 1").select("id", none.alias("hf_upvotes"), (F.col("toxic") - 4).cast("int").alias("ax_net_votes"))
    return store.update_votes(articles(spark, sf_dir), _twice(first, again), _as_of(), [F.col("at")]).select("id", "hf_upvotes", "ax_net_votes", "votes_updated_at")


@query("k7_mark_pushed", with_articles("SELECT id, CASE WHEN status = 2 THEN TIMESTAMP '2024-01-31 12:00:00' ELSE pushed_at END AS pushed_at FROM articles"))
def k7(spark, sf_dir):
    own = articles(spark, sf_dir)
    return store.mark_pushed_set(own, own.where("status = 2"), _as_of()).select("id", "pushed_at")


@query("k8_clear_date", with_articles("SELECT id, CASE WHEN recommend_date = DATE '2024-02-05' THEN NULL ELSE recommend_date END AS recommend_date, CASE WHEN recommend_date = DATE '2024-02-05' THEN NULL ELSE batch_order END AS batch_order FROM articles"))
def k8(spark, sf_dir):
    return store.clear_recommendations(articles(spark, sf_dir), _day()).select("id", "recommend_date", "batch_order")


@query("k9_clear_all", with_articles("SELECT id FROM articles WHERE false"))
def k9(spark, sf_dir):
    """What a reader finds of stored articles when the store has been cleared."""
    own, path = articles(spark, sf_dir), new_path(spark, "articles")
    own.write.parquet(path)
    return store.cleared(spark, path, own.schema).select("id")


@query("k11_delete_papers", with_papers("SELECT id FROM papers WHERE arxiv_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"))
def k11(spark, sf_dir):
    keys = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("arxiv_id"))
    return store.deleted(chat_papers(spark, sf_dir), keys, "arxiv_id").select("id")


_K17_SQL = """SELECT id, CASE WHEN n % 3 = 0 THEN 'New' ELSE title END AS title, CASE WHEN n % 2 = 0 THEN 5 WHEN good THEN n // 3 ELSE rating END AS rating, (good::INT + (n % 2 = 0)::INT) % 2 = 1 AS pinned
FROM (SELECT *, length(title) AS n, length(title) // 3 BETWEEN 1 AND 10 AS good FROM papers)"""


@query("k17_rate_papers", with_papers(_K17_SQL))
def k17(spark, sf_dir):
    """Three requests for a paper, not in the order in which they came: a rating and a pin, both again, a title."""
    own = chat_papers(spark, sf_dir).withColumn("pinned", F.lit(False)).withColumn("n", F.length("title"))
    ask = lambda at, title, rating, pin: own.select("id", "n", F.lit(at).alias("at"), title.cast("string").alias("title"), rating.cast("int").alias("rating"), F.lit(pin).alias("pin"))
    none = F.lit(None)
    asked = ask(3, F.lit(" New "), none, None).where("n % 3 = 0").unionByName(ask(2, none, F.lit(5), True).where("n % 2 = 0")).unionByName(ask(1, none, F.floor(F.col("n") / 3), True))
    return store.rated(own, asked, [F.col("at")])[0].select("id", "title", "rating", "pinned")


# ---------------------------------------------------------------- filters, orders, pages

_ORDER = "ORDER BY score DESC, created_at DESC, id"


@query("f1_articles_by_status", with_articles(f"SELECT id, score FROM articles WHERE status = 0 {_ORDER} LIMIT 50 OFFSET 20"))
def f1(spark, sf_dir):
    return select.articles(articles(spark, sf_dir), status=0, limit=50, offset=20).select("id", "score")


@query("t1_articles_page", with_articles(f"SELECT id, score FROM articles {_ORDER} LIMIT 50"))
def t1(spark, sf_dir):
    return select.articles(articles(spark, sf_dir), limit=999, offset=-3).select("id", "score")


@query("f2_recommended", with_articles(f"SELECT id, score FROM articles WHERE score > 0 AND status = 0 {_ORDER} LIMIT 100"))
def f2(spark, sf_dir):
    return select.recommended(articles(spark, sf_dir), 100).select("id", "score")


@query("f3_unscored", with_articles("SELECT id, created_at FROM articles WHERE score = 0 AND status = 0 ORDER BY created_at DESC, id LIMIT 500"))
def f3(spark, sf_dir):
    return select.unscored(articles(spark, sf_dir)).select("id", "created_at")


@query("f4_needing_votes", with_articles("SELECT id FROM articles WHERE votes_updated_at IS NULL AND created_at > TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 30 DAY - INTERVAL 12 HOUR + INTERVAL 12 HOUR ORDER BY created_at DESC, id LIMIT 100"))
def f4(spark, sf_dir):
    return select.needing_votes(articles(spark, sf_dir), _as_of(), 100).select("id")


@query("f5_of_date", with_articles("SELECT id, batch_order FROM articles WHERE recommend_date = DATE '2024-02-05'"))
def f5(spark, sf_dir):
    return select.of_date(articles(spark, sf_dir), _day()).select("id", "batch_order")


@query("f6_backlog", with_articles("SELECT id, recommend_date FROM articles WHERE pushed_at IS NULL AND recommend_date IS NOT NULL ORDER BY recommend_date, batch_order NULLS FIRST, id LIMIT 500"))
def f6(spark, sf_dir):
    return select.backlog(articles(spark, sf_dir), 500).select("id", "recommend_date")


@query("f7_point_lookup", with_articles("SELECT id, title FROM articles WHERE id = '42'"))
def f7(spark, sf_dir):
    return select.by_id(articles(spark, sf_dir), "42").select("id", "title")


@query("f8_updated_since", with_papers("SELECT id, updated_at FROM papers WHERE updated_at >= '2024-01-18' AND arxiv_id <> ''"))
def f8(spark, sf_dir):
    return select.updated_since(chat_papers(spark, sf_dir), "2024-01-18").select("id", "updated_at")


_WORDS = ["License", "casino", " ", "que ", "THE AND"]
_HIT = " OR ".join(f"contains(lower(coalesce({c}, '')), '{w.strip().lower()}')" for c in ("title", "abstract") for w in _WORDS if w.strip())


@query("f9_without_keywords", with_articles(f"SELECT id FROM articles WHERE NOT ({_HIT})"))
def f9(spark, sf_dir):
    return select.without_keywords(articles(spark, sf_dir), _WORDS).select("id")


@query("f10_title_search", with_articles("SELECT id, title FROM articles WHERE contains(lower(title), 'the ')"))
def f10(spark, sf_dir):
    return select.titled(articles(spark, sf_dir), "The ").select("id", "title")


@query("f14_untranslated", with_articles("SELECT id FROM articles WHERE translated_title IS NULL OR translated_title = ''"))
def f14(spark, sf_dir):
    return select.untranslated(articles(spark, sf_dir)).select("id")


@query("f15_scoring_columns", with_articles("SELECT id, title, abstract FROM articles"))
def f15(spark, sf_dir):
    return articles(spark, sf_dir).select("id", "title", "abstract")


_F16_SQL = """SELECT id, title, abstract, score, status, strftime(recommend_date, '%Y-%m-%d') AS recommend_date,
  (SELECT count(v) FROM unnest([id, title, link, abstract, author, category, comment, status::VARCHAR, score::VARCHAR, hf_upvotes::VARCHAR, ax_net_votes::VARCHAR, votes_updated_at::VARCHAR, pushed_at::VARCHAR, recommend_date::VARCHAR, batch_order::VARCHAR, recommendation_type, translated_title, translated_abstract]) x(v)) AS fields FROM articles"""


@query("f16_responses", with_articles(_F16_SQL))
def f16(spark, sf_dir):
    """The responses, read again."""
    body = select.responses(articles(spark, sf_dir).drop("created_at"))
    back = body.select(F.from_json("body", "id string, title string, abstract string, score double, status int, recommend_date string").alias("x"), F.size(F.json_object_keys("body")).cast("long").alias("fields"))
    return back.select("x.*", "fields")


@query("f17_shown_title", with_articles("SELECT id, coalesce(nullif(translated_title, ''), title) AS title, coalesce(nullif(translated_abstract, ''), abstract) AS abstract FROM articles"))
def f17(spark, sf_dir):
    return select.shown_title(articles(spark, sf_dir)).select("id", "title", "abstract")


@query("f12_visible_messages", "SELECT conv_id AS paper, count(*) FILTER (role <> 'system' AND NOT (role = 'assistant' AND length(text) % 2 = 0)) AS n FROM conversations GROUP BY 1")
def f12(spark, sf_dir):
    """System turns as tool rows; assistant turns of an even length as blank calls of a tool, every third as a call with words."""
    turns, size = table(spark, sf_dir, "conversations"), F.length("text")
    blank = (F.col("role") == "assistant") & (size % 2 == 0)
    calls = F.when(blank | (size % 3 == 0), F.array(F.struct(F.lit("c").alias("id")))).otherwise(F.array().cast("array<struct<id: string>>"))
    rows = turns.select(F.col("conv_id").alias("paper"), F.struct(F.when(F.col("role") == "system", "tool").otherwise(F.col("role")).alias("role"), F.when(blank, " ").otherwise(F.col("text")).alias("content"), calls.alias("tool_calls")).alias("m"))
    return rows.groupBy("paper").agg(F.size(select.visible_messages(F.collect_list("m"))).cast("long").alias("n"))


@query("f13_delete_rounds", with_messages("SELECT paper, seq FROM messages WHERE round <> 1"))
def f13(spark, sf_dir):
    own = messages(spark, sf_dir)
    return context.without_rounds(own, own.where("round = 1").select("paper", "round").distinct()).select("paper", "seq")


@query("f13_delete_last_round", with_messages("SELECT m.paper, seq FROM messages m JOIN (SELECT paper, max(seq) // 2 AS r FROM messages GROUP BY 1) USING (paper) WHERE round <> r"))
def f13_last(spark, sf_dir):
    return context.without_last_round(messages(spark, sf_dir)).select("paper", "seq")


@query("t3_paper_list", with_papers("SELECT id, rating >= 10 AS pinned, updated_at, row_number() OVER (ORDER BY rating >= 10 DESC, updated_at DESC, id) AS pos FROM papers QUALIFY pos <= 100"))
def t3(spark, sf_dir):
    own = chat_papers(spark, sf_dir).withColumn("pinned", F.col("rating") >= 10).withColumn("ref", F.col("id"))
    top = select.papers_in_order(own).limit(100)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("pinned"), F.desc("updated_at"), "id"))).select("id", "pinned", "updated_at", "pos")


@query("t4_papers_by_rating", with_papers("SELECT id, rating FROM papers ORDER BY rating >= 12 DESC, rating, id LIMIT 60"))
def t4(spark, sf_dir):
    own = chat_papers(spark, sf_dir).withColumn("pinned", F.col("rating") >= 12)
    return select.papers_sorted(own, "rating", ascending=True).limit(60).select("id", "rating")


@query("t5_page", with_articles("SELECT id FROM articles ORDER BY created_at, id LIMIT 8 OFFSET 24"))
def t5(spark, sf_dir):
    return select.page(articles(spark, sf_dir), [F.col("created_at"), F.col("id")], 3).select("id")


@query("t8_scroll", with_articles("SELECT id FROM articles ORDER BY created_at, id LIMIT 100 OFFSET 100"))
def t8(spark, sf_dir):
    return select.scrolled(articles(spark, sf_dir), [F.col("created_at"), F.col("id")], 100)[0].select("id")


@query("t7_recent_log", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def t7(spark, sf_dir):
    from feedloom.operators.logs import recent

    return recent(table(spark, sf_dir, "events").withColumn("id", F.col("event_id")), 900).select("event_id", "ts")


_SEED = "2024-02-05"


@query(
    "t2_hybrid_topk",
    with_articles(f"""
    , pool AS (SELECT * FROM articles WHERE status = 0 AND score >= 0 AND recommend_date IS NULL),
    s AS (SELECT id, 'score' AS recommendation_type, row_number() OVER (ORDER BY score DESC, created_at DESC, id) - 1 AS o FROM pool QUALIFY o < 14),
    r AS (SELECT id, 'random' AS recommendation_type, row_number() OVER (ORDER BY md5('{_SEED}|' || id), id) - 1 + (SELECT count(*) FROM s) AS o FROM pool WHERE id NOT IN (SELECT id FROM s) QUALIFY o < 20)
    SELECT id, recommendation_type, CAST(o AS INT) AS batch_order FROM s UNION ALL SELECT id, recommendation_type, CAST(o AS INT) FROM r"""),
)
def t2(spark, sf_dir):
    return recommend.hybrid_topk(articles(spark, sf_dir), 20, 0.3, _SEED)


# ---------------------------------------------------------------- joins


@query("j1_not_stored", with_articles("SELECT CAST(page_id AS VARCHAR) AS id FROM pages WHERE CAST(page_id AS VARCHAR) NOT IN (SELECT id FROM articles WHERE status <> 0)"))
def j1(spark, sf_dir):
    return joins.not_stored(_new_articles(spark, sf_dir), articles(spark, sf_dir).where("status <> 0")).select("id")


@query("j2_in_set", with_articles("SELECT id FROM articles WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"))
def j2(spark, sf_dir):
    return joins.in_set(articles(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))).select("id")


@query("j3_in_order", with_articles("SELECT pos, id, title FROM (VALUES (0, '7'), (1, '3'), (2, 'none'), (3, '7')) v(pos, id) JOIN articles USING (id)"))
def j3(spark, sf_dir):
    return joins.in_order(spark, articles(spark, sf_dir), ["7", "3", "none", "7"]).select("pos", "id", "title")


@query("j4_with_abstracts", with_both("SELECT p.id, CASE WHEN a.category = 'de' THEN 'later' ELSE coalesce(a.abstract, '') END AS abstract FROM papers p LEFT JOIN articles a ON p.arxiv_id = a.id"))
def j4(spark, sf_dir):
    side = articles(spark, sf_dir).select(F.col("id").alias("arxiv_id"), "abstract", "category")
    side = _twice(side, side.where("category = 'de'").withColumn("abstract", F.lit("later")))
    return joins.with_abstracts(chat_papers(spark, sf_dir), side, [F.col("at")]).select("id", "abstract")


@query("j8_first_answer", "SELECT d.doc_id, coalesce(l.quality, p.n, c.n) AS v, CASE WHEN l.quality IS NOT NULL THEN 'labels' WHEN p.n IS NOT NULL THEN 'pages' WHEN c.n IS NOT NULL THEN 'chat' END AS source FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT page_id AS doc_id, CAST(CASE WHEN length(url) % 2 = 0 THEN 1 ELSE length(url) END AS INT) AS n FROM pages) p USING (doc_id) LEFT JOIN (SELECT conv_id AS doc_id, CAST(count(*) AS INT) AS n FROM conversations GROUP BY 1) c USING (doc_id)")
def j8(spark, sf_dir):
    chat = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).cast("int").alias("v"))
    page = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.length("url").alias("v"))
    label = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("v"))
    sources = [("labels", _twice(label, label)), ("pages", _twice(page, page.where("v % 2 = 0").withColumn("v", F.lit(1)))), ("chat", _twice(chat, chat))]
    return joins.first_answer(table(spark, sf_dir, "documents"), "doc_id", sources, "v", [F.col("at")])


@query("j9_first_by_file", with_papers("SELECT substring(updated_at, 1, 10) AS arxiv_id, arg_min(id, 'f' || title || id) AS ref FROM papers GROUP BY 1"))
def j9(spark, sf_dir):
    own = chat_papers(spark, sf_dir).select(F.substring("updated_at", 1, 10).alias("arxiv_id"), F.col("id").alias("ref"), F.concat(F.lit("f"), "title", "id").alias("file"))
    return joins.first_by_file(own)


@query(
    "j10_resolved_refs",
    """WITH p AS (SELECT md5(CAST(page_id AS VARCHAR)) AS session_id, page_id AS id FROM pages),
    a AS (SELECT DISTINCT substring(session_id, 1, 5) AS asked FROM p UNION SELECT session_id FROM p UNION SELECT CAST(id AS VARCHAR) FROM p UNION SELECT 'old-' || id FROM p UNION SELECT 'none-' || id FROM p),
    m AS (SELECT asked, min(CASE WHEN session_id = asked THEN session_id END) AS e, count(*) FILTER (starts_with(session_id, asked) AND length(asked) >= 4) AS n,
      min(CASE WHEN starts_with(session_id, asked) AND length(asked) >= 4 THEN session_id END) AS f, min(CASE WHEN CAST(id AS VARCHAR) = asked THEN session_id END) AS g, min(CASE WHEN 'old-' || id = asked THEN session_id END) AS o FROM a, p GROUP BY 1)
    SELECT asked, coalesce(e, CASE WHEN n = 1 THEN f WHEN n = 0 THEN coalesce(o, g) END) AS ref, CASE WHEN e IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'prefix' WHEN n > 1 THEN 'ambiguous' WHEN o IS NOT NULL THEN 'file' WHEN g IS NOT NULL THEN 'number' ELSE 'missing' END AS how FROM m""",
)
def j10(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.md5(F.col("page_id").cast("string")).alias("session_id"), F.col("page_id").alias("id"), F.concat(F.lit("old-"), "page_id", F.lit(".json")).alias("file"))
    names = [F.substring("session_id", 1, 5), F.col("session_id"), F.col("id").cast("string"), F.concat(F.lit("old-"), "id"), F.concat(F.lit("none-"), "id")]
    asked = p.select(F.explode(F.array(*names)).alias("asked")).distinct()
    return joins.resolved_refs(asked, p)


# ---------------------------------------------------------------- aggregates


@query("a1_status_counts", with_articles("SELECT status, count(*) AS n FROM articles GROUP BY 1"))
def a1(spark, sf_dir):
    return aggregates.status_counts(articles(spark, sf_dir))


@query("a2_statistics", with_articles("SELECT count(*) FILTER (status = 0) AS unread, count(*) FILTER (status = 3) AS read, count(*) FILTER (status = 1) AS activated, count(*) FILTER (status = 2) AS liked, count(*) FILTER (status = -1) AS disliked, count(*) AS total FROM articles"))
def a2(spark, sf_dir):
    return aggregates.statistics(articles(spark, sf_dir))


@query("a3_unpushed", with_articles("SELECT count(*) AS n FROM articles WHERE pushed_at IS NULL AND recommend_date IS NOT NULL"))
def a3(spark, sf_dir):
    return aggregates.unpushed(articles(spark, sf_dir))


@query("a4_last_push", with_articles("SELECT coalesce(strftime(max(pushed_at), '%Y-%m-%d %H:%M:%S'), '') AS last_push FROM articles"))
def a4(spark, sf_dir):
    return aggregates.last_push(articles(spark, sf_dir))


@query("a5_recommendation_dates", with_articles("SELECT DISTINCT recommend_date FROM articles WHERE recommend_date IS NOT NULL"))
def a5(spark, sf_dir):
    return aggregates.recommendation_dates(articles(spark, sf_dir))


@query("a6_first_wins", "SELECT url, page_id FROM (SELECT *, row_number() OVER (PARTITION BY length(url) ORDER BY page_id) AS r FROM pages) WHERE r = 1")
def a6(spark, sf_dir):
    return store.first_wins(table(spark, sf_dir, "pages").withColumn("k", F.length("url")), ["k"], [F.col("page_id")]).select("url", "page_id")


@query("a7_token_totals", with_messages("SELECT paper, CAST(sum(token_count) AS BIGINT) AS token_count, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens FROM messages GROUP BY 1"))
def a7(spark, sf_dir):
    return aggregates.token_totals(messages(spark, sf_dir))


@query("a8_round_range", with_messages('SELECT paper, min(round) AS "first", max(round) AS "last" FROM messages GROUP BY 1'))
def a8(spark, sf_dir):
    return aggregates.round_range(messages(spark, sf_dir))


@query("a9_next_id", "SELECT coalesce(max(page_id), 0) + 1 AS next_id FROM pages")
def a9(spark, sf_dir):
    return aggregates.next_id(table(spark, sf_dir, "pages").withColumnRenamed("page_id", "id"))


@query("a10_formatted_rounds", with_messages("SELECT paper, string_agg(CASE WHEN role = 'user' THEN 'Q: ' ELSE 'A: ' END || content, chr(10) || chr(10) ORDER BY seq) AS text FROM messages WHERE role <> 'tool' GROUP BY 1"))
def a10(spark, sf_dir):
    return aggregates.formatted_rounds(messages(spark, sf_dir))


@query("a11_assembled_calls", with_messages("SELECT paper AS reply, round AS \"index\", arg_max(role, seq) FILTER (role <> '') AS name, string_agg(content, '' ORDER BY seq) AS arguments FROM messages GROUP BY 1, 2"))
def a11(spark, sf_dir):
    own = messages(spark, sf_dir).select(F.col("paper").alias("reply"), F.col("round").alias("index"), "seq", F.lit("").alias("id"), F.lit("").alias("type"), F.col("role").alias("name"), F.col("content").alias("arguments"))
    return aggregates.assembled_calls(own).select("reply", "index", "name", "arguments")


_A12_SQL = r"""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS own, regexp_matches(line, '^\s*\|.*\|\s*$') AS shown FROM l),
c AS (SELECT *, (sum((own LIKE '```%')::INT) OVER w - (own LIKE '```%')::INT) % 2 = 1 AS code, shown AND NOT coalesce(lag(shown) OVER w, false) AS begins FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT doc_id, sum(begins::INT)::INT AS tables, sum(CASE WHEN own = '' THEN 0 WHEN length(own) > 1 AND own LIKE '|%' AND own LIKE '%|' AND NOT code THEN (length(own) - length(replace(own, '|', '')) - 1) // 4 + 1 ELSE 1 END)::INT AS elements FROM c GROUP BY 1)
SELECT doc_id, tables, elements, strlen(text) <= 28000 AND elements <= 180 AND tables <= 5 AS fits FROM d JOIN documents USING (doc_id)"""


@query("a12_text_counts", _A12_SQL)
def a12(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fit.count_tables(F.col("text")).alias("tables"), fit.count_elements(F.col("text")).alias("elements"), fit.card_fits(F.col("text")).alias("fits"))


@query("a13_main_file", with_messages("SELECT paper AS archive, arg_max(role || seq, (length(content), -seq)) AS path FROM messages WHERE role = 'assistant' GROUP BY 1"))
def a13(spark, sf_dir):
    own = messages(spark, sf_dir).select(F.col("paper").alias("archive"), F.concat("role", F.col("seq").cast("string")).alias("path"), "content", F.col("seq").alias("walk"))
    head = F.when(F.col("path").startswith("assistant"), r"\documentclass{x}\begin{document}").otherwise("")
    return aggregates.main_file(own.withColumn("content", F.concat(head, F.coalesce("content", F.lit("")))))


# ---------------------------------------------------------------- ordered analytics


@query(
    "w1_context_messages",
    with_messages("""
    , c AS (SELECT *, CASE WHEN round <> lag(round) OVER (PARTITION BY paper ORDER BY seq) THEN 1 ELSE 0 END AS x FROM messages),
    g AS (SELECT *, sum(x) OVER (PARTITION BY paper ORDER BY seq) AS run FROM c),
    l AS (SELECT *, max(CASE WHEN role = 'assistant' AND NOT skip_context THEN seq END) OVER (PARTITION BY paper, run) AS last FROM g)
    SELECT paper, seq FROM l WHERE seq <= last"""),
)
def w1(spark, sf_dir):
    return context.context_messages(messages(spark, sf_dir)).select("paper", "seq")


_ROUNDS = "SELECT paper, round, sum(prompt_tokens) AS p, sum(completion_tokens) AS c FROM messages GROUP BY 1, 2"


@query("w3_anchors", with_messages(f", r AS ({_ROUNDS}) SELECT paper, round, coalesce(last_value(CASE WHEN p + c > 900 THEN greatest(1, round - 1) END IGNORE NULLS) OVER (PARTITION BY paper ORDER BY round ROWS UNBOUNDED PRECEDING), 0) AS anchor FROM r"))
def w3(spark, sf_dir):
    rounds = messages(spark, sf_dir).groupBy("paper", "round").agg(F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"))
    return context.anchors(rounds, budget=900, least=2)


@query("w2_recent_context")
def w2(spark, sf_dir):
    own = messages(spark, sf_dir)
    rounds = own.groupBy("paper", "round").agg(F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"))
    last = context.anchors(rounds, budget=900).groupBy("paper").agg(F.max_by("anchor", "round").alias("anchor"))
    return context.recent_context(own, last).select("paper", "seq")


SQL["w2_recent_context"] = with_messages(f"""
    , r AS ({_ROUNDS}), a AS (SELECT paper, coalesce(max(CASE WHEN p + c > 900 THEN greatest(1, round - 1) END), 0) AS anchor FROM r GROUP BY 1),
    c AS (SELECT *, CASE WHEN round <> lag(round) OVER (PARTITION BY paper ORDER BY seq) THEN 1 ELSE 0 END AS x FROM messages),
    g AS (SELECT *, sum(x) OVER (PARTITION BY paper ORDER BY seq) AS run FROM c),
    l AS (SELECT *, max(CASE WHEN role = 'assistant' AND NOT skip_context THEN seq END) OVER (PARTITION BY paper, run) AS last FROM g)
    SELECT l.paper, seq FROM l JOIN a USING (paper) WHERE seq <= last AND (anchor <= 0 OR round >= anchor)""")


@query("w4_recent_messages", with_messages("SELECT paper, seq FROM messages QUALIFY row_number() OVER (PARTITION BY paper ORDER BY seq DESC) <= 4"))
def w4(spark, sf_dir):
    return context.recent_messages(messages(spark, sf_dir), 2).select("paper", "seq")


@query(
    "w5_fetched_rounds",
    with_messages("""
    , q AS (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY paper, round ORDER BY seq ROWS UNBOUNDED PRECEDING) AS question FROM messages WHERE round >= 1),
    r AS (SELECT paper, round, arg_max(coalesce(question, ''), seq) AS question, arg_max(content, seq) AS answer FROM q WHERE role = 'assistant' GROUP BY 1, 2)
    SELECT paper, round, question, answer FROM r QUALIFY dense_rank() OVER (PARTITION BY paper ORDER BY round DESC) <= 2"""),
)
def w5(spark, sf_dir):
    return context.fetched_rounds(messages(spark, sf_dir), 99)


@query("w6_retry_context", with_messages("SELECT paper, seq FROM messages WHERE NOT skip_context AND round < 3 AND round >= 1"))
def w6(spark, sf_dir):
    return context.retry_context(messages(spark, sf_dir), 3, 1).select("paper", "seq")


@query("w7_running_tokens", with_messages("SELECT paper, seq, CAST(sum(token_count) OVER (PARTITION BY paper ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_token_count FROM messages"))
def w7(spark, sf_dir):
    return aggregates.running_totals(messages(spark, sf_dir), "token_count").select("paper", "seq", "total_token_count")


@query("w8_round_outline", with_messages("SELECT paper, round, substring(split_part(arg_min(content, seq), chr(10), 1), 1, 50) AS line FROM messages WHERE round >= 1 AND role = 'user' GROUP BY 1, 2"))
def w8(spark, sf_dir):
    return context.round_outline(messages(spark, sf_dir))


@query("w10_batches", with_articles("SELECT id, row_number() OVER (ORDER BY created_at, id) - 1 AS pos, (row_number() OVER (ORDER BY created_at, id) - 1) // 10 AS batch, title, sha256(abstract) AS abstract_sha256, score, recommend_date FROM articles"))
def w10(spark, sf_dir):
    return recommend.in_batches(articles(spark, sf_dir), 10, F.col("created_at"), F.col("id")).select("id", "pos", "batch", "title", F.sha2("abstract", 256).alias("abstract_sha256"), "score", "recommend_date")


@query("w11_page_of", with_articles("SELECT coalesce(max((r - 1) // 8 + 1), 1) AS page FROM (SELECT id, row_number() OVER (PARTITION BY recommend_date ORDER BY batch_order, id) AS r FROM articles WHERE recommend_date IS NOT NULL) WHERE id = '25'"))
def w11(spark, sf_dir):
    return recommend.page_of(articles(spark, sf_dir), "25")


@query("w12_last_user", with_messages("SELECT paper, arg_max(content, seq) AS content FROM messages WHERE role = 'user' GROUP BY 1"))
def w12(spark, sf_dir):
    return context.last_by_role(messages(spark, sf_dir), "user")


@query("w12_last_answer_changed", with_messages("SELECT m.paper, seq, CASE WHEN seq = s THEN 'new' ELSE content END AS content FROM messages m LEFT JOIN (SELECT paper, max(seq) AS s FROM messages WHERE role = 'assistant' GROUP BY 1) USING (paper)"))
def w12_changed(spark, sf_dir):
    own = messages(spark, sf_dir)
    return context.with_last_answer(own, own.select("paper", F.lit("new").alias("content")).distinct()).select("paper", "seq", "content")


@query("w13_blank_lines", "WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), b AS (SELECT *, lag(line) OVER (PARTITION BY doc ORDER BY pos) AS p FROM l) SELECT doc, CAST(pos AS INT) AS pos, line FROM b WHERE trim(line) <> '' OR p IS NULL OR trim(p) <> ''")
def w13(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return context.collapsed_blank_lines(lines).select("doc", "pos", "line")


# ---------------------------------------------------------------- set operations


@query(
    "u1_feedback",
    with_both("""SELECT id, title, abstract, status, 'article' AS source, 0 AS rating FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY score DESC, created_at DESC, id) AS r FROM articles WHERE status IN (1, 2, -1)) WHERE r <= 200
    UNION ALL SELECT p.arxiv_id, p.title, coalesce(a.abstract, ''), 1, 'chat', p.rating FROM papers p LEFT JOIN articles a ON a.id = p.arxiv_id WHERE p.updated_at >= '2024-01-18' AND p.arxiv_id <> ''"""),
)
def u1(spark, sf_dir):
    own = articles(spark, sf_dir)
    papers = joins.with_abstracts(chat_papers(spark, sf_dir), own.select(F.col("id").alias("arxiv_id"), "abstract"), [])
    return recommend.feedback(own, papers, "2024-01-18")


@query("u2_union_distinct", "SELECT lang AS category FROM documents UNION SELECT source FROM documents")
def u2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("lang").alias("category")).union(docs.select("source")).distinct()


@query("s19_feedback_labels", with_both("SELECT p.id, CASE WHEN rating > 0 THEN 'read in depth, rated ' || rating || '/10' ELSE 'read in depth' END AS label FROM papers p UNION ALL SELECT id, CASE status WHEN 2 THEN 'liked' WHEN -1 THEN 'disliked' WHEN 1 THEN 'activated' ELSE 'seen' END FROM articles"))
def s19(spark, sf_dir):
    a = articles(spark, sf_dir).select("id", recommend.feedback_label(F.col("status"), F.lit("article"), F.lit(0)).alias("label"))
    return chat_papers(spark, sf_dir).select("id", recommend.feedback_label(F.lit(1), F.lit("chat"), F.col("rating")).alias("label")).union(a)


# ---------------------------------------------------------------- scalar functions


@query("x1_arxiv_id", "SELECT doc_id, regexp_extract(text || ' arXiv:2401.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || 'v2', '(\\d{4}\\.\\d{4,5})(v\\d+)?', 1) AS id FROM documents")
def x1(spark, sf_dir):
    shown = F.concat("text", F.lit(" arXiv:2401."), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit("v2"))
    return table(spark, sf_dir, "documents").select("doc_id", ids.arxiv_id(shown).alias("id"))


@query("x2_normalized_arxiv", "SELECT page_id, CASE page_id % 4 WHEN 3 THEN '' ELSE 'https://arxiv.org/abs/2401.' || lpad(CAST(page_id AS VARCHAR), 5, '0') || 'v1' END AS url, page_id % 4 <> 3 AS ok FROM pages")
def x2(spark, sf_dir):
    own = F.concat(F.lit("2401."), F.lpad(F.col("page_id").cast("string"), 5, "0"), F.lit("v1"))
    form = F.col("page_id") % 4
    given = F.when(form == 0, F.concat(F.lit("arXiv: "), own)).when(form == 1, F.concat(F.lit("HTTPS://www.arxiv.org/pdf/").substr(1, 0), F.lit("https://www.arxiv.org/pdf/"), own, F.lit(".pdf?x#y")))
    given = given.when(form == 2, own).otherwise(F.col("url"))
    n = ids.normalized_arxiv(given)
    return table(spark, sf_dir, "pages").select("page_id", n["url"].alias("url"), n["ok"].alias("ok"))


@query("x4_github_url", "SELECT page_id, 'https://github.com/o' || page_id || '/r.x' AS repository FROM pages")
def x4(spark, sf_dir):
    shown = F.concat(F.lit("bare github.com/a/b, then https://github.com/o"), "page_id", F.lit("/r.x.git). "), "html")
    return table(spark, sf_dir, "pages").select("page_id", ids.github_url(shown).alias("repository"))


@query("x6_clean_text", "SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '^\\s+|\\s+$', '', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '^\\s+|\\s+$', '', 'g') AS text FROM pages")
def x6(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html")).alias("text"))


@query("x9_truncated", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS text FROM documents")
def x9(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 80).alias("text"))


@query("x11_estimated_tokens", "SELECT doc_id, CAST(strlen(text) // 4 AS BIGINT) AS tokens FROM documents")
def x11(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@query("x12_file_names", "SELECT page_id, regexp_replace(trim(url), '[/\\\\:*?\"<>|]', '_', 'g') AS name FROM pages")
def x12(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


@query("x14_thousands", "SELECT o_orderkey, format('{:,}', o_orderkey * 1000) AS shown FROM orders")
def x14(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.thousands(F.col("o_orderkey") * 1000).alias("shown"))


@query("x17_references", r"SELECT doc_id, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS body_sha256, '## References' || chr(10) || '[' || doc_id || ']' AS refs FROM documents")
def x17(spark, sf_dir):
    """Documents with a heading and one reference put at their end."""
    split = ids.split_references(F.concat("text", F.lit("\n## References\n["), F.col("doc_id").cast("string"), F.lit("]\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(split["body"], 256).alias("body_sha256"), split["refs"].alias("refs"))


@query("s7_usable_pages", "SELECT page_id FROM pages WHERE strlen(html) >= 1000")
def s7(spark, sf_dir):
    return pages.usable_pages(table(spark, sf_dir, "pages")).select("page_id")


_S11_SQL = r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '^\[[^\]]*\]\s*', '') AS title
FROM (SELECT page_id, regexp_extract(substring(replace(html, '<title>', '<title>[2401.1] <b>A</b>  '), 1, 8192), '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages)"""


@query("s11_page_titles", _S11_SQL)
def s11(spark, sf_dir):
    """Titles of pages, with an id, a tag and spaces put before them."""
    html_ = F.replace("html", F.lit("<title>"), F.lit("<title>[2401.1] <b>A</b>  "))
    return table(spark, sf_dir, "pages").select("page_id", pages.page_title(html_).alias("title"))


_TAGS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<br\\s*/?>', chr(10), 'g'), '(?is)</?(?:" + html.BLOCKS + ")[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"


@query("h6_without_tags", f"SELECT page_id, {_TAGS} AS text FROM pages")
def h6(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.without_tags(F.col("html")).alias("text"))


@query("h_markdown")
def h_all(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.html_to_markdown(F.col("html")).alias("markdown"))


@query("s13_parsed_scores", "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(greatest(-1, least(1, quality * 3 - toxic)) AS DOUBLE) AS score FROM labels")
def s13(spark, sf_dir):
    item = F.to_json(F.array(F.struct(F.col("doc_id").cast("string").alias("id"), (F.col("quality") * 3 - F.col("toxic")).cast("double").alias("score"), )))
    replies = table(spark, sf_dir, "labels").select(F.concat(F.lit("```json\n"), item, F.lit("\n```")).alias("reply"))
    return json.exploded_scores(replies)


_STATUS = "CASE event_type WHEN 'error' THEN -1 WHEN 'click' THEN 1 WHEN 'view' THEN 3 WHEN 'purchase' THEN 2 ELSE 0 END"
_RANK = "CASE {} WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN -1 THEN 3 ELSE 0 END"
_MERGE = "CASE WHEN {a} = {b} AND {a} <> 0 THEN 0 WHEN {a} = 2 AND {b} = -1 THEN -1 WHEN {a} = -1 AND {b} = 2 THEN 2 WHEN {rb} > {ra} THEN {b} ELSE {a} END"


def _merge_sql(a: str, b: str) -> str:
    return _MERGE.format(a=a, b=b, ra=_RANK.format(a), rb=_RANK.format(b))


_STEPS = f"SELECT event_id, {_STATUS} AS new, lag({_STATUS}, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events"


@query("x_status_merge", f"SELECT event_id, {_merge_sql('old', 'new')} AS merged, CASE WHEN {_RANK.format('new')} > {_RANK.format('old')} THEN new ELSE old END AS bulk FROM ({_STEPS})")
def merge_table(spark, sf_dir):
    """Each event of a user merged into the event before it."""
    events = table(spark, sf_dir, "events").withColumn("new", status.event_status(F.col("event_type")))
    steps = events.withColumn("old", F.lag("new", 1, 0).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return steps.select("event_id", merged_status(F.col("old"), F.col("new")).alias("merged"), merged_status_bulk(F.col("old"), F.col("new")).alias("bulk"))


@query("m13_status_fold", f"SELECT user_id, CAST(list_reduce(list_prepend(0, list({_STATUS} ORDER BY ts, event_id)), lambda a, b: {_merge_sql('a', 'b')}) AS INT) AS status FROM events GROUP BY 1")
def m13(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("v", status.event_status(F.col("event_type")))
    return status.folded(events, "user_id", ["ts", "event_id"])


_SLOT = "lpad(CAST((hour(ts) + {}) % 24 AS VARCHAR), 2, '0') || strftime(ts, ':%M') AS {}"


@query("c_fetch_slots", f"SELECT event_id, {_SLOT.format(23, 'a')}, {_SLOT.format(7, 'b')}, {_SLOT.format(15, 'c')} FROM events")
def slots(spark, sf_dir):
    """The slots of a daily run at the time of each event."""
    at = calendar.fetch_slots(F.date_format("ts", "HH:mm"))
    return table(spark, sf_dir, "events").select("event_id", *[at[i].alias(n) for i, n in enumerate("abc")])


@query("j8_holidays", "SELECT CAST(o_orderdate AS DATE) AS day, coalesce(bool_or(o_orderpriority LIKE '1%' AND o_orderstatus = 'F') FILTER (o_orderstatus <> 'O'), dayofweek(CAST(o_orderdate AS DATE)) IN (0, 6)) AS is_holiday FROM orders GROUP BY 1")
def holidays(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    known = orders.where("o_orderstatus <> 'O'").groupBy("day").agg(F.bool_or((F.col("o_orderpriority").startswith("1")) & (F.col("o_orderstatus") == "F")).alias("is_holiday"))
    return calendar.holidays(orders, [("orders", known.withColumn("name", F.lit("order day")))]).select("day", "is_holiday")


# ---------------------------------------------------------------- windows over events


@query("s_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "1 hour", ["event_type"]).select("start", "event_type", "n")


@query("s_sliding", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) AS start, event_type, count(*) AS n FROM events, range(4) r(i) GROUP BY 1, 2")
def sliding(spark, sf_dir):
    return windows.sliding(table(spark, sf_dir, "events"), "1 hour", "15 minutes", ["event_type"]).select("start", "event_type", "n")


@query(
    "s_sessions",
    """WITH b AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS x FROM events),
    g AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""",
)
def sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "30 minutes", ["user_id"]).select("user_id", "start", "n")
