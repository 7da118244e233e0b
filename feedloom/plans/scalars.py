"""Queries of the scalar functions on ids, links, names and errors, and their SQL.

``GIVEN`` texts are written once, in SQL that Spark and DuckDB read alike; what is expected of each form
is stated apart from them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import calendar, ids, tex, text
from feedloom.operators import joins, logs, select
from feedloom.plans.catalog import query
from feedloom.plans.fixtures import chat_papers, table, with_papers

_PAGE = "CAST(page_id AS STRING)"
_DOC = "CAST(doc_id AS STRING)"
_ID = f"'2401.' || lpad({_PAGE}, 5, '0')"


def _cases(key: str, forms: list[str]) -> str:
    """A CASE over the remainder of ``key``, one form each."""
    whens = " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(forms))
    return f"CASE {key} % {len(forms)} {whens} END"


# ---------------------------------------------------------------- links

_ABS = _cases(
    "page_id",
    [
        f"'https://arxiv.org/abs/' || {_ID} || 'v2'",
        f"'http://www.arxiv.org/abs/' || {_ID}",
        f"'https://export.arxiv.org/abs/' || {_ID}",
        f"'https://arxiv.org/pdf/' || {_ID}",
        f"'https://arxiv.org/abs/hep-th/' || lpad({_PAGE}, 7, '0') || '?x#y'",
        "url",
    ],
)
_ABS_ID = _cases("page_id", [f"{_ID} || 'v2'", _ID, "''", "''", f"'hep-th/' || lpad({_PAGE}, 7, '0')", "''"])


@query("x3_abs_url_ids", f"SELECT page_id, {_ABS_ID} AS id FROM pages")
def x3(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ids.id_of_abs_url(F.expr(_ABS)).alias("id"))


_ABS_PDF = f"CASE WHEN page_id % 6 IN (0, 4) THEN replace({_ABS}, '/abs/', '/pdf/') || '.pdf' ELSE {_ABS} END"
_ABS_SHOWN = f"CASE WHEN page_id % 6 IN (0, 4) THEN replace({_ABS}, '/abs/', '/pdf/') ELSE {_ABS} END"


@query("x13_pdf_links", f"SELECT page_id, {_ABS_PDF} AS pdf, {_ABS_SHOWN} AS shown FROM pages")
def x13(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ids.pdf_url(F.expr(_ABS)).alias("pdf"), ids.shown_pdf_url(F.expr(_ABS)).alias("shown"))


_KIND = _cases("page_id", ["url", f"'/tmp/' || {_PAGE}", "'~notes'", "'../x.tex'", "'notes.tex'", "'MY_KEY'", "'K'", "'KEY2'", f"'ftp://' || {_PAGE}"])


@query("x5_kinds", f"SELECT page_id, url[:4] = 'http' AND page_id % 9 = 0 AS is_url, page_id % 9 IN (1, 2, 3) AS is_path, page_id % 9 = 5 AS is_name FROM pages")
def x5(spark, sf_dir):
    given = F.expr(_KIND)
    return table(spark, sf_dir, "pages").select("page_id", ids.is_url(given).alias("is_url"), ids.is_file_path(given).alias("is_path"), ids.is_variable_name(given).alias("is_name"))


_LINKS = f"'at https://ex.org/p' || {_PAGE} || '。then (http://ex.org/q' || {_PAGE} || '?a=1), or github.com/o' || {_PAGE} || '/r.x.'"


@query("x19_urls", f"SELECT page_id, 'https://ex.org/p' || {_PAGE} || ' http://ex.org/q' || {_PAGE} || '?a=1 https://github.com/o' || {_PAGE} || '/r.x' AS urls FROM pages")
def x19(spark, sf_dir):
    urls = F.transform(text.split_urls(F.expr(_LINKS)), text.with_scheme)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls, " ").alias("urls"))


# ---------------------------------------------------------------- feed items

_META = f"'arXiv:' || {_DOC} || 'v1 Announce Type: ' || " + _cases("doc_id", ["'new'", "'cross'", "'replace'"])
_DESC = _cases("doc_id", [f"{_META} || chr(10) || 'Abstract: ' || source || ' Abstract: ' || lang || ' '"] * 4 + [_META])
_ANNOUNCE = _cases("doc_id", ["'new'", "'cross'", "'replace'"])


@query("x7_feed_descriptions", f"SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN source || ' Abstract: ' || lang ELSE '' END AS abstract, {_ANNOUNCE} AS announce FROM documents")
def x7(spark, sf_dir):
    about = ids.feed_description(F.expr(_DESC))
    return table(spark, sf_dir, "documents").select("doc_id", about["abstract"].alias("abstract"), about["announce"].alias("announce"))


_BY = _cases("doc_id", [f"'  Authors: A ' || {_DOC} || ', Authors: B' || chr(10) || source", "source || chr(10) || 'Authors: C'", "'Author: D'"])


@query("x8_description_authors", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'A ' || {_DOC} || ', Authors: B' ELSE '' END AS author FROM documents")
def x8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.author_of_description(F.expr(_BY)).alias("author"))


@query("f11_announced", f"SELECT doc_id FROM documents WHERE {_ANNOUNCE} <> 'replace'")
def f11(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("doc_id", ids.feed_description(F.expr(_DESC))["announce"].alias("announce"))
    return select.announced(items).select("doc_id")


_NAMES = "substring('A1, A2, A3, A4, A5, A6, A7, A8', 1, CAST(4 * (1 + page_id % 8) - 2 AS INT))"


@query("x15_authors", f"SELECT page_id, CASE WHEN page_id % 8 < 5 THEN {_NAMES} ELSE 'A1, A2, A3, A' || CAST(page_id % 8 AS STRING) || ', A' || CAST(page_id % 8 + 1 AS STRING) || ', et. al.' END AS authors FROM pages")
def x15(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.short_authors(F.expr(_NAMES)).alias("authors"))


# ---------------------------------------------------------------- texts

_CUT = "substring(text, 1, CAST(list_max(list_filter(range(0, 61), lambda i: strlen(substring(text, 1, i)) <= 60)) AS BIGINT))"


@query("x10_truncated_bytes", f"SELECT doc_id, CASE WHEN strlen(text) > 60 THEN {_CUT} || '...' ELSE text END AS text FROM (SELECT doc_id, 'é日' || text AS text FROM documents)")
def x10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated_bytes(F.concat(F.lit("é日"), "text"), 60).alias("text"))


@query("x16_without_mentions", f"SELECT page_id, 'hi ' || {_PAGE} || ' x@y ,z' AS text FROM pages")
def x16(spark, sf_dir):
    given = F.expr(f"'@_user_' || {_PAGE} || ' hi ' || {_PAGE} || ' x@y @_all,@_user_z '")
    return table(spark, sf_dir, "pages").select("page_id", text.without_mentions(given).alias("text"))


_MATH = f"'a $x' || {_PAGE} || '$ b $$y' || chr(10) || '$z$$ c ' || chr(92) || '[q' || chr(92) || '] d ' || chr(92) || '(r' || chr(92) || ') $5'"


@query("x20_formulas", f"SELECT page_id, 't:a |m:x' || {_PAGE} || '|t: b |d:y' || chr(10) || '$z|t: c |d:q|t: d |m:r|t: $5' AS tokens FROM pages")
def x20(spark, sf_dir):
    kind = lambda t: F.when(t["display"], "d:").when(t["math"], "m:").otherwise("t:")
    tokens = F.transform(text.latex_tokens(F.expr(_MATH)), lambda t: F.concat(kind(t), t["content"]))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(tokens, "|").alias("tokens"))


_KEY = "substring('abcdefghijklmnop', 1, CAST(page_id % 13 AS INT))"


@query("x21_masked_keys", f"SELECT page_id, CASE WHEN page_id % 13 = 0 THEN '' WHEN page_id % 13 <= 8 THEN '••••' ELSE 'abcd••••' || right({_KEY}, 4) END AS masked, CASE WHEN page_id % 13 < 5 THEN '***' ELSE 'abcde' END AS prefix FROM pages")
def x21(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.masked(F.expr(_KEY)).alias("masked"), text.key_prefix(F.expr(_KEY)).alias("prefix"))


_MARKED = "lang || " + _cases("doc_id", ["''", "chr(92) || 'documentclass{a}'", "chr(92) || 'documentstyle'", "chr(92) || 'section{x}'", "' **b**'", "chr(10) || '1. x'", "'# x'", "' > q'", "chr(92) || 'title{x}'"])


@query("x23_text_kinds", "SELECT doc_id, doc_id % 9 IN (1, 3) AS tex, doc_id % 9 IN (1, 2) AS main, doc_id % 9 IN (4, 5, 7) AS markdown FROM documents")
def x23(spark, sf_dir):
    given = F.expr(_MARKED)
    return table(spark, sf_dir, "documents").select("doc_id", text.looks_like_tex(given).alias("tex"), text.looks_like_main_tex(given).alias("main"), text.has_markdown(given).alias("markdown"))


_ERROR = _cases("event_id", ["'code 99991663'", "'Invalid Access Token'", "'token invalid'", "'read: i/o timeout'", "'write: broken pipe'", "'EOF'", "NULL"])


@query("x24_error_kinds", "SELECT event_id, event_id % 7 IN (0, 1) AS token, event_id % 7 IN (3, 4) AS network FROM events")
def x24(spark, sf_dir):
    given = F.expr(_ERROR)
    return table(spark, sf_dir, "events").select("event_id", text.is_token_error(given).alias("token"), text.is_network_error(given).alias("network"))


# ---------------------------------------------------------------- references of papers

_HASH = "md5(id)"
_UUID = f"substring({_HASH}, 1, 8) || '-' || substring({_HASH}, 9, 4) || '-4' || substring({_HASH}, 14, 3) || '-8' || substring({_HASH}, 18, 3) || '-' || substring({_HASH}, 21, 12)"


@query("x18_session_ids", with_papers(f"SELECT id, {_UUID} AS session_id, substring({_HASH}, 1, 8) AS short FROM papers"))
def x18(spark, sf_dir):
    made = text.session_id(F.col("id"))
    return chat_papers(spark, sf_dir).select("id", made.alias("session_id"), text.short_ref(made).alias("short"))


@query("x22_paper_refs", f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'session-' || {_PAGE} WHEN 1 THEN {_PAGE} ELSE '' END AS ref FROM pages")
def x22(spark, sf_dir):
    session = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("session-"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, "")
    number = F.when(F.col("page_id") % 3 == 2, F.lit(0)).otherwise(F.col("page_id"))
    ref = text.short_ref(text.paper_ref(session, number))  # none is a session id of the usual form, so all are whole
    return table(spark, sf_dir, "pages").select("page_id", ref.alias("ref"))


@query(
    "j7_tool_results",
    """SELECT a.conv_id AS paper, 'c' || CAST(a.turn AS STRING) AS call_id, 'look_up' AS name, a.text AS arguments, b.text AS content
    FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'user' WHERE a.role = 'assistant'""",
)
def j7(spark, sf_dir):
    own = table(spark, sf_dir, "conversations")
    call = F.struct(F.concat(F.lit("c"), "turn").alias("id"), F.struct(F.lit("look_up").alias("name"), F.col("text").alias("arguments")).alias("function"))
    role = F.when(F.col("role") == "user", "tool").otherwise(F.col("role"))
    answered = F.concat(F.lit("c"), (F.col("turn") - 1).cast("string"))
    rows = own.select(
        F.col("conv_id").alias("paper"),
        role.alias("role"),
        F.when(F.col("role") == "assistant", F.array(call)).alias("tool_calls"),
        F.when(F.col("role") == "user", answered).alias("tool_call_id"),
        F.col("text").alias("content"),
    )
    return joins.tool_results(rows)


# ---------------------------------------------------------------- days and times

_LOG = _cases("o_orderkey", ["'app-' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '.log'", "'app-2024-13-45.log'", "'notes.log'"])


@query("k15_kept_logs", f"SELECT o_orderkey, {_LOG} AS name FROM orders WHERE o_orderkey % 3 <> 0 OR CAST(o_orderdate AS DATE) >= DATE '1996-01-01' - 30")
def k15(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_LOG).alias("name"))
    return logs.kept_days(names, F.lit("1996-01-01").cast("date"), 30)


@query(
    "c_next_runs",
    """SELECT event_id, CASE WHEN date_trunc('day', ts) + INTERVAL 510 MINUTE <= ts THEN date_trunc('day', ts) + INTERVAL 1950 MINUTE
    ELSE date_trunc('day', ts) + INTERVAL 510 MINUTE END AS due FROM events""",
)
def next_runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", calendar.next_run(F.col("ts"), F.lit("08:30")).alias("due"))


_AGO = "date_diff('day', CAST(ts AS DATE), (SELECT CAST(max(ts) AS DATE) - 2 FROM events))"


@query("c_relative_days", f"SELECT event_id, CASE WHEN {_AGO} <= 0 THEN 'today' WHEN {_AGO} = 1 THEN 'yesterday' WHEN {_AGO} < 7 THEN CAST({_AGO} AS STRING) || ' days ago' ELSE strftime(ts, '%Y-%m-%d') END AS shown FROM events")
def relative_days(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = events.agg(F.date_sub(F.max(F.to_date("ts")), 2)).first()[0]
    return events.select("event_id", calendar.relative_day(F.to_date("ts"), F.lit(last)).alias("shown"))


# ---------------------------------------------------------------- TeX

_B = "chr(92)"
_FORMULAS = f"{_PAGE} || ' let $' || {_B} || 'alpha^{{12}}$ and $x_{{1}} ' || {_B} || 'leq 7$ or $' || {_B} || 'unknown{{' || {_PAGE} || '}}$, $$' || {_B} || 'sum 7$$ $5'"


@query("l8_unicode_formulas", f"SELECT page_id, {_PAGE} || ' let α¹² and x₁ ≤ 7 or $' || {_B} || 'unknown{{' || {_PAGE} || '}}$, ∑ 7 $5' AS text FROM pages")
def l8(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tex.latex_to_unicode_udf(F.expr(_FORMULAS)).alias("text"))


_TEX = " || chr(10) || ".join(
    [
        f"{_B} || 'documentclass{{a}}'",
        f"{_B} || 'begin{{document}}'",
        f"'% left out ' || {_PAGE}",
        f"{_B} || 'section{{Part ' || {_PAGE} || '}}'",
        f"'Some ' || {_B} || 'textbf{{bold ' || {_PAGE} || '}} and ' || {_B} || 'emph{{it}} $x_7$.'",
        f"{_B} || 'begin{{itemize}}'",
        f"{_B} || 'item one ' || {_PAGE}",
        f"{_B} || 'item two'",
        f"{_B} || 'end{{itemize}}'",
        f"{_B} || 'end{{document}}'",
        "'rest'",
    ]
)


@query("l4_tex_markdown", f"SELECT page_id, '## Part ' || {_PAGE} || chr(10) || chr(10) || 'Some **bold ' || {_PAGE} || '** and *it* $x_7$.' || chr(10) || chr(10) || '- one ' || {_PAGE} || chr(10) || '- two' AS markdown FROM pages")
def l4(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tex.tex_to_markdown_udf(F.expr(_TEX)).alias("markdown"))
