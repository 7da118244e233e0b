"""Queries of flows: chats, replies, deliveries, lookups and what is kept of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import fit
from feedloom.operators import logs, select
from feedloom.plans.catalog import query
from feedloom.plans.fixtures import articles, table, with_articles
from feedloom.sources import replies
from feedloom.sources.lookup import looked_up
from feedloom.streaming import memo
from feedloom.streaming.engine import folded_log
from feedloom.tables import new_path



def _echo(arguments: str) -> str:
    return f"echo: {arguments}"


#: Tools of the queries' chats.
CHAT_TOOLS = {"echo": _echo}


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as events of the chat engine.

    Each user turn asks. The assistant turn after it answers in chunks of a line each and tells its tokens; where
    there is none, the answer breaks off. A question of an even length calls a tool first, one that there is
    or not.
    """
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper"), "turn", "role", "text")
    asked = turns.where("role = 'user' and text <> ''").withColumn("round", F.expr("row_number() over (partition by paper order by turn)"))
    replies = turns.where("role = 'assistant'").select("paper", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rounds = asked.join(replies, ["paper", "turn"], "left").withColumn("size", F.length("text")).withColumn("calls", F.col("size") % 2 == 0)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)

    def event(**c):
        kinds = {"kind": "string", "reply": "string", "n": "int", "content": "string", "skip": "boolean", "call_id": "string", "call_type": "string", "call_name": "string", "arguments": "string", "prompt": "long", "completion": "long", "cached": "long"}
        return F.struct(*[c[k].cast(kinds[k]).alias(k) if k in c else none(kinds[k], k) for k in kinds])

    reply = lambda i: F.concat(F.col("round").cast("string"), F.lit(f".{i}"))
    final = F.when(F.col("calls"), reply(2)).otherwise(reply(1))
    lines = F.split("answer", "(?<=\n)", -1)
    name = F.when(F.col("size") % 4 == 0, "echo").otherwise("none")
    call = event(kind=F.lit("tool"), reply=reply(1), n=F.lit(1), call_id=F.concat(F.lit("call-"), F.col("round").cast("string")), call_type=F.lit("function"), call_name=name, arguments=F.substring("text", 1, 20))
    chunks = F.transform(lines, lambda x, i: event(kind=F.lit("text"), reply=final, n=i, content=x))
    done = event(kind=F.lit("done"), reply=final, n=F.size(lines), prompt=F.col("size"), completion=F.length("answer"), cached=F.lit(1))
    broken = F.array(event(kind=F.lit("text"), reply=final, n=F.lit(0), content=F.when(F.col("size") % 3 == 0, "").otherwise(F.lit("well, "))), event(kind=F.lit("error"), reply=final, n=F.lit(1), content=F.lit("reset")))
    every = F.concat(
        F.array(event(kind=F.lit("question"), content=F.col("text"), skip=F.col("size") < 60)),
        F.when(F.col("calls"), F.array(event(kind=F.lit("text"), reply=reply(1), n=F.lit(0), content=F.lit("Let me see. ")), call)).otherwise(F.array().cast(f"array<{_EVENT}>")),
        F.when(F.col("answer").isNull(), broken).otherwise(F.concat(chunks, F.array(done))),
    )
    rows = rounds.select("paper", "turn", F.posexplode(every).alias("i", "e"))
    return rows.select("paper", (F.col("turn") * 100_000 + F.col("i")).alias("at"), "e.*")


_EVENT = "struct<kind: string, reply: string, n: int, content: string, skip: boolean, call_id: string, call_type: string, call_name: string, arguments: string, prompt: bigint, completion: bigint, cached: bigint>"

_CHAT_SQL = r"""
WITH q AS (SELECT conv_id AS paper, turn, text, length(text) AS size, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS round FROM conversations WHERE role = 'user' AND text <> ''),
r AS (SELECT q.*, a.text AS answer, size % 2 = 0 AS calls FROM q LEFT JOIN conversations a ON a.conv_id = q.paper AND a.turn = q.turn + 1 AND a.role = 'assistant'),
t AS (SELECT *, CASE WHEN calls THEN 'Let me see. ' ELSE '' END || coalesce(answer, CASE WHEN size % 3 = 0 THEN '' ELSE 'well, ' END) AS said FROM r),
m AS (
  SELECT paper, round, 0 AS place, 'user' AS role, text AS content, 0 AS p, 0 AS c, 0 AS k, NULL AS call_name, NULL AS tool_call_id, size FROM t
  UNION ALL SELECT paper, round, 1, 'assistant', '', 0, 0, 0, CASE WHEN size % 4 = 0 THEN 'echo' ELSE 'none' END, NULL, size FROM t WHERE calls
  UNION ALL SELECT paper, round, 2, 'tool', CASE WHEN size % 4 = 0 THEN 'echo: ' || substring(text, 1, 20) ELSE 'Tool "none" is not available in this session.' END, 0, 0, 0, NULL, 'call-' || round, size FROM t WHERE calls
  UNION ALL SELECT paper, round, 3, 'assistant', said, CASE WHEN answer IS NULL THEN 0 ELSE size END, coalesce(length(answer), 0), CASE WHEN answer IS NULL THEN 0 ELSE 1 END, NULL, NULL, size FROM t WHERE answer IS NOT NULL OR said <> '')
SELECT paper, row_number() OVER w - 1 AS seq, round, role, content, strlen(content) // 4 AS token_count, p AS prompt_tokens, c AS completion_tokens, k AS cached_tokens, size < 60 AS skip_context, call_name, tool_call_id,
  coalesce(last_value(CASE WHEN p + c > 700 THEN greatest(1, round - 1) END IGNORE NULLS) OVER w, 0) AS anchor
FROM m WINDOW w AS (PARTITION BY paper ORDER BY round, place)
"""


@query("m6_chat_log", _CHAT_SQL)
def m6_chat_log(spark, sf_dir):
    log = folded_log(chat_events(spark, sf_dir), CHAT_TOOLS, budget=700)
    return log.select("paper", "seq", "round", "role", "content", "token_count", "prompt_tokens", "completion_tokens", "cached_tokens", "skip_context", "call_name", "tool_call_id", "anchor")


def reply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns of ``conversations`` as the lines of streamed replies, ``reply, seq, line``.

    A chunk for each line of text; where the length is even, a call in three deltas instead; then the usage, the
    terminator (not where the length divides by seven) and a late chunk. Every third line is noise.
    """
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat_ws("/", "conv_id", "turn").alias("reply"), "text", F.length("text").alias("size"))
    data = lambda x: F.concat(F.lit("data: "), x)
    delta = lambda **c: data(F.to_json(F.struct(F.array(F.struct(F.struct(*[v.alias(k) for k, v in c.items()]).alias("delta"))).alias("choices"))))
    call = lambda **c: delta(tool_calls=F.array(F.struct(F.lit(0).alias("index"), *[v.alias(k) for k, v in c.items()])))
    half = F.floor(F.col("size") / 2).cast("int")
    part = lambda a, n: call(function=F.struct(F.substring("text", a, n).alias("arguments")))
    calls = F.array(call(id=F.concat(F.lit("call-"), "reply"), type=F.lit("function"), function=F.struct(F.lit("look").alias("name"), F.lit("").alias("arguments"))), part(F.lit(1), half), part(half + 1, F.col("size")))
    usage = data(F.to_json(F.struct(F.array().cast("array<string>").alias("choices"), F.struct(F.col("size").alias("prompt_tokens"), half.alias("completion_tokens"), (F.col("size") + half).alias("total_tokens"), F.struct(F.lit(2).alias("cached_tokens")).alias("prompt_tokens_details")).alias("usage"))))
    chunks = F.transform(F.split("text", "(?<=\n)", -1), lambda x: delta(role=F.lit("assistant"), content=x))
    late = F.array(F.when(F.col("size") % 7 != 0, F.lit("data: [DONE]")).otherwise(": no end"), F.when(F.col("size") % 7 != 0, delta(content=F.lit("late"))).otherwise(F.lit("data: {")))
    noisy = F.flatten(F.transform(F.concat(F.when(F.col("size") % 2 == 0, calls).otherwise(chunks), F.array(usage), late), lambda x, i: F.when(i % 3 == 0, F.array(F.lit(": ping"), x)).otherwise(F.array(x))))
    return turns.select("reply", F.posexplode(noisy).alias("seq", "line"))


_TURNS = "SELECT conv_id || '/' || turn AS reply, text, length(text) AS size FROM conversations WHERE role = 'assistant'"


@query("s13_streamed_replies", f"SELECT reply, CASE WHEN size % 2 = 0 THEN '' ELSE text END AS content, size % 7 <> 0 AS done, size AS prompt, size // 2 AS completion, size + size // 2 AS total, 2 AS cached FROM ({_TURNS})")
def s13_streamed_replies(spark, sf_dir):
    return replies.completed(replies.parsed_chunks(reply_lines(spark, sf_dir)))


@query("s13_streamed_calls", f"SELECT reply, 0 AS \"index\", 'call-' || reply AS id, 'function' AS type, 'look' AS name, text AS arguments FROM ({_TURNS}) WHERE size % 2 = 0 AND size % 7 <> 0")
def s13_streamed_calls(spark, sf_dir):
    return replies.completed_calls(replies.parsed_chunks(reply_lines(spark, sf_dir)))


def _hf_votes(id_: str) -> int:
    if id_.endswith("3"):
        raise OSError("not found")
    return len(id_) % 7


def _ax_votes(id_: str) -> int:
    return int(id_) % 11 - 3


#: Lookups of the queries: they give what a service would, and fail for some.
VOTES = {"hf_upvotes": _hf_votes, "ax_net_votes": _ax_votes}


@query("m9_looked_up_votes", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 10 <> 3 THEN length(CAST(doc_id AS VARCHAR)) % 7 END AS hf_upvotes, doc_id % 11 - 3 AS ax_net_votes FROM documents")
def m9_looked_up_votes(spark, sf_dir):
    return looked_up(articles(spark, sf_dir), VOTES, per_second=1e6, tasks=5)


_ANEW_SQL = """
WITH RECURSIVE e AS (SELECT user_id AS key, ts FROM events),
f AS (SELECT key, min(ts) AS ts FROM e GROUP BY key
  UNION ALL SELECT f.key, (SELECT min(e.ts) FROM e WHERE e.key = f.key AND e.ts >= f.ts + INTERVAL 24 HOURS) AS ts FROM f WHERE f.ts IS NOT NULL),
n AS (SELECT e.*, row_number() OVER (PARTITION BY key, ts) AS k FROM e)
SELECT n.key, n.ts, f.ts IS NOT NULL AND k = 1 AS fresh FROM n LEFT JOIN f ON f.key = n.key AND f.ts = n.ts
"""


@query("m10_asked_anew", _ANEW_SQL)
def m10_asked_anew(spark, sf_dir):
    """Users of ``events`` as keys that are asked for at the time of each event."""
    asks = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return memo.asked_anew(asks).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_MARKED = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, list_transform(w, lambda l, i: CASE WHEN i % 9 IN (4, 5) THEN '| ' || substring(l, 1, 8) || ' | b | c | d | e |' WHEN i % 13 = 6 THEN '```' WHEN i % 17 = 3 THEN l || ' $x' WHEN i % 6 = 2 THEN ' ' ELSE l END) AS w FROM d)
"""

_FIT_SQL = (
    _MARKED
    + r"""
, l AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, len(w) AS n, unnest(w) AS line FROM x),
o AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS own FROM l),
b AS (SELECT *, strlen(line) + 1 AS size, own LIKE '```%' AS fence, length(own) > 1 AND own LIKE '|%' AND own LIKE '%|' AS bar, regexp_matches(line, '^\s*\|.*\|\s*$') AS shown, length(own) - length(replace(own, '|', '')) AS bars, length(own) - length(replace(own, '$', '')) AS dollars FROM o),
c AS (SELECT *, sum(fence::INT) OVER w % 2 = 1 AS code, (sum(fence::INT) OVER w - fence::INT) % 2 = 1 AS before, shown AND NOT coalesce(lag(shown) OVER w, false) AS begins FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT *, sum(size) OVER w AS stop, sum(CASE WHEN own = '' THEN 0 WHEN bar AND NOT before THEN (bars - 1) // 4 + 1 ELSE 1 END) OVER w AS elements, sum(begins::INT) OVER w AS tables, sum((NOT code AND dollars % 2 = 1)::INT) OVER w % 2 = 1 AS math FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, elements <= 30 AND tables <= 3 AS counted, elements <= 30 AND tables <= 3 AND stop <= 2000 AS fits FROM s),
k AS (SELECT *, fits AND NOT code AND NOT bar AND NOT math AS safe, bool_and(fits) OVER (PARTITION BY doc_id ORDER BY i) AS so_far FROM f),
g AS (SELECT doc_id, bool_and(CASE WHEN i = n THEN counted AND stop - 1 <= 2000 ELSE fits END) AS whole, max(stop) FILTER (safe AND own = '') AS blank, max(stop) FILTER (safe) AS safe,
  max(stop) FILTER (fits) AS fit, count(*) FILTER (so_far) + 1 AS next FROM k GROUP BY doc_id),
t AS (SELECT doc_id, array_to_string(w, chr(10)) AS text FROM x)
SELECT doc_id, CASE WHEN whole THEN strlen(text) WHEN blank IS NOT NULL OR safe IS NOT NULL THEN coalesce(blank, safe)
  WHEN (SELECT counted AND stop > 2000 FROM k WHERE k.doc_id = g.doc_id AND i = next) THEN 2000 ELSE coalesce(fit, 0) END AS cut_bytes, whole, sha256(text) AS text_sha256
FROM t JOIN g USING (doc_id)
"""
)


@query("fit_markdown", _FIT_SQL)
def fit_markdown(spark, sf_dir):
    """Where documents with tables, fences and formulas put into some of their lines are cut; a cut within a line
    counts as the most bytes. Part and rest must give the text."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    row = lambda l: F.concat(F.lit("| "), F.substring(l, 1, 8), F.lit(" | b | c | d | e |"))
    mark = lambda l, i: F.when(i % 9 == 4, row(l)).when(i % 9 == 5, row(l)).when(i % 13 == 6, "```").when(i % 17 == 3, F.concat(l, F.lit(" $x"))).when(i % 6 == 2, " ").otherwise(l)
    marked = docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), lambda l, i: mark(l, i + 1)), "\n").alias("text"))
    cut = marked.withColumn("x", fit.fitted(F.col("text"), 2000, 30, 3))
    size, none = F.octet_length("x.part"), F.col("x.part") == fit.TOO_LONG
    within = ~F.endswith("x.part", F.lit("\n")) & (F.col("x.rest") != "") & ~none
    return cut.select("doc_id", F.when(none, 0).when(within, 2000).otherwise(size).cast("long").alias("cut_bytes"), (F.col("x.rest") == "").alias("whole"), F.sha2(F.when(none, F.col("x.rest")).otherwise(F.concat("x.part", "x.rest")), 256).alias("text_sha256"))


@query(
    "f9_keyword_table",
    with_articles("""SELECT id, title FROM articles a WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT lower(trim(array_to_string(string_split(text, ' ')[2:4], ' '))) AS k FROM benchmark) b
  WHERE k <> '' AND (contains(lower(coalesce(title, '')), k) OR contains(lower(coalesce(abstract, '')), k)))"""),
)
def f9_keyword_table(spark, sf_dir):
    """Articles in which no second to fourth word of a benchmark item occurs."""
    words = table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 2, 3), " ").alias("keyword"))
    return select.without_keyword_table(articles(spark, sf_dir), words).select("id", "title")


@query("k15_kept_lines", "SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) - 7 FROM events)")
def k15_kept_lines(spark, sf_dir):
    """``events`` as a log by day, of which only the last eight days are left."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("line"))
    path, today = new_path(spark, "log"), events.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]
    logs.write_daily(events, path)
    logs.without_old_days(spark, path, today, 7)
    return logs.kept_lines(spark.read.parquet(path), F.lit(today).cast("date"), 7).select("event_id", "day")
