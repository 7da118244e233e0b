"""The queries of this package, ``opN_<name>`` and ``pipeline``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.ann import nearest
from feedloom.llm.bpe import decode, encode
from feedloom.llm.decontaminate import benchmark_hits, contaminated
from feedloom.llm.fim import fill_in_middle, hash_groups, restored
from feedloom.llm.jaccard import jaccard_components
from feedloom.llm.linededup import ascii_lowered, deduplicated_lines
from feedloom.llm.lm import lm_scores
from feedloom.llm.merkle import folded, leaf_digest, manifest, proof_digest
from feedloom.llm.pii import pseudonymised
from feedloom.llm.secrets import secrets
from feedloom.llm.secrets import train as train_secrets
from feedloom.llm.tokencount import read_pieces, token_counts
from feedloom.llm.toxicity import held_out, toxicity, train
from feedloom.llm.urls import judged

#: The queries' key. A real run passes its own, from where it keeps its secrets.
PSEUDONYM_KEY = "a key for tests only"

URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"), width=3, percent=90)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(_read(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    scores = toxicity(docs, train(docs, labels.where(~held_out(F.col("doc_id")))))
    return scores.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode(ids, ranks).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = secrets(docs, train_secrets(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), width=13)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_read(spark, sf_dir, "pages"), URL_RULES)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), read_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicated_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), least_docs=3, least_chars=20)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, kind, order = hash_groups(F.col("doc_id"))
    cut = fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"), a, b, plain=kind % 100 >= 90, spm=order % 100 < 20)
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    leaf = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(ascii_lowered(F.col("text"))))
    leaves = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), altered.alias("altered"))
    proven = manifest(leaves, "source", ["doc_id"]).withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("proof")))
    return proven.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_nearest_neighbours": op2_nearest_neighbours,
        "op3_pii": op3_pii,
        "op4_toxicity": op4_toxicity,
        "op5_byte_level_bpe": op5_byte_level_bpe,
        "op6_secret_scans": op6_secret_scans,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_url_filters": op8_url_filters,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_token_counts": op10_token_counts,
        "op11_line_dedup": op11_line_dedup,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_merkle_manifest": op13_merkle_manifest,
        "pipeline": pipeline,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.component_id
FROM (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) d LEFT JOIN n USING (doc_id)
"""

_OP7_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 13, 0) + 2), lambda j: array_to_string(w[j:j + least(13, len(w)) - 1], ' '))) AS t FROM i WHERE len(w) > 0),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda j: array_to_string(w[j:j + n - 1], ' '))) AS t FROM d, (SELECT DISTINCT n FROM iw) k WHERE len(w) >= n),
h AS (SELECT doc_id, item_id, pos, dw.n AS n FROM dw JOIN iw USING (n, t)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS x FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS own FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(own, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


_OP11_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, coalesce(k.doc_id <> r.holder, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

_OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || doc_id) AS h FROM documents),
g AS (SELECT *, len(w) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def _op13_sql(levels: int = 6) -> str:
    """One step a level, so groups have up to ``16 ** levels`` nodes."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bit = "list_reduce([xor(c, b)] || range(8), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)"
    crc = f"xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: {bit}), 4294967295)"
    parts = [
        f"leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS start FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves)",
        "d0 AS (SELECT source AS k, place, leaf AS digest FROM placed)",
    ]
    for t in "dg":
        for i in range(levels):
            parts.append(f"{t}{i}s AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, list(digest) OVER (PARTITION BY k, place // 16 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ds FROM {t}{i})")
            parts.append(f"{t}{i + 1} AS (SELECT k, place // 16 AS place, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(array_to_string(any_value(ds), '')) END AS digest FROM {t}{i}s GROUP BY ALL)")
        if t == "d":
            parts.append(f"sources AS (SELECT k AS source, digest, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS place FROM d{levels})")
            parts.append("g0 AS (SELECT 0 AS k, place, digest FROM sources)")
    parts.append("xd0 AS (SELECT doc_id, source, leaf, source AS k, place, start AS d, '' AS proof FROM placed)")
    for t in "dg":
        for i in range(levels):
            left, right = "coalesce(array_to_string(ds[1:x.place % 16], ''), '')", "coalesce(array_to_string(ds[x.place % 16 + 2:], ''), '')"
            parts.append(f"x{t}{i + 1} AS (SELECT x.* EXCLUDE (place, d, proof), x.place // 16 AS place, CASE WHEN n = 1 THEN d ELSE sha256({left} || d || {right}) END AS d, CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof FROM x{t}{i} x JOIN {t}{i}s s ON x.k IS NOT DISTINCT FROM s.k AND x.place = s.place)")
        if t == "d":
            parts.append(f"xg0 AS (SELECT x.* EXCLUDE (k, place), s.digest AS subroot, s.place, 0 AS k FROM xd{levels} x JOIN sources s ON x.source IS NOT DISTINCT FROM s.source)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, d AS folded_root, d = r.digest AS verified FROM xg{levels} x, g{levels} r"


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the tests hold the others against brute force."""
    return {
        "op1_ngram_jaccard_join": _OP1_SQL,
        "op7_benchmark_decontamination": _OP7_SQL,
        "op11_line_dedup": _OP11_SQL,
        "op12_fill_in_middle": _OP12_SQL,
        "op13_merkle_manifest": _op13_sql(),
    }
