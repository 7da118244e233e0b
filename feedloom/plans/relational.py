"""General relational and event-time queries over the star schema. They use built-in operators only."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.operators import joins
from feedloom.plans.catalog import query
from feedloom.plans.fixtures import table



def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query(
    "q1_pricing",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc,
    avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def q1(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.sum("l_extendedprice").alias("sum_base"),
        F.sum(_revenue()).alias("sum_disc"),
        F.avg("l_quantity").alias("avg_qty"),
        F.avg("l_discount").alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "q3_orders",
    """SELECT o_orderkey, o_orderdate, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2 ORDER BY revenue DESC, o_orderkey LIMIT 10""",
)
def q3(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = c.join(o, c.c_custkey == o.o_custkey).join(li, li.l_orderkey == o.o_orderkey)
    return rows.groupBy("o_orderkey", "o_orderdate").agg(F.sum(_revenue()).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query(
    "q5_regions",
    """SELECT r_name, n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""",
)
def q5(spark, sf_dir):
    c, o, li, s, n, r = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "supplier", "nation", "region"))
    rows = c.join(o, c.c_custkey == o.o_custkey).join(li, li.l_orderkey == o.o_orderkey)
    rows = rows.join(s, (li.l_suppkey == s.s_suppkey) & (s.s_nationkey == c.c_nationkey)).join(n, n.n_nationkey == s.s_nationkey).join(r, r.r_regionkey == n.n_regionkey)
    return rows.groupBy("r_name", "n_name").agg(F.sum(_revenue()).alias("revenue"))


@query("q6_forecast", "SELECT sum(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24")
def q6(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_discount between 0.02 and 0.06 and l_quantity < 24").agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"))


@query("s_left_join_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")), "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("s_full_join", "SELECT coalesce(l.doc_id, p.page_id) AS id, quality, length(url) AS n FROM labels l FULL JOIN pages p ON l.doc_id = p.page_id")
def full(spark, sf_dir):
    a, b = table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages")
    return a.join(b, a.doc_id == b.page_id, "full").select(F.coalesce("doc_id", "page_id").alias("id"), "quality", F.length("url").alias("n"))


@query("s_semi_anti", "SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS having_orders, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without")
def semi(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_custkey").distinct()
    flagged = c.join(o, c.c_custkey == o.o_custkey, "left")
    return flagged.agg(F.count("o_custkey").alias("having_orders"), F.count_if(F.col("o_custkey").isNull()).alias("without"))


@query(
    "s_as_of_join",
    """SELECT e.event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS last_purchase FROM events e""",
)
def as_of(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.select("user_id", "ts", "event_id")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("last_purchase"))
    return joins.as_of(left, right, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("s_range_join", "SELECT p_partkey, b.low FROM part, (SELECT DISTINCT floor(s_acctbal / 100) * 100 AS low FROM supplier) b WHERE p_retailprice >= b.low AND p_retailprice < b.low + 150")
def ranges(spark, sf_dir):
    low = table(spark, sf_dir, "supplier").select((F.floor(F.col("s_acctbal") / 100) * 100).cast("double").alias("low")).distinct()
    return joins.in_ranges(table(spark, sf_dir, "part"), low.withColumn("high", F.col("low") + 150), "p_retailprice", "low", "high", 100).select("p_partkey", "low")


@query("s_cube", "SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY CUBE (lang, source)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("s_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("s_grouping_sets", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))


@query("s_distinct_counts", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("s_approx_distinct")
def approx(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("orders"))


@query("s_rank_top3", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def rank(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "s_lag_lead_ntile",
    """SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, ntile(4) OVER w AS quarter, sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def lag(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"), F.sum("value").over(w.rowsBetween(-2, 0)).alias("last3"))


@query("s_range_frame", "SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate) RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW) AS month FROM orders")
def frame(spark, sf_dir):
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    w = Window.partitionBy("o_custkey").orderBy("at").rangeBetween(-2_592_000, 0)
    return table(spark, sf_dir, "orders").withColumn("at", at).select("o_orderkey", F.sum("o_totalprice").over(w).alias("month"))


@query("s_intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def intersect(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).intersect(table(spark, sf_dir, "customer").select("c_nationkey"))


@query("s_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("s_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("s_json_props", "SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))
