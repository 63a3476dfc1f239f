"""Registered queries: the SQL surface (SQL-*) and relational categories (REL-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.functions import sqltext as S
from sparktab.operators import retrieval as R
from sparktab.operators.sequence import ordered_text
from sparktab.plans import views as V
from sparktab.plans.registry import register
from sparktab.sources import catalog as CAT


def _sql(spark, sf, text: str, tables=None) -> DataFrame:
    import re
    used = tables or [t for t in CAT.TABLES if re.search(rf"\b{t}\b", text)]
    CAT.register_tables(spark, sf, used)
    return spark.sql(text)


# ------------------------------------------------------------------ SQL-01..04
_USER_QUERY = ("  select o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue "
               "from orders group by o_orderpriority order by o_orderpriority")


@register("sql_01_run_guarded_select", sql="""
SELECT o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 100""")
def sql_01(spark, sf):
    """A user SELECT through the guard (SELECT only, fences/EXPLAIN removed,
    LIMIT 100 appended when absent) and run by spark.sql over the catalog."""
    return CAT.run_user_query(spark, sf, _USER_QUERY, limit=100)


@register("sql_01_result_shape", sql="""
SELECT count(*) AS row_count, 3 AS column_count FROM (
  SELECT o_orderpriority, count(*) AS n_orders FROM orders GROUP BY o_orderpriority LIMIT 100)""")
def sql_01_shape(spark, sf):
    df = CAT.run_user_query(spark, sf, _USER_QUERY, limit=100)
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count"))


_UNION_SQL = ("replace(regexp_replace(regexp_replace(sql_text, '(?i)\\bUNION(\\s+ALL)', 'UNION_QQ_\\1', 'g'), "
              "'(?i)\\bUNION\\b', 'UNION ALL', 'g'), 'UNION_QQ_', 'UNION')")


@register("sql_02_07_query_log_audit", sql=V.with_views("query_log") + f"""
, s AS (SELECT q_id, sql_text, regexp_replace(replace(replace(sql_text, '```sql', ''), '```', ''), '^\\s+|\\s+$', '', 'g') AS s0 FROM query_log)
SELECT q_id,
  starts_with(upper(regexp_replace(sql_text, '^\\s+', '')), 'SELECT') AS is_select,
  starts_with(upper(regexp_replace(sql_text, '^\\s+', '')), 'SELECT') OR starts_with(upper(regexp_replace(sql_text, '^\\s+', '')), 'WITH') AS is_select_or_with,
  contains(lower(sql_text), 'limit') AS has_limit_substring,
  regexp_matches(lower(sql_text), '\\blimit\\b') AS has_limit_word,
  CASE WHEN contains(lower(sql_text), 'limit') THEN sql_text ELSE sql_text || ' LIMIT 100' END AS limited_text,
  CASE WHEN starts_with(upper(s0), 'EXPLAIN') THEN regexp_replace(substr(s0, 8), '^\\s+|\\s+$', '', 'g') ELSE s0 END AS stripped_text,
  regexp_replace(regexp_replace(sql_text, '(?i)\\bactive\\s*=\\s*1\\b', 'active = true', 'g'), '(?i)\\bactive\\s*=\\s*0\\b', 'active = false', 'g') AS active_linted,
  {_UNION_SQL} AS union_linted,
  regexp_matches(sql_text, '(?i)NOT\\s+IN\\s*\\(.*NULL.*\\)') AS not_in_null
FROM s""")
def sql_02_07(spark, sf):
    """Guard, limit, strip and lint rules as one projection over a query log."""
    q = V.query_log(V.tables(spark, sf).orders)
    t = F.col("sql_text")
    return q.select("q_id", S.is_select(t).alias("is_select"), S.is_select(t, True).alias("is_select_or_with"),
                    S.has_limit(t).alias("has_limit_substring"), S.has_limit(t, word=True).alias("has_limit_word"),
                    S.add_limit(t).alias("limited_text"), S.strip_fences_explain(t).alias("stripped_text"),
                    S.lint_active(t).alias("active_linted"), S.lint_union_all(t).alias("union_linted"),
                    S.flags_not_in_null(t).alias("not_in_null"))


@register("sql_09_json_safe_projection", sql="""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS o_totalprice
FROM orders""")
def sql_09(spark, sf):
    o = V.tables(spark, sf).orders.select("o_orderkey", "o_orderdate",
                                          F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"))
    return CAT.json_safe(o)


@register("sql_10_extract_sql_blocks", sql=V.with_views("agent_messages") + """
, b AS (SELECT job_id, seq, CASE WHEN regexp_matches(content, '(?s)```sql\\n(.*?)\\n```')
               THEN regexp_replace(regexp_extract(content, '(?s)```sql\\n(.*?)\\n```', 1), '^\\s+|\\s+$', '', 'g') END AS q,
               CAST(regexp_extract(content, 'rows: (\\d+)', 1) AS BIGINT) AS n_rows FROM agent_messages)
SELECT job_id, arg_max(q, seq) AS kept_query, arg_max(q, seq) FILTER (WHERE n_rows > 0) AS data_query
FROM b WHERE q IS NOT NULL AND q <> '' GROUP BY job_id""")
def sql_10(spark, sf):
    """Per conversation: the last SQL block, and the last block that returned rows."""
    m = V.agent_messages(V.tables(spark, sf).conversations)
    b = m.select("job_id", "seq", S.sql_block(F.col("content")).alias("q"),
                 F.regexp_extract("content", r"rows: (\d+)", 1).try_cast("bigint").alias("n_rows"))
    b = b.where(F.col("q").isNotNull() & (F.col("q") != ""))
    return b.groupBy("job_id").agg(F.max_by("q", "seq").alias("kept_query"),
                                   F.max_by("q", F.when(F.col("n_rows") > 0, F.col("seq"))).alias("data_query"))


def _printed(orders: DataFrame) -> DataFrame:
    """Printed result rows as a driver would echo them (from orders)."""
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    dt = F.when(F.pmod(k, F.lit(2)) == 0,
                F.concat(F.lit("datetime.datetime("), F.year(d).cast("string"), F.lit(", "), F.month(d).cast("string"),
                         F.lit(", "), F.dayofmonth(d).cast("string"), F.lit(")"))).otherwise(
        F.concat(F.lit("datetime.datetime("), F.year(d).cast("string"), F.lit(", "), F.month(d).cast("string"),
                 F.lit(", "), F.dayofmonth(d).cast("string"), F.lit(", "), F.pmod(k, F.lit(24)).cast("string"),
                 F.lit(", "), F.pmod(k, F.lit(60)).cast("string"), F.lit(")")))
    txt = F.concat(F.lit("[("), k.cast("string"), F.lit(", "), dt, F.lit(", Decimal('"),
                   F.format_string("%.2f", F.col("o_totalprice")), F.lit("'), '"), F.col("o_orderstatus"), F.lit("')]"))
    return orders.select(k.alias("row_id"), txt.alias("printed"))


_PRINTED_SQL = """printed AS (SELECT o_orderkey AS row_id, '[(' || CAST(o_orderkey AS VARCHAR) || ', ' ||
  CASE WHEN o_orderkey % 2 = 0 THEN 'datetime.datetime(' || CAST(year(o_orderdate) AS VARCHAR) || ', ' || CAST(month(o_orderdate) AS VARCHAR) || ', ' || CAST(day(o_orderdate) AS VARCHAR) || ')'
       ELSE 'datetime.datetime(' || CAST(year(o_orderdate) AS VARCHAR) || ', ' || CAST(month(o_orderdate) AS VARCHAR) || ', ' || CAST(day(o_orderdate) AS VARCHAR)
            || ', ' || CAST(o_orderkey % 24 AS VARCHAR) || ', ' || CAST(o_orderkey % 60 AS VARCHAR) || ')' END
  || ', Decimal(''' || printf('%.2f', o_totalprice) || '''), ''' || o_orderstatus || ''')]' AS printed FROM orders)"""
@register("sql_11_normalise_literals", sql="WITH " + _PRINTED_SQL + """
, parts AS (SELECT row_id, printed,
    regexp_extract(printed, 'datetime\\.datetime\\((\\d+),\\s*(\\d+),\\s*(\\d+)(?:,\\s*(\\d+),\\s*(\\d+)(?:,\\s*(\\d+))?)?\\)', ['y','m','d','hh','mi','ss']) AS g,
    regexp_extract(printed, '^(.*?)datetime\\.datetime\\(', 1) AS pre,
    regexp_extract(printed, 'datetime\\.datetime\\([^)]*\\)(.*)$', 1) AS post FROM printed)
SELECT row_id, regexp_replace(pre || '''' || g.y || '-' || lpad(g.m, 2, '0') || '-' || lpad(g.d, 2, '0') || 'T'
    || lpad(CASE WHEN g.hh = '' THEN '0' ELSE g.hh END, 2, '0') || ':' || lpad(CASE WHEN g.mi = '' THEN '0' ELSE g.mi END, 2, '0') || ':'
    || lpad(CASE WHEN g.ss = '' THEN '0' ELSE g.ss END, 2, '0') || '''' || post, 'Decimal\\(''([^'']+)''\\)', '''\\1''', 'g') AS normalised
FROM parts""")
def sql_11(spark, sf):
    p = _printed(V.tables(spark, sf).orders)
    return p.select("row_id", S.normalise_literals(F.col("printed")).alias("normalised"))


@register("sql_12_numeric_promotion", sql="""
WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS c_key, printf('%.2f', o_totalprice) AS c_amount,
                  CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS c_cust, o_orderstatus AS c_status FROM orders)
SELECT * FROM (
  SELECT 'c_key' AS column_name, count(*) FILTER (WHERE regexp_full_match(c_key, '\\d+\\.?\\d*')) > 0
      AND count(try_cast(c_key AS DOUBLE)) = count(c_key) AS promoted FROM t
  UNION ALL SELECT 'c_amount', count(*) FILTER (WHERE regexp_full_match(c_amount, '\\d+\\.?\\d*')) > 0
      AND count(try_cast(c_amount AS DOUBLE)) = count(c_amount) FROM t
  UNION ALL SELECT 'c_cust', count(*) FILTER (WHERE regexp_full_match(c_cust, '\\d+\\.?\\d*')) > 0
      AND count(try_cast(c_cust AS DOUBLE)) = count(c_cust) FROM t
  UNION ALL SELECT 'c_status', count(*) FILTER (WHERE regexp_full_match(c_status, '\\d+\\.?\\d*')) > 0
      AND count(try_cast(c_status AS DOUBLE)) = count(c_status) FROM t)""")
def sql_12(spark, sf):
    """A text column with a numeric-looking value is promoted only when every value casts."""
    return CAT.numeric_promotion_plan(_texts(spark, sf))


def _texts(spark, sf):
    o = V.tables(spark, sf).orders
    return o.select(F.col("o_orderkey").cast("string").alias("c_key"), F.format_string("%.2f", "o_totalprice").alias("c_amount"),
                    F.when(F.pmod("o_orderkey", F.lit(97)) == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")).alias("c_cust"),
                    F.col("o_orderstatus").alias("c_status"))


@register("sql_12_promoted_frame", sql="""
SELECT CAST(o_orderkey AS DOUBLE) AS c_key, CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS c_amount,
  CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS c_cust,
  o_orderstatus AS c_status FROM orders""")
def sql_12_promoted(spark, sf):
    """The frame itself after promotion: two columns become numbers, one keeps its texts, as some are no numbers."""
    t = _texts(spark, sf)
    return CAT.promote_numeric(t, CAT.numeric_promotion_plan(t))


@register("sql_13_example_index_refresh", sql="""
SELECT (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 0)) AS added,
       (SELECT count(*) FROM embeddings WHERE label = 0) + (SELECT count(*) FROM embeddings WHERE label <> 0) AS index_size""")
def sql_13(spark, sf):
    e = V.tables(spark, sf).embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")
    indexed = e.where(F.col("label") == 0)
    new, idx = R.refresh_index(indexed, e, "id")
    from sparktab.operators.sequence import one_row
    size = one_row(idx.agg(F.count(F.lit(1)).alias("n")))["n"]
    return new.agg(F.count(F.lit(1)).alias("added"), F.first(size).alias("index_size"))


@register("sql_14_nearest_examples", sql="""
WITH q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0),
     s AS (SELECT vec_id AS sid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
     d AS (SELECT qid, sid, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - s.v[i]) * (q.v[i] - s.v[i])), lambda acc, x: acc + x) AS distance FROM q, s)
SELECT qid, sid, round(distance, 6) AS distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, sid) AS rank FROM d) WHERE rank <= 5""")
def sql_14(spark, sf):
    e = V.tables(spark, sf).embeddings
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    s = e.select(F.col("vec_id").alias("sid"), "embedding")
    r = R.nearest(q, s, k=5)
    return r.withColumn("distance", F.round("distance", 6))


@register("sql_16_error_flag", sql=V.with_views("exec_logs") + """
SELECT contains(lower(output), 'error') AS error_flag, count(*) AS n FROM exec_logs GROUP BY 1""")
def sql_16(spark, sf):
    lg = V.exec_logs(V.tables(spark, sf).events)
    return lg.groupBy(S.error_flag(F.col("output")).alias("error_flag")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ REL-*
REL = {
    "rel_01_equi_joins": """
SELECT 'inner' AS join_type, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'
UNION ALL SELECT 'left', count(*) FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON o.o_custkey = c.c_custkey
UNION ALL SELECT 'right', count(*) FROM orders o RIGHT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON o.o_custkey = c.c_custkey
UNION ALL SELECT 'full', count(*) FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o
  FULL OUTER JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON o.o_custkey = c.c_custkey""",
    "rel_02_semi_anti_joins": """
SELECT (SELECT count(*) FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)) AS with_orders,
       (SELECT count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)) AS without_orders""",
    "rel_07_group_count_distinct": """
SELECT o_orderpriority, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers,
       round(sum(o_totalprice), 2) AS revenue, max(o_totalprice) AS max_price
FROM orders GROUP BY o_orderpriority""",
    "rel_08_rollup_cube": """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n, grouping(l_returnflag) AS g_flag, grouping(l_linestatus) AS g_status
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "rel_08_grouping_sets": """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
    "rel_09_window_functions": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS price_rank,
  round(sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_price,
  count(*) OVER (PARTITION BY l_orderkey) AS lines_in_order,
  lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS prev_qty
FROM lineitem""",
    "rel_10_topk": """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
    "rel_10_offset": """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10""",
    "rel_11_set_operations": """
SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'union_all', count(*) FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'except', count(*) FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""",
    "rel_12_subquery_cte": """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT c_mktsegment, count(*) AS big_spenders FROM customer c JOIN spend s ON c.c_custkey = s.o_custkey
WHERE s.total > (SELECT avg(total) FROM spend) AND c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)
GROUP BY c_mktsegment""",
    "rel_13_distinct_duplicates": """
SELECT (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) AS distinct_rows,
       (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) AS duplicate_rows""",
}

# DuckDB spelling where it differs from Spark SQL
REL_DUCK = {}


def _rel(name, text):
    @register(name, sql=REL_DUCK.get(name, text))
    def build(spark, sf):
        return _sql(spark, sf, text)
    build.__name__ = name
    return build


for _n, _t in REL.items():
    _rel(_n, _t)


@register("rel_03_or_join_rewrite", sql=V.with_views("jobs") + """
SELECT p.id AS parent_id, count(*) AS versions FROM jobs p JOIN jobs j ON j.id = p.id OR j.parent_job_id = p.id
WHERE p.is_parent GROUP BY p.id""")
def rel_03(spark, sf):
    """`j.id = p OR j.parent_job_id = p` as an equi-join on coalesce(parent, id)."""
    j = V.jobs(V.tables(spark, sf).orders)
    # counted per family before the join, so a large family is one row of it
    fam = j.groupBy(F.coalesce("parent_job_id", "id").alias("parent_id")).agg(F.count(F.lit(1)).alias("versions"))
    return j.where("is_parent").select(F.col("id").alias("parent_id")).join(fam, "parent_id")


@register("rel_04_correlated_lookup_as_join", sql=V.with_views("jobs", "agent_statistics") + """
SELECT j.id AS job_id, string_agg(s.agent_name || '=' || CAST(s.calls_count AS VARCHAR), ',' ORDER BY s.agent_name) AS stats
FROM jobs j JOIN agent_statistics s ON j.id = s.job_id GROUP BY j.id""")
def rel_04(spark, sf):
    """One statistics query per version (N+1) replaced by one join and aggregation."""
    t = V.tables(spark, sf)
    j = V.jobs(t.orders).select(F.col("id").alias("job_id"))
    s = V.agent_statistics(t.conversations)
    r = j.join(s, "job_id")
    return r.groupBy("job_id").agg(F.concat_ws(",", F.array_sort(F.collect_list(
        F.concat(F.col("agent_name"), F.lit("="), F.col("calls_count").cast("string"))))).alias("stats"))


@register("rel_05_keyed_not_positional", dates=["d"], sql=V.with_views("daily") + """
SELECT a.d, a.value AS actual, p.value AS predicted FROM daily a
JOIN (SELECT d + INTERVAL 7 DAY AS d, value FROM daily) p ON CAST(p.d AS DATE) = a.d""")
def rel_05(spark, sf):
    """Predictions aligned with actuals by key, never by row position."""
    d = V.daily(V.tables(spark, sf).orders)
    p = d.select(F.date_add("d", 7).alias("d"), F.col("value").alias("predicted"))
    return d.select("d", F.col("value").alias("actual")).join(p, "d")


@register("rel_14_text_aggregate", sql="""
SELECT r.r_name, string_agg(n.n_name, ',' ORDER BY n.n_name) AS nations FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey
GROUP BY r.r_name""")
def rel_14(spark, sf):
    return _sql(spark, sf, """
SELECT r.r_name, listagg(n.n_name, ',') WITHIN GROUP (ORDER BY n.n_name) AS nations
FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name""")


@register("rel_14_text_aggregate_chunked", sql="""
SELECT o_orderpriority, count(*) AS n, sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey::VARCHAR)) AS keys_sha256
FROM orders GROUP BY o_orderpriority""")
def rel_14_chunked(spark, sf):
    """All order keys of a priority in date order: five groups, each a fifth of
    the rows, joined in steps of a bounded number of rows."""
    o = V.tables(spark, sf).orders.select("o_orderpriority", "o_orderdate", F.col("o_orderkey").cast("string").alias("key"))
    d = ordered_text(o, ["o_orderpriority"], ["o_orderdate"], "key", ",", "keys")
    return d.select("o_orderpriority", "n", F.sha2(F.col("keys").cast("binary"), 256).alias("keys_sha256"))


def _ql(spark, sf):
    return V.query_log(V.tables(spark, sf).orders)


@register("sql_03_safety_limit", sql=V.with_views("query_log") + """
SELECT q_id, contains(lower(sql_text), 'limit') AS has_limit,
  CASE WHEN contains(lower(sql_text), 'limit') THEN sql_text ELSE sql_text || ' LIMIT 100' END AS limited_text
FROM query_log""")
def sql_03(spark, sf):
    """LIMIT 100 appended when the text has no 'limit' (substring rule)."""
    t = F.col("sql_text")
    return _ql(spark, sf).select("q_id", S.has_limit(t).alias("has_limit"), S.add_limit(t, 100).alias("limited_text"))


@register("sql_04_strip_fences_explain", sql=V.with_views("query_log") + """
, s AS (SELECT q_id, regexp_replace(replace(replace(sql_text, '```sql', ''), '```', ''), '^\\s+|\\s+$', '', 'g') AS s0 FROM query_log)
SELECT q_id, CASE WHEN starts_with(upper(s0), 'EXPLAIN') THEN regexp_replace(substr(s0, 8), '^\\s+|\\s+$', '', 'g') ELSE s0 END AS stripped_text
FROM s""")
def sql_04(spark, sf):
    return _ql(spark, sf).select("q_id", S.strip_fences_explain(F.col("sql_text")).alias("stripped_text"))


@register("sql_05_lint_active_flag", sql=V.with_views("query_log") + """
SELECT q_id, regexp_replace(regexp_replace(sql_text, '(?i)\\bactive\\s*=\\s*1\\b', 'active = true', 'g'),
                            '(?i)\\bactive\\s*=\\s*0\\b', 'active = false', 'g') AS linted
FROM query_log""")
def sql_05(spark, sf):
    """active = 1/0 -> true/false; texts without it pass unchanged."""
    return _ql(spark, sf).select("q_id", S.lint_active(F.col("sql_text")).alias("linted"))


@register("sql_06_lint_union_all", sql=V.with_views("query_log") + f"""
SELECT q_id, {_UNION_SQL} AS linted, {_UNION_SQL} <> sql_text AS changed
FROM query_log""")
def sql_06(spark, sf):
    """UNION -> UNION ALL where ALL is missing (changes results; opt-in); other
    texts pass unchanged."""
    q = _ql(spark, sf)
    lint = S.lint_union_all(F.col("sql_text"))
    return q.select("q_id", lint.alias("linted"), (lint != F.col("sql_text")).alias("changed"))
