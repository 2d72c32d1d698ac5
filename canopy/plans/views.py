"""Views that read the test tables as boxes, findings, moves, trees, tokens and metrics.

Each view is one SQL text that Spark and DuckDB both run. Integer arithmetic throughout, and total orders.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "lines": """
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n
      FROM lineitem""",
    "boxes_gt": """
      SELECT l_orderkey AS case_id, n AS node, (l_partkey * 37) % 360 AS x, (n - 1) * 48 AS y,
             16 + (l_suppkey * 13) % 200 AS w, 16 + (l_partkey * 7) % 32 AS h, l_partkey % 5 AS type FROM lines""",
    "boxes_pred": """
      SELECT l_orderkey AS case_id, n AS node, (l_partkey * 37) % 360 + ((l_partkey % 9) - 4) * 4 AS x,
             (n - 1) * 48 + ((l_suppkey % 3) - 1) * 12 AS y, 16 + (l_suppkey * 13) % 200 AS w, 16 + (l_partkey * 7) % 32 AS h,
             (l_partkey % 5 + CASE WHEN (l_orderkey * 7 + n) % 13 = 0 THEN 1 ELSE 0 END) % 5 AS type
      FROM lines WHERE (l_orderkey * 7 + n) % 11 <> 0""",
    "findings": """
      SELECT d.detector, l_orderkey AS case_id, n * 3 + d.detector AS fid,
             (l_partkey * 37) % 360 + ((l_partkey + d.detector) % 5 - 2) * 3 AS x, (n - 1) * 48 + ((l_suppkey + d.detector) % 3 - 1) * 4 AS y,
             16 + (l_suppkey * 13) % 200 AS w, 16 + (l_partkey * 7) % 32 AS h,
             (l_partkey + CASE WHEN (l_orderkey + n + d.detector) % 7 = 0 THEN 1 ELSE 0 END) % 5 AS type,
             (l_orderkey * 31 + n * 17 + d.detector * 7) % 1000 AS confidence, l_partkey % 40 AS magnitude
      FROM lines CROSS JOIN (SELECT 0 AS detector UNION ALL SELECT 1 UNION ALL SELECT 2) d
      WHERE (l_orderkey * 5 + n * 3 + d.detector) % 4 <> 0""",
    "rivals_gt": """
      SELECT l_orderkey AS case_id, n AS node, CAST(floor((n - 1) / 3) AS INT) AS slot, CAST(floor((n - 1) / 3) AS INT) * 400 + (l_partkey * 5) % 31 AS x, (l_suppkey * 3) % 17 AS y,
             60 + (l_partkey * 7) % 23 AS w, 50 + (l_suppkey * 11) % 13 AS h, l_partkey % 2 AS type FROM lines""",
    "rivals_pred": """
      SELECT l_orderkey AS case_id, n AS node, CAST(floor((n - 1) / 3) AS INT) AS slot, CAST(floor((n - 1) / 3) AS INT) * 400 + (l_suppkey * 13) % 31 AS x, (l_partkey * 7) % 17 AS y,
             60 + (l_suppkey * 5) % 23 AS w, 50 + (l_partkey * 3) % 13 AS h, (l_partkey + CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END) % 2 AS type FROM lines""",
    "tree": """
      SELECT 'r' || r_regionkey AS id, CAST(NULL AS STRING) AS parent, 0 AS depth, r_name AS name, r_regionkey AS k FROM region
      UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, n_name, n_nationkey FROM nation
      UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 2, c_name, c_custkey FROM customer
      UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 3, o_orderpriority, o_orderkey FROM orders""",
    "colors": """
      SELECT p_partkey AS id, (p_partkey * 53) % 256 AS r, (p_partkey * 97 + 11) % 256 AS g, (p_partkey * 29 + 71) % 256 AS b,
             (p_partkey * 7) % 24 AS radius, 16 + (p_partkey * 11) % 120 AS w, 16 + (p_partkey * 5) % 60 AS h FROM part""",
    "tokens": """
      SELECT n_name AS token, n_nationkey AS priority, (n_nationkey * 61 + 5) % 256 AS r, (n_nationkey * 113 + 40) % 256 AS g,
             (n_nationkey * 17 + 90) % 256 AS b, (n_nationkey % 8) * 4 AS radius FROM nation""",
    "moves": """
      SELECT user_id AS run, event_type AS kind, event_id, ts, user_id % 4 AS node_type, (event_id * 37) % 50000 AS area,
             abs(value) / 1000 AS promised, event_id % 3 = 0 AS accepted, abs(value) / 1500 AS gain, 1 + event_id % 4 AS batch FROM events""",
    "metrics": """
      SELECT o_orderkey AS case_id, o_custkey % 10 AS family, m.metric,
             CASE WHEN m.metric = 'text_cer' AND o_orderkey % 9 = 0 THEN NULL
                  ELSE ((o_orderkey * 17 + m.k * 31 + o_custkey) % 101) / 100.0E0 * CASE WHEN m.metric = 'mean_de' THEN 25 ELSE 1 END END AS value
      FROM orders CROSS JOIN (SELECT 'node_recall' AS metric, 1 AS k UNION ALL SELECT 'text_cer', 2 UNION ALL SELECT 'mean_de', 3 UNION ALL SELECT 'ssim', 4) m""",
    "corrections": """
      SELECT event_id AS item, user_id % 40 AS signature, user_id AS screen, event_type AS answer, ts FROM events""",
    "ledger": """
      SELECT event_id AS id, user_id % 20 AS k, ts, CAST(floor(value) AS INT) AS new_value,
             event_id % 5 <> 0 AS accepted, CASE WHEN event_id % 11 = 0 THEN event_id - 7 END AS reverts FROM events""",
    "pixels": """
      SELECT l_orderkey AS case_id, CAST((n - 1) % 8 AS INT) AS y, CAST(l_linenumber % 8 AS INT) AS x,
             (l_partkey * 53) % 256 AS r1, (l_partkey * 97) % 256 AS g1, (l_partkey * 29) % 256 AS b1,
             (l_partkey * 53 + l_suppkey % 3) % 256 AS r2, (l_partkey * 97 + l_suppkey % 2) % 256 AS g2, (l_partkey * 29) % 256 AS b2 FROM lines""",
    "nodes_gt": """
      SELECT l_orderkey AS case_id, n AS node, CASE WHEN n > 1 THEN CAST(floor(n / 2) AS INT) END AS parent,
             (l_partkey * 37) % 360 AS x, (n - 1) * 48 AS y, 16 + (l_suppkey * 13) % 200 AS w, 16 + (l_partkey * 7) % 32 AS h, l_partkey % 5 AS type,
             (l_partkey * 53) % 256 AS r, (l_partkey * 97) % 256 AS g, (l_partkey * 29) % 256 AS b, (l_suppkey * 41) % 256 AS stroke,
             (l_partkey * 7) % 24 AS radius, 100 - 25 * (l_suppkey % 3) AS opacity, 2 * (l_suppkey % 4) AS shadow,
             'Item ' || CAST(l_partkey % 50 AS STRING) || ' ' || l_returnflag AS text, 12 + 2 * (l_partkey % 4) AS size, 400 + 100 * (l_partkey % 3) AS weight,
             'g' || CAST(l_partkey % 9 AS STRING) AS glyph, CASE WHEN l_partkey % 3 <> 0 THEN 'comp' || CAST(l_partkey % 6 AS STRING) END AS component,
             'state' || CAST(l_suppkey % 2 AS STRING) AS variant, 't' || CAST(l_partkey % 7 AS STRING) AS token, l_linenumber AS gap FROM lines""",
    "nodes_pred": """
      SELECT l_orderkey AS case_id, n AS node, CASE WHEN n > 1 THEN CAST(floor(n / 2) AS INT) END AS parent,
             (l_partkey * 37) % 360 + CASE WHEN l_partkey % 4 = 0 THEN 3 ELSE 0 END AS x, (n - 1) * 48 + CASE WHEN l_suppkey % 6 = 0 THEN 4 ELSE 0 END AS y,
             16 + (l_suppkey * 13) % 200 + CASE WHEN l_partkey % 11 = 0 THEN 3 ELSE 0 END AS w, 16 + (l_partkey * 7) % 32 AS h, l_partkey % 5 AS type,
             ((l_partkey * 53) % 256 + CASE WHEN l_suppkey % 5 = 0 THEN 37 ELSE 0 END) % 256 AS r, (l_partkey * 97) % 256 AS g, (l_partkey * 29) % 256 AS b,
             ((l_suppkey * 41) % 256 + CASE WHEN l_partkey % 13 = 0 THEN 30 ELSE 0 END) % 256 AS stroke,
             (l_partkey * 7) % 24 + CASE WHEN l_suppkey % 7 = 0 THEN 3 ELSE 0 END AS radius, 100 - 25 * ((l_suppkey + CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 0 END) % 3) AS opacity,
             2 * ((l_suppkey + CASE WHEN l_partkey % 19 = 0 THEN 3 ELSE 0 END) % 4) AS shadow,
             'Item ' || CAST((l_partkey + CASE WHEN l_suppkey % 8 = 0 THEN 1 ELSE 0 END) % 50 AS STRING) || ' ' || l_returnflag AS text,
             12 + 2 * (l_partkey % 4) + CASE WHEN l_suppkey % 9 = 0 THEN 2 ELSE 0 END AS size, 400 + 100 * (l_partkey % 3) AS weight,
             'g' || CAST((l_partkey + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END) % 9 AS STRING) AS glyph,
             CASE WHEN l_partkey % 3 <> 0 THEN 'comp' || CAST((l_partkey + CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END) % 6 AS STRING) END AS component,
             'state' || CAST((l_suppkey + CASE WHEN l_partkey % 23 = 0 THEN 1 ELSE 0 END) % 2 AS STRING) AS variant,
             't' || CAST((l_partkey + CASE WHEN l_suppkey % 12 = 0 THEN 1 ELSE 0 END) % 7 AS STRING) AS token, l_linenumber + CASE WHEN l_partkey % 21 = 0 THEN 4 ELSE 0 END AS gap
      FROM lines WHERE (l_orderkey * 7 + n) % 11 <> 0""",
    "raster": """
      SELECT case_id, x, y, CAST(40 * (floor(x / 6) + floor(y / 5)) AS INT) % 256 AS ar, CAST(60 * floor(y / 5) AS INT) % 256 AS ag, CAST(30 * floor(x / 6) AS INT) % 256 AS ab,
             (CAST(40 * (floor(x / 6) + floor(y / 5)) AS INT) + CASE WHEN k % 7 = 0 THEN 25 ELSE 0 END) % 256 AS br, CAST(60 * floor(y / 5) AS INT) % 256 AS bg,
             (CAST(30 * floor(x / 6) AS INT) + CASE WHEN k % 11 = 0 THEN 40 ELSE 0 END) % 256 AS bb
      FROM (SELECT case_id, k, CAST((place - 1) % 24 AS INT) AS x, CAST(floor((place - 1) / 24) AS INT) AS y
            FROM (SELECT l_suppkey AS case_id, l_partkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS place FROM lineitem) q) p""",
    "regions": """
      SELECT p_partkey % (SELECT count(*) FROM supplier) AS case_id, p_partkey AS node, p_partkey % 3 AS type,
             CASE WHEN p_partkey % 2 = 1 AND p_partkey >= (SELECT count(*) FROM supplier) THEN p_partkey - (SELECT count(*) FROM supplier) END AS parent,
             CAST(p_partkey % 20 AS INT) AS x, CAST((p_size * 3) % 22 AS INT) AS y, CAST(2 + p_partkey % 5 AS INT) AS w, CAST(2 + p_size % 4 AS INT) AS h, p_name || ' ' || p_type AS text FROM part""",
    "frames": """
      SELECT s_suppkey AS case_id, 24 AS tw, 24 AS th, 24 - CAST(s_suppkey % 4 AS INT) AS rw, 25 - CAST(s_suppkey % 3 AS INT) AS rh FROM supplier""",
}


def with_views(body: str) -> str:
    """``body`` with a WITH clause for every view that it, or a view it reads, names."""
    need: list[str] = []

    def visit(text: str) -> None:
        for v in VIEWS:
            if v not in need and re.search(rf"\b{v}\b", text):
                visit(VIEWS[v])
                need.append(v)

    visit(body)
    recursive = bool(re.match(r"\s*WITH RECURSIVE", body))
    body = re.sub(r"^\s*WITH( RECURSIVE)?", "", body)
    head = "WITH RECURSIVE " if recursive else "WITH "
    joined = ", ".join(f"{v} AS ({VIEWS[v]})" for v in need)
    if not joined:
        return head + body if recursive or not body.lstrip().upper().startswith("SELECT") else body
    return head + joined + (" " if body.lstrip().upper().startswith("SELECT") else ", ") + body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = with_views(f"SELECT * FROM {name}")
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b{t}\b", "{" + t + "}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
