"""Registered query: all documents against all benchmark items."""

from pyspark.sql import functions as F

from judgelake.llm import decontaminate as D
from judgelake.llm.common import LOWER, UPPER, table
from judgelake.llm.registry import query

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (UPPER, LOWER)
OP1_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, w, len(w) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item, w[s:s + 9] AS ws, least(n, 10) AS n FROM (SELECT item, w, n, unnest(generate_series(1, greatest(n - 9, 1))) AS s FROM i)),
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT k, n, s, w[s:s + n - 1] AS ws FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT k, s, g.n, item FROM grams g JOIN win ON win.n = g.n AND win.ws = g.ws),
pos AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (k) LEFT JOIN its USING (k)
"""


@query("op1_decontaminate", OP1_SQL)
def op1_decontaminate(spark, sf_dir):
    found = D.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
