"""Registered query: all pages as WARC archives, and what is read back from them."""

from pyspark.sql import functions as F

from judgelake.llm import warc
from judgelake.llm.common import table
from judgelake.llm.registry import query
from judgelake.session import scratch_path

OP12_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS FIRST, url NULLS FIRST) AS n,
  first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS FIRST, url NULLS FIRST) AS first FROM pages)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND payload_bytes >= 100 THEN first END AS refers_to FROM p
"""


@query("op12_warc", OP12_SQL)
def op12_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_row").alias("refers_to"))
