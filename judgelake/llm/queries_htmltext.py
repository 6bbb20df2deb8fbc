"""Registered query: the main text of all pages."""

from pyspark.sql import functions as F

from judgelake.llm import htmltext
from judgelake.llm.common import table
from judgelake.llm.registry import query


@query("op5_html_text")
def op5_html_text(spark, sf_dir):
    found = htmltext.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
