"""Registered query: near-duplicate embeddings."""

from judgelake.llm import neardup
from judgelake.llm.common import table
from judgelake.llm.registry import query


@query("op3_near_dup")
def op3_near_dup(spark, sf_dir):
    return neardup.links(table(spark, sf_dir, "embeddings"))
