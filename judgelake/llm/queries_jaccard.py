"""Registered query: near-duplicate classes of all documents."""

from judgelake.llm import jaccard
from judgelake.llm.common import table
from judgelake.llm.registry import query


@query("op7_jaccard")
def op7_jaccard(spark, sf_dir):
    return jaccard.classes(table(spark, sf_dir, "documents"))
