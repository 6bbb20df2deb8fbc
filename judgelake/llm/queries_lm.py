"""Registered query: log probabilities of all documents, learned from six folds of seven."""

from pyspark.sql import functions as F

from judgelake.llm import lm
from judgelake.llm.common import fold, table
from judgelake.llm.registry import query


@query("op8_lm_score")
def op8_lm_score(spark, sf_dir):
    held = lambda: F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    found = lm.score(table(spark, sf_dir, "documents"), ~held())
    return found.select("doc_id", held().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
