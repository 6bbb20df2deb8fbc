"""Registered query: the language of every document, learned from two folds of three."""

from pyspark.sql import functions as F

from judgelake.llm import langid
from judgelake.llm.common import fold, table
from judgelake.llm.registry import query


def held_out():
    """A null id is in no held-out fold."""
    return F.coalesce(fold("doc_id", 3) == 1, F.lit(False))


def learned(docs):
    """The model of the folds that may be learned from."""
    return langid.train(docs.filter(~held_out()))


@query("op2_langid")
def op2_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return langid.predict(rows, learned(docs), keep=("doc_id", "held_out"))
