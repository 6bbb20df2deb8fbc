"""Registered query: all documents as flat token files, and the counts found in them."""

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from judgelake.llm import tokenfiles
from judgelake.llm.common import table
from judgelake.llm.queries_bpe import RANK_FILE
from judgelake.llm.registry import query
from judgelake.session import checkpoint_dir


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write(table(spark, sf_dir, "documents"), path, RANK_FILE, public_tokenizers.PATTERN)
    found = tokenfiles.scan(spark, path)
    return found.withColumn("file", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))
