"""Registered query: byte-level BPE over all documents, there and back."""

import public_tokenizers
from pyspark.sql import functions as F

from judgelake.llm import bpe
from judgelake.llm.common import table
from judgelake.llm.registry import query

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def digests(tokens):
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query("op10_bpe")
def op10_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return digests(bpe.encode(docs, RANK_FILE, public_tokenizers.PATTERN, decoded="decoded"))
