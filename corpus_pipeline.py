"""A training corpus from raw documents: each stage works on what the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
``documents``; other columns of ``docs`` are left out. Nulls, repeated rows and empty
tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers

from judgelake.llm import bpe, decontaminate, jaccard, langid
from judgelake.llm.common import stored, table
from judgelake.llm.queries_bpe import RANK_FILE, digests
from judgelake.llm.queries_langid import learned

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark, docs, sf_dir):
    """Documents with a language: null texts and texts without a letter go."""
    docs = docs.select(*COLUMNS)
    return langid.predict(docs, learned(docs), keep=COLUMNS).filter(f"lang_pred <> '{langid.UND}'").select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near duplicates, the one with the smallest id."""
    return jaccard.representatives(docs.select(*COLUMNS))


def decontaminated(spark, docs, sf_dir):
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark, docs, sf_dir):
    """doc_id, n_tokens and digests of the ids and of the bytes they decode to."""
    return digests(bpe.encode(docs, RANK_FILE, public_tokenizers.PATTERN, decoded="decoded"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("tokens", tokens)]
#: SQL cannot express the first two stages at the size of the tables.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; each stage is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stored(docs, name), sf_dir)
    return docs
