"""Imports every query module of the subpackage."""

from judgelake.llm import queries_bpe, queries_decontaminate, queries_hardnegatives, queries_htmltext, queries_jaccard, queries_langid, queries_licenses, queries_lm, queries_neardup, queries_prefixtrie, queries_tokenfiles, queries_urlfilter, queries_warc  # noqa: F401
from judgelake.llm.registry import LLM_CHECK_SQL, LLM_QUERIES

__all__ = ["LLM_CHECK_SQL", "LLM_QUERIES"]
