"""Registered query: verdicts over all page urls."""

from pyspark.sql import functions as F

from judgelake.llm import urlfilter
from judgelake.llm.common import LOWER, UPPER, table
from judgelake.llm.registry import query

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: A host is on the list if one of its labels is one of these.
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]

_FITS = "(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')"
_CASE = " ".join("WHEN {} THEN '{}'".format(_FITS.format(h=t.partition("/")[0], p="/" + t.partition("/")[2]), "{%d}" % i)
                 for i, t in sorted(enumerate(t for _, t in RULES), key=lambda x: -len(x[1])))
OP6_SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b)
SELECT page_id, host, path, CASE {_CASE.format(*[t for _, t in RULES])} END AS rule,
  coalesce(CASE {_CASE.format(*[v for v, _ in RULES])} END,
    CASE WHEN list_has_any(string_split(host, '.'), {LISTED_LABELS}) THEN 'block' ELSE 'allow' END) AS verdict FROM c
"""


@query("op6_url_filter", OP6_SQL)
def op6_url_filter(spark, sf_dir):
    listed = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, LISTED_LABELS)))
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES, listed)
