"""Registered query: the prefix trie of rebuilt conversations."""

from pyspark.sql import functions as F

from judgelake.llm import prefixtrie
from judgelake.llm.common import fold, stored, table
from judgelake.llm.registry import query

_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""
OP13_SQL = f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, substr(sha256(length(r)::VARCHAR || ':' || r || x), 1, 32)) AS turns FROM said GROUP BY conv_id),
cut AS (SELECT *, {_CRC} % 6 AS h FROM own),
full_ AS (SELECT c.conv_id, coalesce(b.turns, [])[1:c.h] || c.turns[c.h + 1:] AS turns FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
reach AS (SELECT conv_id, turns[1:d] AS path, d, d = len(turns) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM full_)),
node AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(any_value(path)[d].x), 0) AS size,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM reach GROUP BY path, d),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
sized AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM node n LEFT JOIN kids k ON k.path = n.path),
sub AS (SELECT path[1:i] AS path, sum((n_convs - 1) * size) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS i FROM sized) GROUP BY 1)
SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, sub.n_leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, s.ends_sha256
FROM sized s JOIN sub ON sub.path = s.path LEFT JOIN node p ON s.depth > 0 AND p.path = s.path[1:s.depth - 1]
"""


def rebuilt(conversations):
    """Turns and ids of the conversations of the contract: a shared head, then their own rest."""
    turns = stored(prefixtrie.turn_ids(conversations), "trie-turns")
    return prefixtrie.grafted(turns, F.col("conv") - F.col("conv") % 100, fold("conv", 6))


@query("op13_prefix_trie", OP13_SQL)
def op13_prefix_trie(spark, sf_dir):
    return prefixtrie.trie(*rebuilt(table(spark, sf_dir, "conversations")))
