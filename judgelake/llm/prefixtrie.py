"""The trie of all conversation prefixes, with sums over members and subtrees.

Turns become positional columns of turn ids. One ROLLUP over the columns of a block
aggregates all prefixes of up to ``BLOCK`` turns together, ``grouping_id`` tells their
depth. Conversations that still share their prefix at the end of a block go on in the next
one, keyed by the node they have reached.

A node is named by its smallest member and its depth. Sums over a subtree are sums over the
members of its top, so the same ROLLUP gives them, once each conversation carries what it
adds: ``shared``, the code points of its turns before the first node it is the smallest
member of, and ``leaf``, whether a childless node is named after it.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import stored

#: Turns of a block.
BLOCK = 8
#: Conversation ids per piece of a list of ids, at most.
PIECE = 4096
#: Turn numbers per bucket in which turns are numbered.
SPAN = 1024


def turn_ids(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos, id, size: position from 1, 128 bits of SHA-256 over role and text, code points of the text.

    Turns are ordered by ``turn``, null first, then by id; repeated rows are turns of their
    own. Null role or text is empty. Rows without a conversation id are left out. Positions
    are counted in buckets of turn numbers, so a conversation that holds a large part of
    all rows is numbered by many tasks.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256), 1, 32))
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.floor(F.col(turn) / SPAN).cast("long").alias("bucket"), digest.alias("id"), F.length(said).cast("long").alias("size"))
    sizes = rows.groupBy("conv", "bucket").agg(F.count("*").alias("n"))
    several = sizes.groupBy("conv").agg(F.count("*").alias("b")).filter("b > 1").select("conv")
    before = sizes.join(several, "conv").selectExpr(
        "conv", "bucket", "sum(n) OVER (PARTITION BY conv ORDER BY bucket NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
    numbered = rows.selectExpr("*", "row_number() OVER (PARTITION BY conv, bucket ORDER BY turn NULLS FIRST, id) AS n").alias("t")
    same = (F.col("t.conv") == F.col("b.conv")) & F.col("t.bucket").eqNullSafe(F.col("b.bucket"))
    return numbered.join(before.alias("b"), same, "left").select(
        "t.conv", (F.col("n") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "id", "size")


def grafted(turns: DataFrame, base: Column, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations whose first ``taken`` turns come from conversation ``base``.

    ``base`` and ``taken`` are expressions over ``conv``. The base gives its first turns (all
    if it has fewer, none if it is absent), then follow the conversation's own turns after
    its first ``taken``. A conversation may be left without turns.
    """
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    plan = sizes.select("conv", base.alias("base"), taken.cast("long").alias("taken"))
    had = sizes.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    plan = plan.join(had, "base", "left").withColumn("got", F.least("taken", F.coalesce("there", F.lit(0))))
    own = turns.join(plan, "conv").filter("pos > taken").select("conv", (F.col("pos") - F.col("taken") + F.col("got")).alias("pos"), "id", "size")
    first = turns.select(F.col("conv").alias("base"), "pos", "id", "size")
    lent = plan.filter("got > 0").select("conv", "base", F.explode(F.sequence(F.lit(1).cast("long"), "got")).alias("pos"))
    return own.unionByName(lent.join(first, ["base", "pos"]).select("conv", "pos", "id", "size")), plan.select("conv")


def _digests(batches):
    """SHA-256 of comma-joined pieces of each node, which come together and in order."""
    key, running = None, None
    for pdf in batches:
        done = []
        for conv, depth, piece in zip(pdf["conv_id"], pdf["depth"], pdf["piece"]):
            if key != (conv, depth):
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = (conv, depth), hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
        yield pd.DataFrame(done, columns=["conv_id", "depth", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, running.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])


def trie(turns: DataFrame, convs: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node.

    ``turns`` has conv, pos (1, 2, ... without gaps), id and size; ``convs`` names the
    conversations (those of ``turns`` if not given), also such without turns. ``conv_id`` is
    the smallest member and, with ``depth``, names the node. ``saved_tokens`` sums
    (members - 1) times the size of the last turn over the subtree, its top included.
    ``ends_sha256`` is over the ids of members that end here, ascending, joined by commas.
    No conversations give no nodes.

    A conversation that shares its prefix with no other goes on alone: its further nodes
    have one member and follow from its length, so rounds are needed for shared prefixes
    only. Lists of ending members are joined in pieces of at most ``PIECE`` ids and hashed
    as a stream.
    """
    spark, t, l = turns.sparkSession, [f"t{j}" for j in range(1, block + 1)], [f"l{j}" for j in range(1, block + 1)]
    at = (F.col("pos") - 1) % block + 1
    rows = turns.groupBy("conv", F.floor((F.col("pos") - 1) / block).cast("int").alias("block")).agg(
        F.max("pos").alias("top"), *[F.max(F.when(at == j, F.col("id"))).alias(f"t{j}") for j in range(1, block + 1)],
        *[F.max(F.when(at == j, F.col("size"))).alias(f"l{j}") for j in range(1, block + 1)])
    blocks = stored(rows, "trie-blocks")
    whole = blocks.groupBy("conv").agg(F.max("top").alias("len"))
    every = whole if convs is None else convs.select("conv").distinct().join(whole, "conv", "left").withColumn("len", F.coalesce("len", F.lit(0)))
    key = F.filter(F.array(*t), lambda x: x.isNotNull())
    # the row of a group by which the size before the group's last turn is known
    before = [F.lit(0).cast("long")]
    for c in l:
        before.append(before[-1] + F.coalesce(F.col(c), F.lit(0)))
    before = F.element_at(F.array(*before), F.greatest(F.col("level"), F.lit(1)))
    prefixes = (f"SELECT {{kept}}, prior, {', '.join(t)}, {block} - bit_count(grouping_id()) AS level, min(conv) AS conv_id, count(*) AS n_convs, "
                f"{', '.join(f'max({c}) AS {c}' for c in l)}, max(base) AS base FROM {{rows}} GROUP BY prior, ROLLUP ({', '.join(t)})")

    def nodes(members: DataFrame, k: int, kept: str = "0 AS none") -> DataFrame:
        """All prefixes of a block that end in it, with ``base`` as the size before the last turn."""
        found = spark.sql(prefixes.replace("{kept}", kept), rows=members).withColumn("key", key)
        found = found.filter((F.size("key") == F.col("level")) & ((F.col("level") > 0) | F.lit(k == 0)))
        return found.select("*", (F.col("base") + before).alias("above"), (F.col("level") + k * block).cast("long").alias("depth")).drop(*t, "base", "none")

    alive = every.select("conv", "len", F.lit(0).cast("long").alias("prior"), F.lit(0).cast("long").alias("base"))
    k, members, tops, ends, alone = 0, [], [], [], []
    while True:
        mine = blocks.filter(F.col("block") == k).drop("block", "top")
        members.append(stored(alive.join(mine, "conv", "left" if k == 0 else "inner"), "trie-members"))
        found = stored(nodes(members[k], k), "trie-nodes")
        up = found.select("prior", F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
        child = found.withColumn("up", F.when(F.col("level") > 0, F.slice("key", 1, F.col("level") - 1)))
        first = (F.col("level") == 1) & F.lit(k > 0)  # the node above lies in the block before
        child = child.join(up.filter(F.size("up") < block), ["prior", "up"], "left")
        tops.append(child.select("conv_id", "depth", F.when(first, F.col("prior")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "above"))
        reached = stored(members[k].withColumn("key", key).withColumn("total", F.col("base") + sum((F.coalesce(F.col(c), F.lit(0)) for c in l), F.lit(0)))
                         .join(found.select("prior", "key", "conv_id", "n_convs"), ["prior", "key"]).select("conv", "len", "total", "conv_id", "n_convs"), "trie-reached")
        end = (k + 1) * block
        ends.append(reached.filter(F.col("len") <= end).select("conv_id", F.col("len").alias("depth"), "conv", "total"))
        alone.append(reached.filter((F.col("len") > end) & (F.col("n_convs") == 1)).select("conv", "len", F.lit(k).alias("from")))
        alive = reached.filter((F.col("len") > end) & (F.col("n_convs") > 1)).select("conv", "len", F.col("conv_id").alias("prior"), F.col("total").alias("base"))
        k += 1
        if alive.isEmpty():
            break

    def union(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    alone = union(alone)
    path = alone.join(blocks.select("conv", "block", "top"), "conv").filter("block > `from`")
    path = path.select(F.col("conv").alias("conv_id"), F.explode(F.sequence((F.col("block") * block + 1).cast("long"), "top")).alias("depth"))
    none = F.lit(None).cast("long")
    top = union(tops)
    tree = stored(top.unionByName(path.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), none.alias("above"))), "trie-tree")
    children = tree.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))

    last = union(ends)
    owned = tree.filter("above IS NOT NULL AND (parent_conv_id IS NULL OR parent_conv_id <> conv_id)").select(F.col("conv_id").alias("conv"), F.col("above").alias("shared"))
    copies = last.filter("conv <> conv_id").select("conv", F.col("total").alias("shared"))
    leaves = tree.join(children, ["conv_id", "depth"], "left_anti").select(F.col("conv_id").alias("conv"), F.lit(1).alias("leaf"))
    # a copy of a smaller conversation names no node at its end; the smallest member of all has the root
    adds = stored(owned.unionByName(copies).groupBy("conv").agg(F.min("shared").alias("shared")).join(leaves, "conv", "left"), "trie-adds")
    sums = "sum(shared) AS all_shared, min_by(shared, conv) AS own_shared, sum(coalesce(leaf, 0)) AS n_leaves"
    saved = F.col("all_shared") - F.col("own_shared") - (F.col("n_convs") - 1) * F.col("above")
    sub = union([nodes(m.join(adds, "conv", "left"), i, sums).select("conv_id", "depth", "n_leaves", saved.alias("saved_tokens")) for i, m in enumerate(members)])

    finished = last.select("conv_id", "depth", "conv").unionByName(alone.select(F.col("conv").alias("conv_id"), F.col("len").alias("depth"), "conv"))
    pieces = finished.groupBy("conv_id", "depth", F.floor(F.col("conv") / PIECE).alias("at")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("piece"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = pieces.repartition(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "at").mapInPandas(_digests, "conv_id long, depth long, ends_sha256 string")
    node = ["conv_id", "depth"]
    return tree.join(children, node, "left").join(sub, node, "left").join(hashed, node, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefixes(conversations: DataFrame, block: int = BLOCK, **columns: str) -> DataFrame:
    """The trie of the conversations as they are; ``columns`` as in ``turn_ids``."""
    return trie(turn_ids(conversations, **columns), block=block)
