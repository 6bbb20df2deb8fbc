"""Near duplicates among embeddings: iterative quantisation, multi-index Hamming tables,
and a rerank by the original vectors.

Rotations are learned on a bounded sample so that the signs of the rotated vectors are
balanced codes of little distortion (Gong and Lazebnik, 2011). The codes of all rotations
are cut into substrings, a table each. Vectors that agree on a substring meet in its
bucket, and every meeting is decided by the cosine of the original vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import components, small, stored

THRESHOLD = 0.93
#: Vectors the rotations are learned on, at most about this many, and learning rounds.
TRAIN_VECTORS, ROUNDS = 20_000, 30
#: Dimensions of one rotation; longer vectors give each rotation a random subspace of so many.
AXES = 64
#: Vectors that meet in one block; a larger bucket is met block by block.
BLOCK = 1024
#: Groups up to this size are met all at once.
FEW = 32
#: Part of the links at the threshold that the tables should miss at most, as expected.
MISS = 0.03
BROADCAST_ROWS = 200_000


@dataclass
class Coder:
    """Substring codes of unit vectors: ``tables`` numbers of ``bits`` bits each."""

    turns: np.ndarray
    bits: int
    tables: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        signs = x @ self.turns > 0
        cut = signs[:, :self.bits * self.tables].reshape(len(x), self.tables, self.bits)
        return (cut * (1 << np.arange(self.bits))).sum(axis=2).astype(np.int32)


def layout(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a substring, and tables: buckets stay small as ``n`` grows, the expected
    recall at the threshold stays the same."""
    bits = int(np.clip(round(math.log2(max(2, n) / 16)), 6, 24))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(MISS) / math.log(1 - agree)))


def learn(sample: np.ndarray, bits: int, tables: int, seed: int = 5) -> Coder:
    """Rotations by alternating signs and orthogonal Procrustes fits, from random starts.

    The planes go through the origin, not the mean: cosines are about the origin, and a
    group so large that it makes the mean would be cut apart by planes through it.
    Up to ``AXES`` dimensions a rotation has all of them. Beyond, each rotation is learned in
    a random subspace of its own: it keeps the angles of all vectors alike, also of those
    that lie off the leading axes of the sample, whose own subspace would lose them.
    """
    rng, d = np.random.default_rng(seed), sample.shape[1]
    _, _, axes = np.linalg.svd(sample.T @ sample if len(sample) and d <= AXES else np.eye(min(d, AXES)))
    axes, turns, have = axes.T, [], 0
    while have < bits * tables:
        if d > AXES:
            axes, _ = np.linalg.qr(rng.normal(size=(d, AXES)))
        flat = sample @ axes
        turn, _ = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))
        for _ in range(ROUNDS if len(sample) else 0):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        turns.append(axes @ turn)
        have += turn.shape[1]
    return Coder(np.concatenate(turns, axis=1)[:, rng.permutation(have)], bits, tables)


def _unit(rows: list[bytes], size: int) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    out = np.zeros((len(rows), size))
    out[:, :x.shape[1]] = x
    with np.errstate(over="ignore"):
        out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _labels(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest index its links reach."""
    root = np.arange(len(near))
    while True:
        best = np.minimum(root, np.where(near, root[None, :], len(near)).min(axis=1, initial=len(near)))
        best = best[best]
        if (best == root).all():
            return root
        root = best


def _met(keys: list[str], threshold: float):
    """For blocks of vectors sorted by ``keys``: links by vector, and one link to the root of each.

    A pair is counted in the first table where it meets only, so nothing is counted twice
    and no pair is ever a row.
    """
    def block(rep, weight, code, side, table, vectors):
        a = np.flatnonzero(side != 1)
        b = a if not (side == 1).any() else np.flatnonzero(side == 1)
        x = _unit([vectors[i] for i in a], max(len(vectors[i]) for i in a) // 8)
        y = x if b is a else _unit([vectors[i] for i in b], x.shape[1])
        near = x @ y.T >= threshold
        i, j = np.nonzero(near)
        if b is a:
            i, j = i[i < j], j[i < j]
        first = np.ones(len(i), bool)
        for t in range(table):
            first &= code[a[i], t] != code[b[j], t]
        i, j = a[i[first]], b[j[first]]
        n = np.bincount(i, weight[j], len(rep)).astype(np.int64) + np.bincount(j, weight[i], len(rep)).astype(np.int64)
        both = np.zeros((len(rep), len(rep)), bool)
        both[i, j] = both[j, i] = True
        hit = np.flatnonzero(n)
        order = hit[np.argsort(rep[hit])]
        root = _labels(both[np.ix_(order, order)])
        return rep[order], n[order], rep[order][root]

    def few(rows, near_by):
        """Links of groups of at most ``FEW`` rows, all groups of a batch with vectors of one
        length at once: a pair is two rows at distance d in the same group."""
        name, size, at = near_by
        v = [rows["v"].iloc[i] for i in at]
        x = _unit(v, max(map(len, v)) // 8)
        code, table, rep, weight = (np.stack(rows["codes"].to_numpy()[at]), rows["t"].to_numpy()[at], rows["rep"].to_numpy()[at], rows["weight"].to_numpy()[at])
        earlier = np.arange(code.shape[1]) < table[:, None]
        out = []
        for d in range(1, size):
            i = np.flatnonzero(name[d:] == name[:-d])
            j = i + d
            near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[near], j[near]
            first = ~((code[i] == code[j]) & earlier[i]).any(axis=1)
            i, j = i[first], j[first]
            low = np.minimum(rep[i], rep[j])
            out += [(rep[i], weight[j], low), (rep[j], weight[i], low)]
        return [np.concatenate(c) for c in zip(*out)]

    def run(batches):
        carry = None
        for pdf in _and_last(batches):
            rows = carry if pdf is None else (pdf if carry is None else pd.concat([carry, pdf], ignore_index=True))
            carry = None
            if rows is None or not len(rows):
                continue
            name = rows[keys].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]).any(axis=1)]))
            if pdf is not None:
                carry = rows.iloc[starts[-1]:].reset_index(drop=True)
                rows, starts = rows.iloc[:starts[-1]], starts[:-1]
            sizes = np.diff(np.append(starts, len(rows)))
            group = np.repeat(np.arange(len(starts)), sizes)
            whole = (rows["blocks"] == 1).to_numpy()
            own = np.repeat(sizes, sizes)
            at = np.flatnonzero(whole & (own > 1) & (own <= FEW))
            long = np.array([len(rows["v"].iloc[i]) for i in at], int)
            out = [few(rows, (group[k], int(own[k].max()), k)) for k in (at[long == n] for n in np.unique(long))]
            for s, n in zip(starts, sizes):
                if n < 2 or (whole[s] and n <= FEW):
                    continue
                g = rows.iloc[s:s + n]
                side = g["side"].to_numpy()
                if (side != 1).any() and ((side == 1).any() or g["i"].iloc[0] == g["j"].iloc[0]):
                    out.append(block(g["rep"].to_numpy(), g["weight"].to_numpy(), np.stack(g["codes"].to_numpy()), side, int(g["t"].iloc[0]), list(g["v"])))
            if out:
                found = pd.DataFrame({c: np.concatenate([o[k] for o in out]) for k, c in enumerate(("rep", "n", "root"))})
                yield found.groupby(["rep", "root"], as_index=False)["n"].sum()[["rep", "n", "root"]]

    return run


def _and_last(batches):
    yield from batches
    yield None


def links(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
          threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Vectors link if their labels are equal and not null, their lengths are equal, and
    their cosine (double precision) is at least ``threshold`` and a table lets them meet.
    Null and zero vectors, vectors with null or non-finite parts, and rows without an id
    link with nothing: 0 links, their own component, kept. Repeated rows are one vector and
    get a row each; equal vectors are one class, each linked to all others in it. Only the
    three columns are read; an empty table gives no rows. A bucket that holds a large part
    of all vectors is met in blocks of ``BLOCK``, spread over tasks.
    """
    spark = embeddings.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0, as in a grouping
    rows = embeddings.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), v.alias("v"))
    usable = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
              & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)))
    good = rows.filter(usable)
    classes = stored(good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("weight"))
                     .withColumn("size", F.size("v")).withColumn("v", F.array_join(F.transform("v", lambda x: x.cast("string")), ",")), "itq-classes")
    n, longest = classes.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(1))).first()

    def raw(text):
        return np.array(text.split(","), float).tobytes()

    picked = classes.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, TRAIN_VECTORS / max(1, n)))).select("v").orderBy("v")
    sample = [raw(r.v) for r in picked.collect()]
    unit = np.concatenate([_unit([s], longest) for s in sample]) if sample else np.zeros((0, longest))
    coder = spark.sparkContext.broadcast(learn(unit, *layout(n, threshold)))

    def encode(batches):
        for pdf in batches:
            if len(pdf):
                v = [raw(t) for t in pdf["v"]]
                codes = coder.value.codes(np.concatenate([_unit([x], len(coder.value.turns)) for x in v]))
                yield pdf.drop(columns=["v"]).assign(v=v, codes=list(codes))

    kind = classes.schema["label"].dataType.simpleString()
    coded = stored(classes.mapInPandas(encode, f"label {kind}, rep long, weight long, size int, v binary, codes array<int>"), "itq-codes")
    entries = coded.select("rep", "weight", "codes", "v", F.posexplode("codes").alias("t", "code"), "label", "size")
    key = ["t", "code", "label", "size"]
    # buckets beyond a block are dealt by hash to blocks, and every two blocks meet once
    large = coded.select("label", "size", F.posexplode("codes").alias("t", "code")).groupBy(*key).count().filter(F.col("count") > BLOCK)
    large = stored(large.select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "itq-large")
    placed = entries.join(small(large, BROADCAST_ROWS), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = placed.withColumn("b", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("rep", "weight", "codes", "v", F.xxhash64(*key).alias("k"), "t", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"),
                           F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"), "blocks")
    by = ["k", "i", "j"]
    met = placed.repartition(parts, *by).sortWithinPartitions(*by, "side", "rep")
    found = stored(met.mapInPandas(_met(by, threshold), "rep long, n long, root long"), "itq-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    same = coded.select("rep", "v", "label", "weight")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct())
    per = (same.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
           .select("rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    # rows find their class by the vector itself, named by a digest
    text = F.array_join(F.transform("v", lambda x: x.cast("string")), ",")
    named = classes.select("label", F.sha2(F.col("v"), 256).alias("d"), "rep").join(per, "rep").select("label", "d", "n_links", "component_id")
    out = rows.withColumn("d", F.when(usable, F.sha2(text, 256))).drop("v")
    return out.join(named, ["label", "d"], "left").select(
        F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"))
