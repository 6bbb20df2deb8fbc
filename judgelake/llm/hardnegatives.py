"""Hard negatives by exact search: anchors of a cluster share one sorted list of candidates.

For a cluster of anchors, each candidate has an upper bound of its inner product with any
member: its norm times the cosine of its angle to the centroid less the cluster's radius
(as in MAXIMUS, Abuzaid et al., 2019). The candidates are sorted by that bound once. Every
member walks the list, and stops where the bound shows that nothing further can enter.

Candidates are dealt into groups of bounded size and stay where they are; the anchors visit
each group, cluster by cluster. What a member finds in a group is its best there, and the
best of all groups are the best of all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import stored

#: Bytes of vectors in a group of candidates and in the sample for centroids, at most.
GROUP_BYTES, SAMPLE_BYTES = 32 << 20, 16 << 20
#: Rows that make a group worth its own task; anchors a cluster should have; clusters at
#: most; vectors of the sample at most; rounds of k-means.
GROUP_ROWS, ANCHORS_PER_CLUSTER, CLUSTERS, SAMPLE, ROUNDS = 1024, 64, 256, 20_000, 10
#: Members that walk together, and candidates they are scored with at a time.
MEMBERS, CHUNK = 256, 2048
#: Added to radii (radians) and to bounds (relative to the norms): rounding of the bounds.
SLACK, RELATIVE = 1e-6, 1e-9


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as int64, padded with zeros to ``dims``."""
    values, sizes = np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(float)
    norm = np.linalg.norm(x, axis=1)
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def centroids(sample: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Directions of ``k`` clusters by spherical k-means."""
    unit, norm = _unit(sample)
    unit = unit[norm > 0]
    if not len(unit):
        return np.zeros((1, sample.shape[1]))
    means = unit[np.random.default_rng(seed).permutation(len(unit))[:k]]
    for _ in range(ROUNDS):
        own = (unit @ means.T).argmax(axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, own, unit)
        fresh, size = _unit(sums)
        means = np.where((size > 0)[:, None], fresh, means)
    return means


class Candidates:
    """A group of candidates: ids, labels, vectors, and the list of the last cluster."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, exact_float: bool):
        self.ids, self.labels = ids, labels
        self.x = vectors.astype(float) if exact_float else vectors
        self.unit, self.norm = _unit(vectors)
        self.cluster, self.scored = None, 0

    def sort_for(self, cluster: int, centroid: np.ndarray, radius: float) -> None:
        if cluster == self.cluster:
            return
        angle = np.arccos(np.clip(self.unit @ centroid, -1, 1))
        bound = self.norm * np.cos(np.maximum(0, angle - radius - SLACK))
        self.order = np.argsort(-bound, kind="stable")
        self.bound, self.cluster = bound[self.order] + RELATIVE * self.norm.max(initial=0), cluster

    def walk(self, vectors: np.ndarray, finders: list, chunk: int = CHUNK) -> None:
        """Each member's finder sees the list until its floor lies above the bound of the rest."""
        norm = np.linalg.norm(vectors.astype(float), axis=1)
        vectors, live = vectors.astype(self.x.dtype), np.arange(len(vectors))
        for at in range(0, len(self.order), chunk):
            live = live[[finders[m].floor <= norm[m] * self.bound[at] + SLACK for m in live]]
            if not len(live):
                return
            part = self.order[at:at + chunk]
            scores = (self.x[part] @ vectors[live].T).T.astype(np.int64)
            self.scored += scores.size
            for m, s in zip(live, scores):
                finders[m].see(self.ids[part], self.labels[part], s)


class _Best:
    """The ``k`` best of what was seen, by score, then by smaller id."""

    def __init__(self, k: int, floor: int | float):
        self.k, self.floor, self.ids, self.scores = k, floor, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.floor = max(self.floor, self.scores[-1])


class Positives:
    """The best of an anchor's own label, itself left out."""

    def __init__(self, anchor: int, label: int, k: int):
        self.anchor, self.label, self.best = anchor, label, _Best(k, -math.inf)

    @property
    def floor(self):
        return self.best.floor

    def see(self, ids, labels, scores) -> None:
        hit = np.flatnonzero((labels == self.label) & (scores >= self.floor) & (ids != self.anchor))
        if len(hit):
            self.best.add(ids[hit], scores[hit])


class Negatives:
    """The best of other labels within each positive's window of scores."""

    def __init__(self, label: int, scores: list[int], k: int, low: int, high: int):
        self.label = label
        self.windows = {p: (p * high // 100, _Best(k, -(-p * low // 100))) for p in set(scores)}
        self.windows = {p: (top, best) for p, (top, best) in self.windows.items() if best.floor <= top}

    @property
    def floor(self):
        return min((best.floor for _, best in self.windows.values()), default=math.inf)

    def see(self, ids, labels, scores) -> None:
        hit = np.flatnonzero((labels != self.label) & (scores >= self.floor))
        ids, scores = ids[hit], scores[hit]
        for top, best in self.windows.values():
            fits = np.flatnonzero((scores <= top) & (scores >= best.floor))
            if len(fits):
                best.add(ids[fits], scores[fits])


def _visits(means, radii: dict, dims: int, exact_float: bool, finder, found, names: list[str]):
    """The work of a task: hold its candidates, let anchors walk them cluster by cluster."""
    def run(batches):
        held, group, labels, waiting, cluster = [], None, {}, [], None

        def walk():
            group.sort_for(cluster, means.value[cluster], radii.get(cluster, 0.0))
            finders = [finder(row, labels.get(row["label"], -1)) for row, _ in waiting]
            group.walk(np.stack([v for _, v in waiting]), finders)
            rows = [r for (row, _), f in zip(waiting, finders) for r in found(row, f)]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if isinstance(c[0], list) else pa.int64()) for c in zip(*rows)], names=names) if rows else None

        for batch in batches:
            kinds = np.asarray(batch.column("kind"))
            first = int(np.searchsorted(kinds, 1))
            if first:
                part = batch.slice(0, first)
                codes = [labels.setdefault(x, len(labels)) for x in part.column("label").to_pylist()]
                held.append((np.asarray(part.column("id")), np.array(codes), _matrix(part.column("v"), dims)))
            rest = batch.slice(first)
            if rest.num_rows and held:
                group = Candidates(*(np.concatenate(c) for c in zip(*held)), exact_float)
                held = []
            if not rest.num_rows or group is None:
                continue
            vectors = _matrix(rest.column("v"), dims)
            for row, v in zip(rest.drop_columns(["v"]).to_pylist(), vectors):
                if waiting and (row["cluster"] != cluster or len(waiting) >= MEMBERS):
                    if (out := walk()) is not None:
                        yield out
                cluster = row["cluster"]
                waiting.append((row, v))
        if waiting and (out := walk()) is not None:
            yield out

    return run


def mine(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "vector", label: str = "label",
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vector`` is an array of integers, the score of two rows their inner product. Higher
    scores come first, ties by smaller id. An anchor's positives are its first ``positives``
    other rows of the same label (all, if fewer); for each of them come the first
    ``negatives`` rows of other labels (all, if fewer) with ``low`` to ``high`` per cent of
    the positive's score; ``rank`` counts them from 1. A negative positive score has none.

    Rows with a null id, label, vector or component take no part. Rows of one id are one
    row, the smallest by (label, vector). A shorter vector ends in zeros. Only the three
    columns (and those of ``is_anchor``) are read; an empty table gives no rows. Scores
    that may not fit 64 bits are an error.

    A task holds one group of at most ``GROUP_BYTES`` of candidates and ``MEMBERS`` anchors;
    centroids are learned from at most ``SAMPLE_BYTES`` of anchors. Every row is a candidate
    of every anchor, so anchors travel to all groups; the walks decide what is scored.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = (F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(~F.exists(vector, lambda x: x.isNull()), F.lit(False)))
    rows = vectors.filter(usable).select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<long>").alias("v"),
                                         F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    points = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row"), F.max("anchor").alias("anchor"))
    points = stored(points.select("id", "row.label", "row.v", "anchor"), "mips-points")
    size = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    n, asked, dims, top = points.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(size), F.lit(0.0))).first()
    dims = max(1, dims)
    if dims * top * top >= 2.0 ** 63 / 100:
        raise OverflowError(f"scores of {dims} components up to {top} may not fit 64 bits")

    anchors = points.filter("anchor")
    take = min(SAMPLE, SAMPLE_BYTES // (8 * dims))
    rate = int((1 << 30) * min(1.0, take / max(1, asked)))
    sample = [r.v for r in anchors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate).orderBy("id").select("v").collect()]
    dense = np.zeros((len(sample), dims))
    for k, v in enumerate(sample):
        dense[k, :len(v)] = v
    means = spark.sparkContext.broadcast(centroids(dense, min(CLUSTERS, math.ceil(max(1, asked) / ANCHORS_PER_CLUSTER))))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                unit, norm = _unit(_matrix(batch.column("v"), dims))
                near = unit @ means.value.T
                own = near.argmax(axis=1)
                angle = np.where(norm > 0, np.arccos(np.clip(near.max(axis=1), -1, 1)), 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "v")), pa.array(own.astype(np.int32)), pa.array(angle)], names=["id", "label", "v", "cluster", "angle"])

    members = stored(anchors.mapInArrow(assign, "id long, label string, v array<long>, cluster int, angle double"), "mips-anchors")
    radii = {r.cluster: r.radius for r in members.groupBy("cluster").agg(F.max("angle").alias("radius")).collect()}
    groups = max(1, min(parts, n // GROUP_ROWS), math.ceil(n * dims * 8 / GROUP_BYTES))
    exact_float = dims * top * top < 2.0 ** 53
    none = F.lit(None).cast("array<long>")

    def visit(asking: DataFrame, finder, found, schema: str) -> DataFrame:
        mine_ = points.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), F.lit(-1).alias("cluster"), "id", "label", "v", none.alias("pids"), none.alias("pscores"))
        theirs = asking.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "cluster", "id", "label", "v", "pids", "pscores")
        dealt = mine_.unionByName(theirs).repartitionById(groups, F.col("g")).sortWithinPartitions("kind", "cluster", "id").drop("g")
        names = [c.split()[0] for c in schema.split(", ")]
        return dealt.mapInArrow(_visits(means, radii, dims, exact_float, finder, found, names), schema)

    near = visit(members.select("*", none.alias("pids"), none.alias("pscores")),
                 lambda row, code: Positives(row["id"], code, positives),
                 lambda row, f: [(row["id"], f.best.ids.tolist(), f.best.scores.tolist())] if len(f.best.ids) else [],
                 "anchor long, ids array<long>, scores array<long>")
    ranked = near.select("anchor", F.explode(F.arrays_zip("ids", "scores")).alias("c")).selectExpr(
        "anchor", "c.ids AS id", "c.scores AS score", "row_number() OVER (PARTITION BY anchor ORDER BY c.scores DESC, c.ids) AS n").filter(F.col("n") <= positives)
    listed = ranked.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("p"))
    asking = stored(members.join(listed, members["id"] == listed["anchor"]).select("id", "label", "v", "cluster", F.col("p.id").alias("pids"), F.col("p.score").alias("pscores")), "mips-positives")

    def windows(row, f):
        for pid, p in zip(row["pids"], row["pscores"]):
            if p in f.windows and len(f.windows[p][1].ids):
                best = f.windows[p][1]
                yield row["id"], pid, p, best.ids.tolist(), best.scores.tolist()

    hard = visit(asking, lambda row, code: Negatives(code, row["pscores"], negatives, low, high), windows,
                 "anchor_id long, positive_id long, positive_score long, ids array<long>, scores array<long>")
    return hard.select("anchor_id", "positive_id", "positive_score", F.explode(F.arrays_zip("ids", "scores")).alias("c")).selectExpr(
        "anchor_id", "positive_id", "row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY c.scores DESC, c.ids) AS rank",
        "c.ids AS negative_id", "positive_score", "c.scores AS negative_score").filter(F.col("rank") <= negatives)
