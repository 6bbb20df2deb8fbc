"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

The model speaks over the most frequent words, one class for all others, and the end of
the text. The vector predicted from the two tokens before is a linear map of each one's
vector; a token's energy is its product with that vector, plus a bias. As energies are
sums over the two context tokens, matrix products give every normaliser once, and a text
is scored by lookups. A word of the common class also pays its smoothed frequency there.
Counts and weights come from all training texts: every task learns from the triples of its
own texts, and the weights of all tasks are averaged after each epoch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import stored
from judgelake.llm.fingerprints import U, mix, word_marks

#: Words of the model.
VOCABULARY = 1000
#: Tokens whose triples a task counts together, triples a stored row, and rows of summed
#: weights that reach the driver.
CHUNK, RUN, SUMS = 1_000_000, 65_536, 8
DIMENSIONS, NOISE, EPOCHS, BATCH, RATE = 32, 128, 2, 2048, 0.05
#: Counts sent to every task: those of the most frequent words, at most this many.
FREQUENT = 200_000
OTHER, END = 0, 1
END_MARK = int(mix(np.array([0xE0D], U)).view(np.int64)[0])


def tally(texts: DataFrame) -> DataFrame:
    """mark, c: how often each word, and the end, occurs in the column ``text``.

    Each task counts its own words first, so a frequent word is one row a task when it
    is shuffled. Null texts are empty: they have an end only.
    """
    def run(batches):
        held, n_held = [], 0

        def counted():
            marks, counts = np.concatenate([m for m, _ in held]), np.concatenate([c for _, c in held])
            order = np.argsort(marks, kind="stable")
            marks, counts = marks[order], counts[order]
            at = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
            return marks[at], np.add.reduceat(counts, at)

        for batch in batches:
            if not batch.num_rows:
                continue
            words = [word_marks(t).view(np.int64) for t in batch.column(0).to_pylist()]
            marks, counts = np.unique(np.concatenate([*words, np.full(len(words), END_MARK)]), return_counts=True)
            held.append((marks, counts))
            n_held += len(marks)
            if n_held > 4_000_000:  # what one task holds stays bounded; the rest is summed after the shuffle
                marks, counts = counted()
                yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array(counts)], names=["mark", "c"])
                held, n_held = [], 0
        if held:
            marks, counts = counted()
            yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array(counts)], names=["mark", "c"])

    return texts.select("text").mapInArrow(run, "mark long, c long").groupBy("mark").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Energies by previous token, by the one before it, and normalisers of both together.

    ``marks`` are the fingerprints of the model's words in order, ``ids`` their classes.
    Class number ``len(bias)`` stands before the text. ``tail`` is the denominator of
    words of the common class; ``often`` and ``often_c`` are counts of the model's words, the
    end, and all words that occur ``least`` times or more.
    """

    marks: np.ndarray
    ids: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray
    norm: np.ndarray
    tail: float
    base: float
    total: int
    often: np.ndarray
    often_c: np.ndarray
    least: int | None

    def classes(self, marks: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.marks, marks), max(0, len(self.marks) - 1))
        return np.where(self.marks[at] == marks, self.ids[at], OTHER) if len(self.marks) else np.full(len(marks), OTHER)

    def log_probs(self, c: np.ndarray) -> np.ndarray:
        """Natural log probability of every class of one text's sequence, the end included."""
        start = len(self.bias)
        one, two = np.concatenate([[start], c[:-1]]), np.concatenate([[start, start], c[:-2]])[:len(c)]
        return self.near[one, c].astype(float) + self.far[two, c] + self.bias[c] - self.norm[one, two]


def begin(share: np.ndarray, seed: int = 11) -> list[np.ndarray]:
    """Weights before training (words, words ahead, two maps, biases), then Adagrad's sums."""
    rng, k, d = np.random.default_rng(seed), len(share), DIMENSIONS
    params = [rng.normal(0, 0.1, (k + 1, d)), rng.normal(0, 0.1, (k, d)), np.eye(d) * 0.5, np.eye(d) * 0.5, np.log(share)]
    return params + [np.full(p.shape, 0.1) for p in params]


def scattered(rows: int, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` summed into row ``at`` of a new array."""
    order = np.argsort(at, kind="stable")
    names = at[order]
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    out = np.zeros((rows, x.shape[1]))
    out[names[starts]] = np.add.reduceat(x[order], starts, axis=0)
    return out


def learned_from(state: list[np.ndarray], triples: np.ndarray, counts: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> None:
    """One pass of noise-contrastive estimation (Adagrad) over triples and their counts, in place.

    ``share`` is each class's frequency: the noise. Noise is drawn once a batch and shared
    by its triples, so both sides are matrix products.
    """
    k, params, memory = len(share), state[:5], state[5:]
    word, ahead, *maps, bias = params
    log_noise, cdf = np.log(NOISE * share), np.cumsum(share)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    order = rng.permutation(len(triples))
    for at in range(0, len(order), BATCH):
        b = order[at:at + BATCH]
        context, w = np.divmod(triples[b], k)
        v, u = np.divmod(context, k + 1)
        c = counts[b].astype(float)
        noise = np.minimum(np.searchsorted(cdf, rng.random(NOISE) * cdf[-1]), k - 1)
        hidden = word[u] @ maps[0] + word[v] @ maps[1]
        true = (sig(np.einsum("ij,ij->i", hidden, ahead[w]) + bias[w] - log_noise[w]) - 1) * c
        fake = sig(hidden @ ahead[noise].T + bias[noise] - log_noise[noise]) * c[:, None]
        dh = true[:, None] * ahead[w] + fake @ ahead[noise]
        grads = [scattered(k + 1, u, dh @ maps[0].T) + scattered(k + 1, v, dh @ maps[1].T), scattered(k, w, true[:, None] * hidden),
                 word[u].T @ dh, word[v].T @ dh, np.zeros_like(bias)]
        np.add.at(grads[1], noise, fake.T @ hidden)
        np.add.at(grads[4], w, true)
        np.add.at(grads[4], noise, fake.sum(axis=0))
        for p, g, m in zip(params, grads, memory):
            g /= c.sum() ** 0.5
            m += g * g
            p -= RATE * g / np.sqrt(m)


def triples(learn: DataFrame, model: Model, k: int) -> DataFrame:
    """triples, counts: lists of (two before, one before, token) by class, as one number,
    and how often each is in a run of about ``CHUNK`` tokens of one task."""
    def counted(held):
        found, n = np.unique(np.concatenate(held), return_counts=True)
        order = np.random.default_rng(7).permutation(len(found))
        for at in range(0, len(order), RUN):
            b = order[at:at + RUN]
            ends = pa.array([0, len(b)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x[b].astype(np.int64))) for x in (found, n)], names=["triples", "counts"])

    def run(batches):
        held, n_held = [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                c = np.concatenate([[k, k], model.classes(word_marks(t).view(np.int64)), [END]]).astype(np.int64)
                held.append((c[:-2] * (k + 1) + c[1:-1]) * k + c[2:])
                n_held += len(c) - 2
                if n_held > CHUNK:
                    yield from counted(held)
                    held, n_held = [], 0
        if held:
            yield from counted(held)

    return learn.select("text").mapInArrow(run, "triples array<long>, counts array<long>")


def fit(found: DataFrame, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """near, far, bias from stored ``triples``: in each epoch every task learns from all of its
    rows, starting from the same weights, and the results are averaged by their tokens
    (iterative parameter mixing). At most ``SUMS`` rows of weights reach the driver.
    """
    state, spark = begin(share), found.sparkSession
    shapes = [x.shape for x in state]
    cuts = np.cumsum([x.size for x in state])[:-1]

    def summed(batches):
        tokens, total = 0, None
        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, total = tokens + n, np.frombuffer(x) * 1.0 if total is None else total + np.frombuffer(x)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([total.tobytes()], pa.binary())], names=["tokens", "weights"])

    for epoch in range(EPOCHS):
        shared = spark.sparkContext.broadcast((state, epoch))

        def learn(batches):
            (before, e), tokens = shared.value, 0
            mine, rng = [x.copy() for x in before], np.random.default_rng(11 + e)
            for batch in batches:
                for row in range(batch.num_rows):
                    t, c = (batch.column(i)[row].values.to_numpy() for i in (0, 1))
                    learned_from(mine, t, c, share, rng)
                    tokens += int(c.sum())
            if tokens:
                flat = np.concatenate([x.ravel() for x in mine]) * tokens
                yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([flat.tobytes()], pa.binary())], names=["tokens", "weights"])

        kind = "tokens long, weights binary"
        rows = found.mapInArrow(learn, kind).repartition(SUMS).mapInArrow(summed, kind).collect()
        shared.unpersist()
        if not rows:
            break
        # rounded, as the order of a sum is not fixed
        mean = np.round(sum(np.frombuffer(r.weights) for r in rows) / sum(r.tokens for r in rows), 9)
        state = [x.reshape(shape) for x, shape in zip(np.split(mean, cuts), shapes)]
    word, ahead, first, second, bias = state[:5]
    if not sum(r.tokens for r in rows):
        return np.zeros((len(share) + 1, len(share))), np.zeros((len(share) + 1, len(share))), np.log(share)
    return word @ first @ ahead.T, word @ second @ ahead.T, bias


def normalisers(near: np.ndarray, far: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Log of the summed energies for every pair of context classes, by blocks of products."""
    top = far.max(axis=1) + bias.max()
    right = np.exp(far + bias - top[:, None]).T
    out = np.empty((len(near), len(far)))
    for at in range(0, len(near), 256):
        peak = near[at:at + 256].max(axis=1)
        out[at:at + 256] = np.log(np.maximum(np.exp(near[at:at + 256] - peak[:, None]) @ right, 1e-300)) + peak[:, None] + top
    return out


def train(learn: DataFrame, counts: DataFrame, vocabulary: int = VOCABULARY, frequent: int = FREQUENT) -> Model:
    """The model from training texts (column ``text``) and their stored ``counts``.

    Bounded on the driver: the model's words, the counts of frequent words and ``SUMS`` rows of
    the model's weights, whose size follows from the number of its words only.
    """
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = counts.filter(F.col("mark") != END_MARK).orderBy(F.desc("c"), "mark").limit(vocabulary).toPandas()
    ends = (counts.filter(F.col("mark") == END_MARK).agg(F.sum("c")).first()[0]) or 0
    # the least count such that at most ``frequent`` words have it or more
    levels, kept, least = counts.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).toPandas(), 0, None
    for c, k in zip(levels["c"], levels["k"]):
        kept += k
        if kept > frequent:
            break
        least = int(c)
    often = counts.filter(F.col("c") >= (1 << 62 if least is None else least)).toPandas()
    often = pd.concat([often, head, pd.DataFrame({"mark": [END_MARK], "c": [ends]})]).astype("int64").drop_duplicates("mark").sort_values("mark")
    rest = int(total) - int(head["c"].sum()) - int(ends)
    share = np.array([rest, ends, *head["c"]], float) + 0.5
    order = np.argsort(head["mark"].to_numpy(np.int64))
    marks, ids = head["mark"].to_numpy(np.int64)[order], order + 2
    model = Model(marks, ids, None, None, None, None, np.log10(rest + max(0, int(kinds) - len(head) - (ends > 0)) + 1), np.log10(int(total) + int(kinds) + 1),
                  int(total), often["mark"].to_numpy(np.int64), often["c"].to_numpy(np.int64), least)
    near, far, model.bias = fit(stored(triples(learn, model, len(share)), "lm-triples"), share / share.sum())
    model.near, model.far = near.astype(np.float32), far.astype(np.float32)
    model.norm = normalisers(model.near.astype(float), model.far.astype(float), model.bias)
    return model


def score(documents: DataFrame, learned: Column, doc_id: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, one row per input row.

    Rows where ``learned`` is true are learned from. Null texts are empty and have their
    end only. Repeated rows all get their row and, in training, all count. Without any
    training text every count is 0 and the model is uniform. Only ``doc_id``, ``text`` and
    what ``learned`` reads are used. Scores are log10 probabilities of whole texts. Rare
    words get their counts by a join on the word; frequent ones from a bounded table, so
    no frequent word is a join key.
    """
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))
    learn = docs.filter("learned").select("text")
    counts = stored(tally(learn), "lm-counts")
    model = train(learn, counts, **bounds)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = "did long, part int, doc long, n long, known long, logs double, lbl double, n_other long, logs_model double, rare array<long>"

    def run(batches):
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                marks = [np.append(word_marks(t).view(np.int64), END_MARK) for t in rows.column(3).to_pylist()]
                out = []
                for x in marks:
                    c = m.classes(x)
                    c[-1] = END
                    spot = np.minimum(np.searchsorted(m.often, x), len(m.often) - 1)
                    held = m.often[spot] == x
                    n, other = np.where(held, m.often_c[spot], 0), c == OTHER
                    logs = np.log10(n + 1)
                    out.append((len(x), int((n > 0).sum()), float(logs.sum()), float(m.log_probs(c).sum() / np.log(10)), int(other.sum()),
                                float(logs[other].sum()), x[~held]))
                cols = list(zip(*out))
                ends = np.cumsum([0, *map(len, cols[6])], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), rows.column(2)] + [pa.array(c, t) for c, t in zip(cols[:6], (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()))]
                    + [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cols[6]).astype(np.int64)))],
                    names=["did", "part", "doc", "n", "known", "logs", "lbl", "n_other", "logs_model", "rare"])

    keyed = docs.select(F.coalesce("doc", F.lit(-(1 << 62))).alias("did"), F.coalesce(F.hash("text"), F.lit(0)).alias("part"), "doc", "text")
    parts = stored(keyed.mapInArrow(run, schema), "lm-parts")
    rare = parts.select("did", "part", F.explode("rare").alias("mark"))
    seen = counts if model.least is None else counts.filter(F.col("c") < model.least)
    sums = (rare.join(seen, "mark").groupBy("did", "part").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_logs"), F.count("*").alias("rare_known"))
            .join(parts.groupBy("did", "part").agg(F.count("*").alias("copies")), ["did", "part"])
            .select("did", "part", (F.col("rare_logs") / F.col("copies")).alias("rare_logs"), (F.col("rare_known") / F.col("copies")).cast("long").alias("rare_known")))
    all_logs, other_logs = F.coalesce("rare_logs", F.lit(0.0)) + F.col("logs"), F.coalesce("rare_logs", F.lit(0.0)) + F.col("logs_model")
    return parts.join(sums, ["did", "part"], "left").select(
        F.col("doc").alias(doc_id), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (all_logs - F.col("n") * float(model.base)).alias("base_score"),
        (F.col("lbl") + other_logs - F.col("n_other") * float(model.tail)).alias("score"))
