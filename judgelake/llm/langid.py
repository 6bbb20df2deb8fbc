"""Language identification: known words by log frequency, unseen words by backoff to
shorter character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The model is fitted on at most about this many labelled rows, drawn by a hash of the
#: text; all other parts of the operator see every row.
TRAIN_ROWS = 20_000
#: Words kept for each language, and the longest n-gram.
WORDS_A_LANG, LONGEST = 50_000, 4
UND = "und"
_WORDS = re.compile(r"[^\W\d_]+")
#: Words without a row whose logs a task keeps, and texts that it holds as strings at one time.
_CACHE, _TEXTS = 20_000, 256


@dataclass
class Model:
    """``words`` and ``grams[n]`` give rows of the log frequency tables, a column a language."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        """Mean over the word's known n-grams of the longest length that has any; zeros if none."""
        marked = f" {word} "
        for n in range(min(LONGEST, len(marked)), 0, -1):
            at = [k for i in range(len(marked) - n + 1) if (k := self.grams.get(marked[i:i + n])) is not None]
            if at:
                return self.gram_logs[at].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Counts by language in Spark, over a sample of about ``rows`` rows at most.

    Rows with null text or null language teach nothing. What the driver gets is bounded
    by ``WORDS_A_LANG`` words a language and by the n-grams of the sample.
    """
    known = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    words = (known.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
             .groupBy("lang", "word").count())
    marked = F.concat(F.lit(" "), "word", F.lit(" "))

    def pieces_of(n: int):
        starts = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))

    pieces = F.flatten(F.array(*map(pieces_of, range(1, LONGEST + 1))))
    grams = words.select("lang", "count", F.explode(pieces).alias("g")).groupBy("lang", "g").agg(F.sum("count").alias("count")).filter("count > 1 and g <> ' '")
    top = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top_words = words.filter("count > 1").withColumn("r", F.row_number().over(top)).filter(F.col("r") <= WORDS_A_LANG).drop("r")
    w, g = top_words.toPandas(), grams.toPandas()
    langs = sorted(set(w["lang"]) | set(g["lang"]))
    return Model(langs, *_logs(w["word"], w, langs), *_logs(g["g"], g, langs))


def _logs(names, counts, langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Smoothed log frequencies: half a count is added to each entry in each language.

    ``names`` and ``counts`` are a pandas series and frame; workers, which load this module
    for the model, do not need pandas.
    """
    import pandas as pd

    order = pd.Index(sorted(set(names)))
    table = np.full((len(order), len(langs)), 0.5)
    np.add.at(table, (order.get_indexer(names), [langs.index(x) for x in counts["lang"]]), counts["count"].to_numpy(float))
    return {name: i for i, name in enumerate(order)}, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score (share of the likelihood, 0 to 1), one row per input row.

    Null text, text without a letter, and a model that learned no language give ``und``
    with score 0. Ties go to the first language in order. Only ``text`` is used; other
    columns are not read. Rows stay where they are: no shuffle, batches of bounded memory.
    """
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    at = keep.index(text) if text in keep else len(keep)

    def run(batches):
        m, fresh = shared.value, {}
        for whole in batches:
            for start in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(start, _TEXTS)
                found = [_one(m, fresh, t) for t in batch.column(at).to_pylist()]
                out = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(batch.columns[:len(keep)] + out, names=schema.names)

    return docs.select(*keep, *([] if text in keep else [text])).mapInArrow(run, schema)


def _one(m: Model, fresh: dict[str, np.ndarray], text: str | None) -> tuple[str, float]:
    words = _WORDS.findall(text.lower()) if isinstance(text, str) else []
    if not m.langs or not any(c.isalpha() for w in words for c in w):
        return UND, 0.0
    get, at, total = m.words.get, [], np.zeros(len(m.langs))
    for w in words:
        k = get(w)
        if k is not None:
            at.append(k)
            continue
        v = fresh.get(w)
        if v is None:
            if len(fresh) >= _CACHE:
                fresh.clear()
            v = fresh[w] = m.unseen(w)
        total += v
    if at:
        total += m.word_logs[at].sum(axis=0, dtype=float)
    p = np.exp(total - total.max())
    best = int(np.argmax(p))
    return m.langs[best], float(p[best] / p.sum())
