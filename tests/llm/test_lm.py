import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgelake.llm import lm
from judgelake.llm.queries_lm import op8_lm_score

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def base(rows, learned):
    c = Counter(t for k, x in rows if learned(k) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return {(k, x): (len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x))) for k, x in rows}


def test_base_against_plain_counts_and_model_is_better_held_out(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {k: v for (k, _), v in base(rows, lambda k: zlib.crc32(str(k).encode()) % 7 != 2).items()}
    out = op8_lm_score(spark, SF).collect()
    assert len(out) == len(rows)
    for r in out:
        n, known, total, b = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(b, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_few_frequent_counts_give_the_same(spark):
    rows = [(1, "a b a"), (1, "a b a"), (2, "b C"), (3, None), (4, ""), (None, "zz a"), (5, "x " * 50_000), (1, "other a")]
    df = spark.createDataFrame([(a, b, 1, "m") for a, b in rows], "doc_id long, text string, n int, mark string")
    want = sorted(((k, *v[:3], round(v[3], 6)) for k, v in ((r[0], base(rows, lambda k: k != 2)[r]) for r in rows)), key=repr)
    for bound in (0, 2, 100):
        out = lm.score(df, F.coalesce(F.col("doc_id") != 2, F.lit(True)), frequent=bound).collect()
        assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=repr) == want
        assert all(np.isfinite(r.score) and r.score < 1e-6 for r in out)


def test_normalisers_make_probabilities():
    rng = np.random.default_rng(0)
    near, far, bias = rng.normal(0, 2, (8, 7)), rng.normal(0, 2, (8, 7)), rng.normal(0, 1, 7)
    norm = lm.normalisers(near, far, bias)
    p = np.exp(near[:, None, :] + far[None, :, :] + bias - norm[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-5)


def test_empty_table_and_nothing_learned(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.score(df.limit(0), F.lit(True)).count() == 0
    r = lm.score(df, F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and np.isfinite(r.score)


def test_every_training_text_is_learned_from(spark):
    # equal texts, and more than any fixed sample would hold
    rows = spark.range(9_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "p q r").otherwise(F.concat(F.lit("s t "), F.col("id").cast("string"))).alias("text"))
    model = lm.Model(np.array([], np.int64), np.array([], np.int64), *[None] * 9, None)
    assert lm.triples(rows, model, 2).select(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] == 4 * 9_000
    out = lm.score(rows, F.lit(True))
    one = out.filter("doc_id % 3 > 0").select(F.min("score"), F.max("score"), F.min("base_score")).first()
    assert one[0] == one[1] > one[2] + 1
