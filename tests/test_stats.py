"""Selection without full orders: quantiles and hash shares against plain sorts."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from judgelake.operators import corpus as C
from judgelake.operators import stats as S


def test_quantiles_equal_numpy(spark):
    rng = random.Random(4)
    groups = {"one": [0.5], "two": [1.0, -2.0], "same": [3.0] * 40, "few": [rng.choice([0.0, 0.1, 0.2]) for _ in range(300)],
              "many": [rng.lognormvariate(0, 9) * rng.choice([-1, 1]) for _ in range(4000)], None: [float(k) for k in range(7)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("few", None), ("few", float("nan")), ("nothing", None)]
    rng.shuffle(rows)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    for accuracy in (50, 10_000):  # a rough sketch has wide brackets, the result is the same
        out = {r.g: r for r in S.exact_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), "x", ["g"], shares, accuracy).collect()}
        assert set(out) == set(groups)
        for g, vs in groups.items():
            assert out[g].n == len(vs) and np.allclose(out[g].q, np.quantile(vs, shares), rtol=1e-12, atol=0), g


def test_large_group_of_distinct_values(spark):
    n = 400_001
    df = spark.range(n).select((F.col("id") * 7919 % n / F.lit(8.0)).alias("x"), F.lit("g").alias("g"))
    out = S.exact_quantiles(df, "x", ["g"], (0.25, 0.5, 0.75)).collect()
    assert [r.q for r in out] == [[n // 4 / 8, n // 2 / 8, 3 * (n // 4) / 8]]


def test_hash_share_equals_a_full_order(spark):
    for n, frac, digits in ((1, 0.2, 5), (7, 0.5, 1), (500, 0.2, 1), (500, 0.2, 5), (500, 1.0, 2)):
        ids = [f"c{k}" for k in range(n)]
        df = spark.createDataFrame([(i,) for i in ids], "id string")
        key = F.sha2(F.concat(F.lit("3:"), "id"), 256)
        cut = C.hash_cut(df, key, "id", frac, digits)
        got = {r.id for r in df.filter(F.struct(key.alias("h"), F.col("id").alias("tie")) <= cut).collect()}
        order = sorted(ids, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())
        assert got == set(order[:max(1, round(n * frac))]), (n, frac)
    none = spark.createDataFrame([], "id string")
    assert none.filter(F.col("id") <= C.hash_cut(none, F.col("id"), "id", 0.2)["h"]).count() == 0


def test_rolling_rate_equals_a_plain_loop_where_all_rows_share_a_time(spark):
    rng = random.Random(5)
    rows = [("hot", "2024-01-01 00:00:00", k, rng.random() < 0.4) for k in range(3000)]
    rows += [(c, f"2024-01-0{rng.randrange(1, 9)} 10:00:0{rng.randrange(9)}", k, rng.random() < 0.7) for c in ("a", "b", None) for k in range(70)]
    rows += [("one", "2024-01-01 00:00:00", 1, True), ("one", "2024-01-01 00:00:00", 1, False)]
    want = {}
    for c in {r[0] for r in rows}:
        of = sorted(r[1:] for r in rows if r[0] == c)
        for pos in range(len(of)):
            last = [x[2] for x in of[max(0, pos - 9):pos + 1]]
            want[c, pos] = (of[pos][1], len(last), sum(last) / len(last))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "class string, ts string, id int, sustained boolean").withColumn("ts", F.to_timestamp("ts")).repartition(5)
    for chunk in (10, 37, 100_000):
        assert {(r["class"], r.pos): (r.id, r.n_window, r.rate) for r in S.rolling_rate(df, chunk=chunk).collect()} == want
    assert S.rolling_rate(df.limit(0)).count() == 0


def test_a_class_at_one_time_is_spread_over_parts(spark):
    df = spark.range(40_000, numPartitions=8).select(F.lit("hot").alias("class"), F.lit(0).alias("t"), F.col("id").alias("id"))
    placed = S.with_position(df, "class", ["t", "id"], parts=8)
    sizes = [r["count"] for r in placed.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    assert placed.filter("pos = id").count() == 40_000 and len(sizes) > 4 and max(sizes) < 10_000
