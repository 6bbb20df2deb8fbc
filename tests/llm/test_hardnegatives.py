import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgelake.llm import hardnegatives as H
from judgelake.llm.queries_hardnegatives import quantised

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, v string"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    rows = sorted({r[0]: r for r in sorted(((i, str(lab), list(map(int, v))) for i, v, lab in rows), reverse=True)}.values())
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, lab, v in rows:
        if not anchor(i):
            continue
        best = sorted((-dot(v, w), j, m == lab) for j, m, w in rows if j != i)
        for s, j, _ in [b for b in best if b[2]][:positives]:
            hits = [b for b in best if not b[2] and low * -s <= 100 * -b[0] <= high * -s][:negatives]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(hits)]
    return sorted(out)


def clean(rows):
    """What the contract keeps of raw rows, as integers."""
    out = []
    for i, v, lab, *_ in rows:
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(256 * x) for x in v], (lab + 1) % 10 if i % 7 == 0 else lab))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], lab, 1, "x") for i, v, lab in rows], SCHEMA)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def rows_of(seed, n, d=6, groups=5, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, d))
    return [(int(i), (middle[rng.integers(groups)] + spread * rng.normal(size=d)).round(2).tolist(), int(rng.choice(4, p=[.7, .1, .1, .1]))) for i in rng.permutation(4 * n)[:n]]


@pytest.mark.parametrize("group_rows,chunk,members", [(1024, 2048, 256), (40, 16, 3)])
def test_query_against_brute_force(spark, monkeypatch, group_rows, chunk, members):
    monkeypatch.setattr(H, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(H, "ANCHORS_PER_CLUSTER", 2)
    monkeypatch.setattr(H, "MEMBERS", members)
    monkeypatch.setattr(H.Candidates.walk, "__defaults__", (chunk,))
    rows = rows_of(1, 500) + [(3000 + k, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0], k % 3) for k in range(60)]  # a group of copies: ties
    bad = [(4000, None, 1), (4100, [1.0, None, 0, 0, 0, 0], 1), (4200, [math.nan, 1.0, 0, 0, 0, 0], 1), (4300, [math.inf, 1.0, 0, 0, 0, 0], 1), (4400, [1.0] * 6, None),
           (None, [1.0] * 6, 1), (4500, [0.0] * 6, 2), (4600, [-0.0, 0.001, 0, 0, 0, 0], 2), (4700, [], 1), (4800, [0.5, 0.3], 0), (-100, [0.4] * 6, 0)]
    rows += bad + rows[:20] + [(rows[0][0], [9.0] * 6, 9)]
    out = got(H.mine(quantised(frame(spark, rows)), F.col("vec_id") % 100 == 0))
    assert out == brute(clean(rows), lambda i: i % 100 == 0) and len(out) > 100


def test_other_parameters_labels_and_large_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [int(x) for x in rng.integers(-9, 10, 4) * 10**7], "abc"[i % 3]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, label string")
    out = got(H.mine(df, F.col("vec_id") < 9, positives=3, negatives=2, low=10, high=100))
    assert out == brute(rows, lambda i: i < 9, 3, 2, 10, 100) and out
    with pytest.raises(OverflowError):
        H.mine(spark.createDataFrame([(1, [1 << 40], "a")], df.schema), F.lit(True))


def test_few_rows_and_empty_tables(spark):
    one = frame(spark, [(0, [1.0, 2.0], 3)])
    assert got(H.mine(quantised(one), F.lit(True))) == [] and got(H.mine(quantised(one), F.lit(None).cast("boolean"))) == []
    assert got(H.mine(quantised(one.limit(0)), F.lit(True))) == []
    two = [(1, [1.0, 2.0], 3), (2, [1.0, 1.0], 3), (3, [0.5, 0.5], 4)]
    assert got(H.mine(quantised(frame(spark, two)), F.lit(True))) == brute(clean(two), lambda i: True) != []


def test_walks_end_early_and_bounds_hold():
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(12, 16)) * 200
    x = (np.repeat(middle, 500, axis=0) + rng.normal(size=(6000, 16)) * 10).astype(np.int64)
    group = H.Candidates(np.arange(6000), np.arange(6000) % 3, x, True)
    users = x[:40]  # of one cluster
    centre = H._unit(users.sum(axis=0, keepdims=True))[0][0]
    radius = float(np.arccos(H._unit(users)[0] @ centre).max())
    group.sort_for(0, centre, radius)
    exact = (x[group.order] @ users.T).max(axis=1)
    assert (exact <= group.bound * np.linalg.norm(users, axis=1).max() + H.SLACK).all()
    finders = [H.Positives(int(i), int(i % 3), 5) for i in range(40)]
    group.walk(users, finders, chunk=100)
    for i, f in enumerate(finders):
        s = x @ users[i]
        want = sorted((-s[j], j) for j in range(6000) if j % 3 == i % 3 and j != i)[:5]
        assert list(zip(-f.best.scores, f.best.ids)) == want
    assert group.scored < 0.2 * 40 * 6000
