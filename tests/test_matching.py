"""Matching rule: literal cases, and random runs against a plain greedy loop."""

import random

import pytest

from judgelake.operators import matching
from judgelake.operators.evaluation import golden_metrics
from judgelake.operators.matching import match_findings

REP = "run_id string, sample_id int, file string, line int, ord bigint"
GOLD = "sample_id int, file string, line int, golden_idx bigint"


def greedy(reported, golden):
    pairs = sorted((abs(r[0] - g[0]), g[0], r[1], g[1]) for r in reported for g in golden if abs(r[0] - g[0]) <= 1)
    used_r, used_g, out = set(), set(), set()
    for _, _, i, j in pairs:
        if i not in used_r and j not in used_g:
            used_r.add(i)
            used_g.add(j)
            out.add((i, j))
    return out


def run_cases(spark, cases):
    rep = [(f"c{c}", c, "a.py", line, i) for c, (r, _) in enumerate(cases) for i, line in enumerate(r)]
    gold = [(c, "a.py", line, j) for c, (_, g) in enumerate(cases) for j, line in enumerate(g)]
    rows = match_findings(spark.createDataFrame(rep, REP), spark.createDataFrame(gold, GOLD), ["run_id"], ["sample_id"]).collect()
    got = {c: set() for c in range(len(cases))}
    for r in rows:
        assert abs(r.line - r.golden_line) == r.distance
        assert cases[r.sample_id][0][r.ord] == r.line and cases[r.sample_id][1][r.golden_idx] == r.golden_line
        got[r.sample_id].add((r.ord, r.golden_idx))
    return got


def test_literal_cases(spark):
    cases = [([10, 11], [9, 11]), ([11, 12], [10, 12]), ([10], [11, 9]), ([10], [12]), ([5, 5, 5], [5, 5]), ([5], [5, 5, 6])]
    got = run_cases(spark, cases)
    assert len(got[0]) == 2
    assert got[1] == {(0, 0), (1, 1)}
    assert got[2] == {(0, 1)}
    assert got[3] == set()
    assert got[4] == {(0, 0), (1, 1)}
    assert got[5] == {(0, 0)}


def test_random_runs_equal_the_greedy_loop(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(400):
        width = rng.choice([3, 6, 12, 25])
        cases.append(([rng.randrange(width) for _ in range(rng.randrange(1, 14))], [rng.randrange(width) for _ in range(rng.randrange(1, 14))]))
    got = run_cases(spark, cases)
    for c, (r, g) in enumerate(cases):
        want = greedy([(line, i) for i, line in enumerate(r)], [(line, j) for j, line in enumerate(g)])
        assert got[c] == want, (c, r, g)


@pytest.mark.parametrize("piece_bits", [1, 2, 3])
def test_long_chains_in_small_pieces_equal_the_greedy_loop(spark, monkeypatch, piece_bits):
    monkeypatch.setattr(matching, "PIECE_BITS", piece_bits)
    rng = random.Random(piece_bits)
    cases = []
    for _ in range(120):
        start, length, many = rng.choice([-37, 0, 5]), rng.choice([20, 60, 90]), rng.choice([1, 3])
        gaps = rng.choice([0.0, 0.05, 0.3])
        lines = [start + k for k in range(length)]
        rep = [line for line in lines for _ in range(rng.randrange(0, many + 1)) if rng.random() >= gaps]
        rng.shuffle(rep)
        gold = [line for line in lines if (line % 2 == 0 or rng.random() < 0.2) and rng.random() >= gaps for _ in range(rng.randrange(1, many + 1))]
        cases.append((rep or [start], gold or [start]))
    got = run_cases(spark, cases)
    for c, (r, g) in enumerate(cases):
        assert got[c] == greedy([(line, i) for i, line in enumerate(r)], [(line, j) for j, line in enumerate(g)]), c


def test_labels_on_every_second_line_of_one_file(spark):
    n = 100_000  # 25 pieces
    rng = random.Random(8)
    order = rng.sample(range(n), n)  # the finding on line 2k + 1
    labels = [rng.choice([1, 1, 1, 2, 2, 0] if k % 5000 == 0 else [1, 1, 2]) for k in range(n)]  # on line 2k
    gold = [(0, "a", 2 * k, 2 * k + j) for k in range(n) for j in range(labels[k])]
    rep = spark.createDataFrame([("c", 0, "a", 2 * k + 1, order[k]) for k in range(n)], REP)
    got = {(r.golden_line, r.ord) for r in match_findings(rep, spark.createDataFrame(gold, GOLD), ["run_id"], ["sample_id"]).collect()}
    want, gone = set(), True
    for k in range(n):
        near = sorted(([] if gone else [order[k - 1]]) + [order[k]])[:labels[k]]
        want |= {(2 * k, o) for o in near}
        gone = order[k] in near
    assert got == want


def test_metrics_are_null_where_undefined(spark):
    rep = spark.createDataFrame([("c1", 1, "a.py", 10, 0)], REP)
    gold = spark.createDataFrame([(0, "a.py", 5, 0), (1, "a.py", 12, 0)], GOLD)
    runs = spark.createDataFrame([("c0", 0), ("c1", 1), ("c2", 2)], "run_id string, sample_id int")
    m = match_findings(rep, gold, ["run_id"], ["sample_id"])
    out = {r.run_id: r for r in golden_metrics(runs, rep, gold, m, ["run_id"], ["sample_id"]).collect()}
    assert (out["c0"].precision, out["c0"].recall, out["c0"].f1) == (None, 0.0, None)
    assert (out["c1"].precision, out["c1"].recall, out["c1"].f1) == (0.0, 0.0, None)
    assert (out["c2"].precision, out["c2"].recall) == (None, None)
