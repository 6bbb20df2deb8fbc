"""Fail-open rule against the two-counter machine on every short outcome sequence."""

import itertools

import pandas as pd

from judgelake.operators import judging as J


def two_counters(outcomes):
    failures = shapes = 0
    for o in outcomes:
        if o == "leaf":
            continue
        if o == "transport":
            failures += 1
        else:
            failures = 0
            if o == "ok":
                shapes = 0
            else:
                shapes += 1
                failures += 1
        if failures >= 2 or shapes >= 2:
            return True
    return "ok" not in outcomes and "leaf" not in outcomes


def test_fail_open_equals_the_counters(spark):
    seqs = [s for n in range(1, 6) for s in itertools.product(["ok", "transport", "shape", "leaf"], repeat=n)]
    rows = [(i, k, o) for i, s in enumerate(seqs) for k, o in enumerate(s)]
    got = {r.run_id: r.fail_open for r in J.fail_open(spark.createDataFrame(rows, "run_id int, ord int, outcome string")).collect()}
    for i, s in enumerate(seqs):
        assert got[i] == two_counters(s), s


def test_a_scorer_gets_few_states_at_a_time(spark):
    def scorer(states):
        n = len(states)
        return pd.DataFrame({"payload": [None if x is None else f"{n}:{x}" for x in states["state"]], "latency_ms": [float("nan") if x is None else 1.5 for x in states["state"]]})

    rows = [(None if k == 4 else k, f"k{k}", None if k % 7 == 0 else f"s{k}", "q") for k in range(600)]
    units = spark.createDataFrame(rows, "unit_id bigint, name string, state string, questions string").coalesce(1)
    got = J.score_units(units, scorer, ["unit_id", "name"]).collect()
    assert [(r.unit_id, r.name) for r in got] == [r[:2] for r in rows]
    assert all(r.payload is None and r.latency_ms is None if x[2] is None else r.payload.endswith(f":{x[2]}") and r.latency_ms == 1.5 for r, x in zip(got, rows))
    assert max(int(r.payload.split(":")[0]) for r in got if r.payload) <= J.SCORED_ROWS
