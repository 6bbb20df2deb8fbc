"""The fixture sweep must reproduce the published curve (rows retyped below)."""

import pytest

from judgelake.operators import sweep as W

# Line, severity, is_real, category of three positive and three negative runs.
POSITIVE = [
    [(19, 1.88, 0.72, "bug-risk"), (13, 1.72, 0.55, "bug-risk"), (6, 2.93, 0.93, "bug-risk"), (9, 1.61, 0.51, "bug-risk"), (16, 2.16, 0.82, "bug-risk"), (26, 1.2, 0.63, "style")],
    [(19, 1.82, 0.71, "bug-risk"), (13, 1.69, 0.56, "bug-risk"), (6, 2.89, 0.93, "bug-risk"), (9, 1.64, 0.53, "bug-risk"), (16, 2.16, 0.81, "bug-risk"), (26, 1.2, 0.64, "style")],
    [(19, 1.85, 0.70, "bug-risk"), (13, 1.75, 0.54, "bug-risk"), (6, 2.91, 0.93, "bug-risk"), (9, 1.61, 0.52, "bug-risk"), (16, 2.16, 0.79, "bug-risk"), (26, 1.17, 0.65, "style")]]
NEGATIVE = [
    [(11, 0.27, 0.2, "style"), (16, 0.27, 0.18, "style"), (4, 0.04, 0.16, "style"), (2, 0.02, 0.19, "other"), (1, 1.12, 0.4, "style")],
    [(11, 0.24, 0.2, "style"), (16, 0.29, 0.18, "style"), (4, 0.04, 0.16, "style"), (2, 0.02, 0.19, "other"), (1, 1.05, 0.43, "style")],
    [(11, 0.23, 0.2, "style"), (16, 0.28, 0.19, "style"), (4, 0.05, 0.16, "style"), (2, 0.03, 0.19, "other"), (1, 1.11, 0.41, "style")]]
GOLDEN_LINES = [6, 13, 16, 20, 27]
CURVE = {0.30: 0.91, 0.35: 0.91, 0.40: 0.91, 0.45: 0.91, 0.50: 0.91, 0.55: 0.89, 0.60: 0.89, 0.65: 0.75, 0.70: 0.75}


def test_published_curve(spark):
    runs, judged = [], []
    for fixture, sample, sets in (("positive", 0, POSITIVE), ("negative", 1, NEGATIVE)):
        for k, units in enumerate(sets):
            runs.append((f"{fixture}{k}", sample, fixture))
            judged += [(f"{fixture}{k}", sample, i, "src/app.py", *u, "code-change", "code") for i, u in enumerate(units)]
    r = spark.createDataFrame(runs, "run_id string, sample_id int, fixture string")
    j = spark.createDataFrame(judged, "run_id string, sample_id int, ord bigint, file string, line int, severity double, is_real double, category string, rubric string, reflex_class string")
    g = spark.createDataFrame([(0, i, "src/app.py", line) for i, line in enumerate(GOLDEN_LINES)], "sample_id int, golden_idx bigint, file string, line int")
    curve, chosen, rules = W.sweep_decision(r, j, g)
    rows = {x.t: x for x in curve.collect()}
    assert {t: round(x.min_f1, 2) for t, x in rows.items()} == CURVE
    assert (rows[0.55].tp_lo, rows[0.55].tp_hi, rows[0.50].fp_pos_hi) == (4, 5, 1)
    assert all(x.fp_neg_mean == 0 for x in rows.values())
    assert chosen.collect()[0].asDict() == {"candidate": 0.40, "n_tied": 5}
    assert rules.collect()[0].asDict() == {"candidate": 0.40, "rule_neg_fp_ok": True, "rule_margin_ok": False, "change": False}


# Deletion false positives per dt and pull request of five clean field runs.
FIELD = {0.30: (2, 0, 3, 0, 0), 0.35: (2, 0, 3, 0, 0), 0.40: (2, 0, 3, 0, 0), 0.45: (1, 0, 3, 0, 0), 0.50: (1, 0, 3, 0, 0), 0.55: (0, 0, 1, 0, 0), 0.60: (0,) * 5, 0.65: (0,) * 5, 0.70: (0,) * 5}


def test_published_field_sweep(spark):
    prs, scores = [43, 44, 45, 46, 47], {43: [0.42, 0.53], 45: [0.51, 0.54, 0.57]}
    judged = [(f"r{pr}", 10 * pr + k, "src/a.py", pr, 2.0, s, "bug-risk", "deletion", "code") for pr, ss in scores.items() for k, s in enumerate(ss)]
    judged += [(f"r{prs[k % 5]}", 1000 + k, "src/a.py", k, 2.0, 0.5 + k / 100, "bug-risk", "code-change", "code") for k in range(13)]
    judged += [("r44", 2000, "src/a.py", 1, 2.0, 0.49, "bug-risk", "code-change", "code"), ("r44", 2001, "src/a.py", 1, 1.0, 0.9, "style", "deletion", "code"), ("r46", 2002, "tests/a.py", 1, 2.0, 0.9, "bug-risk", "deletion", "test")]
    j = spark.createDataFrame(judged, "run_id string, ord bigint, file string, line int, severity double, is_real double, category string, rubric string, reflex_class string")
    rows = W.field_sweep(j, spark.createDataFrame([(f"r{pr}", pr) for pr in prs], "run_id string, pr int"))
    got = {}
    for r in rows.collect():
        got.setdefault(r.dt, {})[r.pr] = (r.deletion_fp, r.code_fp)
    assert {t: tuple(v[pr][0] for pr in prs) for t, v in got.items()} == FIELD
    assert all(sum(c for _, c in v.values()) == 13 for v in got.values())
    totals = {r.dt: (r.deletion_total, r.code_total, r.decision) for r in W.field_decision(rows).collect()}
    assert totals[0.70] == (0, 13, "KEEP") and [totals[t][0] for t in sorted(totals)] == [5, 5, 5, 4, 4, 1, 0, 0, 0]


@pytest.mark.parametrize("field,value,reason", [
    ("judged_size", None, "no-judged-array"), ("fail_open", True, "fail-open"), ("judged_size", 3, "judged-count-differs"), ("n_dropped", None, "missing-counts"),
    ("n_unjudged", "true", "malformed-counts"), ("n_dropped", "1.0", "malformed-counts"), ("n_unjudged", "2", "incomplete-review"), ("packaging_version", "v08-ast", "packaging-version"),
    ("wire_format", "hunk_state-v1", "wire-format"), ("fixture_head", "", "no-head"), ("n_size_skipped_code", "4", None)])
def test_gate_reasons(spark, field, value, reason):
    base = {"judged_size": 5, "n_analyzed": 5, "fail_open": False, "base_verdict": "ok", "n_dropped": "0", "n_unjudged": "0", "n_size_skipped_code": "0", "verdict": "x",
            "packaging_version": "v09", "wire_format": "sites", "fixture_head": "h"}
    schema = "judged_size int, n_analyzed int, fail_open boolean, base_verdict string, n_dropped string, n_unjudged string, n_size_skipped_code string, verdict string, packaging_version string, wire_format string, fixture_head string"
    df = spark.createDataFrame([tuple({**base, field: value}.values())], schema)
    assert W.gate_runs(df).first().reject_reason == reason
