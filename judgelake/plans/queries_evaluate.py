"""Registered queries: matching, corpus scoring, regressions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.operators import evaluation as E
from judgelake.operators import scoring as S
from judgelake.operators.compose import compose, gate, rank_and_cap, with_levels
from judgelake.operators.matching import match_findings
from judgelake.plans import views as V
from judgelake.plans.queries_compose import LEVEL, reported_sql, verdict_sql
from judgelake.plans.registry import query

RUN, SAMPLE = ["run_id"], ["sample_id"]
GRID_SQL = "(VALUES " + ", ".join(f"({t}e0)" for t in K.THRESHOLD_GRID) + ") g(t)"

# Check SQL for the matching rule: walk each file's pairs in greedy order, one
# pair a step, carrying the used findings and labels.
REPORTED = f"rep AS (SELECT 0.5e0 AS t, * FROM ({reported_sql()}))"
REPORTED_GRID = ("rep AS (SELECT g.t, j.* FROM v_judged j, " + GRID_SQL + " WHERE j.is_real >= CASE WHEN rubric = "
                 "'deletion' THEN 0.7e0 ELSE g.t END AND coalesce(severity, 0) >= 1 AND reflex_class <> 'test')")
GREEDY = """
edges AS (
  SELECT r.run_id, r.t, r.sample_id, r.file, r.ord, r.line, g.golden_idx, g.line AS golden_line, abs(r.line - g.line) AS distance,
    row_number() OVER (PARTITION BY r.run_id, r.t, r.file ORDER BY abs(r.line - g.line), g.line, r.ord, g.golden_idx) AS step
  FROM rep r JOIN v_golden g ON r.sample_id = g.sample_id AND r.file = g.file AND abs(r.line - g.line) <= 1),
walk(run_id, t, file, step, ords, golds, ord, golden_idx, kept) AS (
  SELECT run_id, t, file, step, [ord], [golden_idx], ord, golden_idx, TRUE FROM edges WHERE step = 1
  UNION ALL
  SELECT e.run_id, e.t, e.file, e.step,
    CASE WHEN list_contains(w.ords, e.ord) OR list_contains(w.golds, e.golden_idx) THEN w.ords ELSE list_append(w.ords, e.ord) END,
    CASE WHEN list_contains(w.ords, e.ord) OR list_contains(w.golds, e.golden_idx) THEN w.golds ELSE list_append(w.golds, e.golden_idx) END,
    e.ord, e.golden_idx, NOT (list_contains(w.ords, e.ord) OR list_contains(w.golds, e.golden_idx))
  FROM walk w JOIN edges e ON w.run_id = e.run_id AND w.t = e.t AND w.file = e.file AND e.step = w.step + 1),
matches AS (SELECT e.* FROM walk w JOIN edges e USING (run_id, t, file, step) WHERE w.kept)
"""


def match_sql(body: str, views: str = "v_judged v_golden", grid: bool = False) -> str:
    return V.sql_with(views, f"WITH {REPORTED_GRID if grid else REPORTED}, {GREEDY}{body}", recursive=True)


def _reported(spark, sf):
    return compose(V.judged(spark, sf))


def _matches(spark, sf, reported=None):
    return match_findings(_reported(spark, sf) if reported is None else reported, V.golden(spark, sf), RUN, SAMPLE)


@query("f1_match_findings", match_sql("""
SELECT run_id, sample_id, file, ord, line, golden_idx, golden_line, CAST(distance AS INTEGER) AS distance FROM matches"""))
def f1(spark, sf):
    return _matches(spark, sf)


@query("f1_match_grid", match_sql("""
SELECT t, run_id, count(*) AS tp, count(*) FILTER (WHERE distance = 0) AS tp_exact FROM matches GROUP BY t, run_id""", grid=True))
def f1_grid(spark, sf):
    rep = with_levels(V.judged(spark, sf)).filter("reported_to > 0")
    pairs = match_findings(rep, V.golden(spark, sf), ["run_id"], SAMPLE, level="reported_to")
    counts = pairs.groupBy("k", "run_id").agg(F.count(F.lit(1)).alias("tp"), F.count_if(F.col("distance") == 0).alias("tp_exact"))
    return counts.select(F.get(F.lit(list(K.THRESHOLD_GRID)), F.col("k")).alias("t"), "run_id", "tp", "tp_exact")


# One finding between any two lines, labels on every second line: 4,096 orders are the lines of a file.
@query("f1_dense_labels", """
WITH RECURSIVE o AS (SELECT o_orderkey // 4096 AS file, o_orderkey % 4096 AS k, o_custkey * 1000000000 + o_orderkey AS ord, CASE WHEN o_custkey % 11 = 0 THEN 0 WHEN o_custkey % 5 = 0 THEN 2 ELSE 1 END AS n FROM orders),
spots AS (SELECT file, k, n, ord, lag(ord) OVER (PARTITION BY file ORDER BY k) AS before FROM o),
walk AS (SELECT file, k, ord, NULL::BIGINT AS first, NULL::BIGINT AS second FROM spots WHERE FALSE UNION ALL SELECT file, -1::BIGINT, -1::BIGINT, NULL, NULL FROM (SELECT DISTINCT file FROM o)
  UNION ALL
  SELECT a.file, a.k, a.ord, CASE WHEN n > 0 THEN CASE WHEN free AND a.before < a.ord THEN a.before ELSE a.ord END END,
    CASE WHEN n > 1 AND free THEN greatest(a.before, a.ord) END
  FROM (SELECT file, k, before, coalesce(before IS NOT NULL AND before IS DISTINCT FROM first AND before IS DISTINCT FROM second, FALSE) AS free, first, second FROM (
    SELECT w.file, w.k, w.first, w.second, CASE WHEN w.k >= 0 THEN w.ord END AS before FROM walk w)) p JOIN spots a ON a.file = p.file AND a.k = p.k + 1)
SELECT 'f' || file AS file, ord, 2 * k AS golden_line, 2 * k + j AS golden_idx FROM (SELECT file, k, unnest([first, second]) AS ord, unnest([0, 1]) AS j FROM walk WHERE k >= 0) WHERE ord IS NOT NULL
""")
def f1_dense(spark, sf):
    o = V.table(spark, sf, "orders").select(
        F.lit(1).alias("run_id"), F.lit(1).alias("sample_id"), F.concat(F.lit("f"), F.floor(F.col("o_orderkey") / 4096).cast("string")).alias("file"),
        (F.col("o_orderkey") % 4096).alias("k"), (F.col("o_custkey") * 1000000000 + F.col("o_orderkey")).alias("ord"),
        F.when(F.col("o_custkey") % 11 == 0, 0).when(F.col("o_custkey") % 5 == 0, 2).otherwise(1).alias("n"))
    labels = o.filter("n > 0").select("sample_id", "file", (F.col("k") * 2).alias("line"), F.explode(F.sequence(F.col("k") * 2, F.col("k") * 2 + F.col("n") - 1)).alias("golden_idx"))
    return match_findings(o.withColumn("line", F.col("k") * 2 + 1), labels, RUN, SAMPLE).select("file", "ord", "golden_line", "golden_idx")


METRICS = """,
tp AS (SELECT run_id, count(*) AS tp FROM matches GROUP BY run_id),
n_rep AS (SELECT run_id, count(*) AS n_reported FROM rep GROUP BY run_id),
n_gold AS (SELECT sample_id, count(*) AS n_golden FROM v_golden GROUP BY sample_id),
m AS (SELECT run_id, sample_id, coalesce(n_golden, 0) AS n_golden, coalesce(n_reported, 0) AS n_reported, coalesce(tp, 0) AS tp
  FROM v_runs LEFT JOIN n_rep USING (run_id) LEFT JOIN tp USING (run_id) LEFT JOIN n_gold USING (sample_id)),
pr AS (SELECT *, CASE WHEN n_reported > 0 THEN tp / n_reported END AS precision, CASE WHEN n_golden > 0 THEN tp / n_golden END AS recall FROM m)
SELECT run_id, sample_id, n_golden, n_reported, tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall) END, 6) AS f1 FROM pr"""


@query("f2_golden_metrics", match_sql(METRICS, "v_judged v_golden v_runs"))
def f2(spark, sf):
    rep = _reported(spark, sf)
    out = E.golden_metrics(V.runs(spark, sf), rep, V.golden(spark, sf), _matches(spark, sf, rep), RUN, SAMPLE)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("f3_matched_levels", match_sql(f"""
SELECT m.run_id, m.ord, m.golden_idx, {LEVEL} AS level FROM matches m JOIN rep r USING (run_id, ord)"""))
def f3(spark, sf):
    rep = _reported(spark, sf)
    return E.matched_levels(rep, _matches(spark, sf, rep), RUN)


@query("f3_missed_golden", match_sql("""
SELECT r.run_id, r.sample_id, g.golden_idx, g.file, g.line FROM v_runs r JOIN v_golden g USING (sample_id)
WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.run_id = r.run_id AND m.golden_idx = g.golden_idx)""",
                                   "v_judged v_golden v_runs"))
def f3_missed(spark, sf):
    return E.missed_golden(V.runs(spark, sf), V.golden(spark, sf), _matches(spark, sf), RUN, SAMPLE).select(
        "run_id", "sample_id", "golden_idx", "file", "line")


@query("f4_negative_census", V.sql_with("v_judged", f"""
SELECT run_id, count(*) FILTER (WHERE lvl >= 2) AS blocker_major,
  count(*) FILTER (WHERE lvl = 1 AND category = 'style') AS minor_notes,
  count(*) FILTER (WHERE lvl < 2 AND NOT coalesce(lvl = 1 AND category = 'style', FALSE)) AS other_fp
FROM (SELECT *, {LEVEL} AS lvl FROM ({reported_sql()})) GROUP BY run_id"""))
def f4(spark, sf):
    return E.negative_census(_reported(spark, sf), RUN)


@query("f5_unmatched_positive", match_sql(f"""
SELECT run_id, ord, file, line FROM rep r WHERE NOT coalesce({LEVEL} = 1 AND category = 'style', FALSE)
AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.run_id = r.run_id AND m.ord = r.ord)"""))
def f5(spark, sf):
    rep = _reported(spark, sf)
    return E.unmatched_positive(rep, _matches(spark, sf, rep), RUN).select("run_id", "ord", "file", "line")


@query("f6_cluster_recall", V.sql_with("v_judged v_golden v_runs", f"""
WITH rep AS ({reported_sql()})
SELECT r.run_id, g.golden_idx, g.file, g.line FROM v_runs r JOIN v_golden g USING (sample_id)
WHERE EXISTS (SELECT 1 FROM rep j WHERE j.run_id = r.run_id AND j.file = g.file AND g.line BETWEEN j.line_start AND j.line_end)"""))
def f6(spark, sf):
    due = V.runs(spark, sf).select("run_id", "sample_id").join(V.golden(spark, sf), "sample_id")
    return E.covered(due, E.with_span(_reported(spark, sf)), ["run_id", "file"]).select("run_id", "golden_idx", "file", "line")


# Check SQL for the miss reasons: plain interval joins, one reason per label.
BUCKETS = """,
gold_due AS (SELECT r.run_id, {t_col} r.sample_id, g.golden_idx, g.file, g.line FROM {runs_t} r JOIN v_golden g USING (sample_id)),
missed_at AS (SELECT DISTINCT d.run_id, d.t, d.file, d.line FROM gold_due d
  WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.run_id = d.run_id AND m.t = d.t AND m.golden_idx = d.golden_idx)),
cover AS (SELECT d.run_id, d.t, d.file, d.line, j.rubric, coalesce(j.is_real, 0) AS r, coalesce(j.severity, 0) AS s, j.reflex_class, j.ord,
    CASE WHEN j.rubric = 'deletion' THEN 0.7e0 ELSE d.t END AS thr
  FROM (SELECT DISTINCT run_id, t, file, line FROM gold_due) d JOIN v_judged j ON j.run_id = d.run_id AND j.file = d.file
    AND d.line BETWEEN j.line_start AND j.line_end),
cov AS (SELECT run_id, t, file, line, bool_or(r >= thr AND s >= 1 AND reflex_class <> 'test') AS rep_any,
    bool_or(r >= thr AND s >= 1 AND reflex_class = 'test') AS held_any,
    arg_max(r >= thr, r * 1e9 - ord) AS best_over FROM cover GROUP BY run_id, t, file, line),
skp AS (SELECT d.run_id, d.t, d.file, d.line,
    bool_or(k.reason = 'max-hunks>ceiling' AND k.line_start IS NOT NULL) AS cut
  FROM (SELECT DISTINCT run_id, t, file, line FROM gold_due) d JOIN v_skipped k ON k.run_id = d.run_id AND k.file = d.file
    AND (k.line_start IS NULL OR d.line BETWEEN k.line_start AND k.line_end)
  GROUP BY d.run_id, d.t, d.file, d.line),
golds AS (SELECT d.*, coalesce(c.rep_any, FALSE) AS in_reported,
  CASE WHEN NOT EXISTS (SELECT 1 FROM missed_at x WHERE x.run_id = d.run_id AND x.t = d.t AND x.file = d.file AND x.line = d.line) THEN NULL
    WHEN c.rep_any THEN 'anchor-offset' WHEN c.held_any THEN 'held-test'
    WHEN c.best_over THEN 'judged-low-severity' WHEN NOT c.best_over THEN 'judged-below-threshold'
    WHEN s.cut THEN 'truncated' WHEN s.cut IS NOT NULL THEN 'skipped-triage' ELSE 'not-judged' END AS bucket
  FROM gold_due d LEFT JOIN cov c ON c.run_id = d.run_id AND c.t = d.t AND c.file = d.file AND c.line = d.line
    LEFT JOIN skp s ON s.run_id = d.run_id AND s.t = d.t AND s.file = d.file AND s.line = d.line)
"""
ONE = BUCKETS.format(t_col="0.5e0 AS t,", runs_t="v_runs")
MANY = BUCKETS.format(t_col="r.t,", runs_t=f"(SELECT * FROM v_runs, {GRID_SQL})")


@query("f7_miss_buckets", match_sql(ONE + """
SELECT run_id, file, line, count(*) AS n_gold, bool_or(in_reported) AS in_reported, max(bucket) AS bucket
FROM golds GROUP BY run_id, file, line""", "v_judged v_golden v_runs v_skipped"))
def f7(spark, sf):
    g = gate(V.judged(spark, sf))
    rep = g.filter("reported")
    golden = V.golden(spark, sf)
    anchors = S.golden_anchors(V.runs(spark, sf), golden, match_findings(rep, golden, RUN, SAMPLE), RUN, SAMPLE)
    return S.classify_anchors(anchors, g, V.skipped(spark, sf), RUN).select(
        "run_id", "file", "line", "n_gold", "in_reported", "bucket")


@query("f8_known_fp_repeats", V.sql_with("v_judged v_dismissed v_runs", f"""
WITH rep AS ({reported_sql()})
SELECT r.run_id, count(*) AS known_fp_repeats FROM v_runs r JOIN v_dismissed d USING (sample_id)
WHERE EXISTS (SELECT 1 FROM rep j WHERE j.run_id = r.run_id AND j.file = d.file AND d.line BETWEEN j.line_start AND j.line_end)
GROUP BY r.run_id"""))
def f8(spark, sf):
    return S.known_fp_repeats(_reported(spark, sf), V.dismissed(spark, sf), RUN, SAMPLE)


MISS_SQL = ", ".join(f"count(*) FILTER (WHERE bucket = '{b}') AS {S.miss_column(b)}" for b in K.MISS_BUCKETS)
MISS_COLS = ", ".join(f"coalesce({S.miss_column(b)}, 0) AS {S.miss_column(b)}" for b in K.MISS_BUCKETS)
SCORES = ",\n" + """
lv AS (SELECT *, {level} AS lvl FROM rep),
counted AS (SELECT run_id, t, count(*) FILTER (WHERE lvl = 3) AS b, count(*) FILTER (WHERE lvl = 2) AS m FROM lv r
  WHERE lvl >= 2 AND NOT (rubric = 'deletion' AND NOT coalesce(references_remaining, FALSE)
    AND NOT EXISTS (SELECT 1 FROM lv c WHERE c.run_id = r.run_id AND c.t = r.t AND c.rubric <> 'deletion'
      AND (c.lvl >= 2 OR (c.file = r.file AND c.category IS NOT NULL AND c.category <> 'style')))) GROUP BY run_id, t),
n_rep AS (SELECT run_id, t, count(*) AS n_reported,
   count(*) FILTER (WHERE severity IS NOT NULL AND NOT coalesce(lvl = 1 AND category = 'style', FALSE)) AS fp FROM lv GROUP BY run_id, t),
tps AS (SELECT run_id, t, count(*) AS tp FROM matches GROUP BY run_id, t),
per_gold AS (SELECT run_id, t, count(*) AS golden, count(*) FILTER (WHERE in_reported) AS cluster_matched, {miss} FROM golds GROUP BY run_id, t),
serious AS (SELECT sample_id, bool_or(severity_class IN ('blocker', 'major')) AS serious FROM v_golden GROUP BY sample_id),
known AS (SELECT r.run_id, r.t, count(*) AS known_fp_repeats FROM {runs_t} r JOIN v_dismissed d USING (sample_id)
  WHERE EXISTS (SELECT 1 FROM rep j WHERE j.run_id = r.run_id AND j.t = r.t AND j.file = d.file AND d.line BETWEEN j.line_start AND j.line_end)
  GROUP BY r.run_id, r.t),
scores AS (SELECT r.t, r.run_id, r.sample_id, r.repo, r.kind, r.total_latency_ms, coalesce(golden, 0) AS golden, coalesce(tp, 0) AS tp,
    coalesce(cluster_matched, 0) AS cluster_matched, {miss_cols}, coalesce(n_reported, 0) AS n_reported,
    coalesce(known_fp_repeats, 0) AS known_fp_repeats,
    CASE WHEN kind = 'clean' THEN coalesce(fp, 0) ELSE 0 END AS clean_fp,
    CASE WHEN coalesce(b, 0) > 0 OR coalesce(m, 0) >= 2 THEN 'Changes requested' ELSE 'Approved' END AS verdict,
    CASE WHEN kind <> 'positive' THEN 'Approved' WHEN serious THEN 'Changes requested' END AS expected_verdict
  FROM {runs_t} r LEFT JOIN per_gold USING (run_id, t) LEFT JOIN tps USING (run_id, t) LEFT JOIN n_rep USING (run_id, t)
    LEFT JOIN counted USING (run_id, t) LEFT JOIN known USING (run_id, t) LEFT JOIN serious USING (sample_id)
  WHERE NOT fail_open)
"""
ONE_T = "(SELECT 0.5e0 AS t, * FROM v_runs)"
GRID_T = f"(SELECT * FROM v_runs, {GRID_SQL})"
SCORES_ONE = ONE + SCORES.format(level=LEVEL, miss=MISS_SQL, miss_cols=MISS_COLS, runs_t=ONE_T)
SCORES_GRID = MANY + SCORES.format(level=LEVEL, miss=MISS_SQL, miss_cols=MISS_COLS, runs_t=GRID_T)
ALL_VIEWS = "v_judged v_golden v_dismissed v_runs v_samples v_skipped"
SCORE_COLS = ["run_id", "sample_id", "repo", "kind", "total_latency_ms", "golden", "tp", "cluster_matched",
              *[S.miss_column(b) for b in K.MISS_BUCKETS], "n_reported", "known_fp_repeats", "clean_fp",
              "verdict", "expected_verdict", "verdict_ok"]


def _tables(spark, sf):
    """The views of a replay; each scan reads the columns it needs."""
    j = V.judged(spark, sf)
    r = V.runs(spark, sf, j)
    live = r.filter("not fail_open").select("run_id", "sample_id", "repo", "kind", "total_latency_ms")
    return {"live": live, "judged": j.join(live.select("run_id"), "run_id", "left_semi"), "golden": V.golden(spark, sf, j),
            "dismissed": V.dismissed(spark, sf, j), "skipped": V.skipped(spark, sf, j), "samples": V.samples(spark, sf, r)}


def _scores(t):
    return S.score_runs(t["live"], t["judged"], t["golden"], t["dismissed"], t["skipped"])


def _totals(spark, sf):
    t = _tables(spark, sf)
    return _rounded(S.aggregate_scores(_scores(t), t["dismissed"], t["samples"]))


@query("f9_score_rows", match_sql(SCORES_ONE + f"""
SELECT {", ".join(SCORE_COLS[:-1])}, verdict = expected_verdict AS verdict_ok FROM scores""", ALL_VIEWS))
def f9(spark, sf):
    return _scores(_tables(spark, sf)).select(*SCORE_COLS)


TOTALS = """,
sums AS (SELECT {extra} repo, count(*) AS samples, count(*) FILTER (WHERE kind = 'positive') AS positive,
    count(*) FILTER (WHERE kind = 'clean') AS clean, CAST(coalesce(sum(golden) FILTER (WHERE kind = 'positive'), 0) AS BIGINT) AS golden_total,
    sum(n_reported) FILTER (WHERE kind = 'positive') AS rep_pos, sum(tp) FILTER (WHERE kind = 'positive') AS tp,
    sum(cluster_matched) FILTER (WHERE kind = 'positive') AS clu, sum(clean_fp) FILTER (WHERE kind = 'clean') AS cfp,
    sum(n_reported) AS rep_all, count(expected_verdict) AS scored, count(*) FILTER (WHERE verdict = expected_verdict) AS rgt,
    CAST(sum(known_fp_repeats) AS BIGINT) AS known_fp_repeats, avg(total_latency_ms) AS lat, {miss_sums}
  FROM scores GROUP BY GROUPING SETS (({extra} repo), ({extra_only}))),
gone AS (SELECT repo, count(dismissed_idx) AS dismissed_total FROM v_samples LEFT JOIN v_dismissed USING (sample_id) GROUP BY ROLLUP (repo)),
ratios AS (SELECT {extra} s.repo, samples, positive, clean, golden_total, tp / nullif(golden_total, 0) AS recall_strict,
  clu / nullif(golden_total, 0) AS recall_cluster, tp / nullif(rep_pos, 0) AS precision, cfp / nullif(clean, 0) AS fp_per_clean,
  rep_all / samples AS findings_per_pr, rgt / nullif(scored, 0) AS verdict_accuracy, known_fp_repeats, lat AS avg_latency_ms,
  dismissed_total, {miss_cols} FROM sums s LEFT JOIN gone g ON s.repo IS NOT DISTINCT FROM g.repo)
SELECT {extra} repo, samples, positive, clean, golden_total, round(recall_strict, 6) AS recall_strict, round(recall_cluster, 6) AS recall_cluster,
  round(precision, 6) AS precision, round(CASE WHEN precision > 0 AND recall_strict > 0 THEN 2e0 * precision * recall_strict / (precision + recall_strict) END, 6) AS f1,
  round(fp_per_clean, 6) AS fp_per_clean, round(findings_per_pr, 6) AS findings_per_pr, round(verdict_accuracy, 6) AS verdict_accuracy,
  known_fp_repeats, dismissed_total, round(avg_latency_ms, 4) AS avg_latency_ms, {miss_cols} FROM ratios"""
MISS_NAMES = ", ".join(S.miss_column(b) for b in K.MISS_BUCKETS)
MISS_SUMS = ", ".join(f"CAST(coalesce(sum({S.miss_column(b)}) FILTER (WHERE kind = 'positive'), 0) AS BIGINT) AS {S.miss_column(b)}" for b in K.MISS_BUCKETS)
TOTAL_COLS = ["repo", "samples", "positive", "clean", "golden_total", "recall_strict", "recall_cluster", "precision", "f1",
              "fp_per_clean", "findings_per_pr", "verdict_accuracy", "known_fp_repeats", "dismissed_total", "avg_latency_ms",
              *[S.miss_column(b) for b in K.MISS_BUCKETS]]


def _rounded(df):
    six = ["recall_strict", "recall_cluster", "precision", "f1", "fp_per_clean", "findings_per_pr", "verdict_accuracy"]
    return df.withColumns({**{c: F.round(c, 6) for c in six}, "avg_latency_ms": F.round("avg_latency_ms", 4)})


@query("f10_aggregate_scores", match_sql(SCORES_ONE + TOTALS.format(
    extra="", extra_only="", miss_sums=MISS_SUMS, miss_cols=MISS_NAMES), ALL_VIEWS))
def f10(spark, sf):
    return _totals(spark, sf).select(*TOTAL_COLS)


@query("f11_dismissed_totals", V.sql_with("v_dismissed v_samples", """
SELECT repo, count(dismissed_idx) AS dismissed_total FROM v_samples LEFT JOIN v_dismissed USING (sample_id) GROUP BY ROLLUP (repo)"""))
def f11(spark, sf):
    return S.dismissed_totals(V.dismissed(spark, sf), V.samples(spark, sf))


@query("f12_missing_runs", V.sql_with("v_samples v_runs", """
SELECT sample_id, CAST(k AS INTEGER) AS repeat FROM v_samples, (SELECT unnest(range(1, 8)) AS k)
WHERE NOT EXISTS (SELECT 1 FROM v_runs r WHERE r.sample_id = v_samples.sample_id AND r.repeat = k AND NOT fail_open)"""))
def f12(spark, sf):
    return S.missing_runs(V.samples(spark, sf), V.runs(spark, sf).filter("not fail_open"), repeats=7)


VARIANCE_SQL = """
WITH multi AS (SELECT sample_id FROM v_runs GROUP BY sample_id HAVING count(*) >= 2),
prints AS (SELECT run_id, string_agg(file || '|' || line || '|' || coalesce(CAST(severity AS VARCHAR), '-') || '|'
    || coalesce(CAST(is_real AS VARCHAR), '-'), ';' ORDER BY ord) AS p FROM v_judged GROUP BY run_id),
per AS (SELECT r.sample_id, count(DISTINCT p) AS kinds, count(DISTINCT verdict) AS verdicts
  FROM v_runs r JOIN multi USING (sample_id) LEFT JOIN prints USING (run_id) LEFT JOIN verdicts v USING (run_id) GROUP BY r.sample_id),
spread AS (SELECT max(coalesce(is_real, 0)) - min(coalesce(is_real, 0)) AS s FROM v_judged JOIN multi USING (sample_id)
  GROUP BY sample_id, file, line HAVING count(*) > 1)
SELECT max(kinds) <= 1 AS identical, count(*) FILTER (WHERE verdicts > 1) AS verdict_flips,
  (SELECT round(max(s), 6) FROM spread) AS max_is_real_spread, (SELECT round(avg(s), 6) FROM spread) AS mean_is_real_spread FROM per"""


@query("f13_repeat_variance", V.sql_with("v_judged v_runs", "WITH verdicts AS (SELECT run_id, verdict FROM ("
       + verdict_sql(False).strip() + ")),\n" + VARIANCE_SQL.strip()[len("WITH "):]))
def f13(spark, sf):
    from judgelake.operators.compose import measurement_verdict
    j = V.judged(spark, sf).withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy("ord")))
    out = S.repeat_variance(V.runs(spark, sf), j, measurement_verdict(compose(j), RUN), ["file", "line", "severity", "is_real"])
    return out.withColumns({c: F.round(c, 6) for c in ("max_is_real_spread", "mean_is_real_spread")})


@query("f14_replay_grid", match_sql(SCORES_GRID + TOTALS.format(
    extra="t,", extra_only="t", miss_sums=MISS_SUMS, miss_cols=MISS_NAMES), ALL_VIEWS, grid=True))
def f14(spark, sf):
    t = _tables(spark, sf)
    scores = S.score_grid(t["live"], t["judged"], t["golden"], t["dismissed"], t["skipped"])
    return _rounded(S.aggregate_scores(scores, t["dismissed"], t["samples"], extra=["t"])).select("t", *TOTAL_COLS)


ARMS_SQL = """
WITH a AS (SELECT sample_id, file, line, max(is_real) AS score FROM v_judged WHERE repeat = {k} AND is_real IS NOT NULL GROUP BY ALL),
b AS (SELECT sample_id, file, line, max(is_real) AS score FROM v_judged WHERE repeat = {l} AND is_real IS NOT NULL GROUP BY ALL),
k AS (SELECT sample_id, file, line, a.score AS base_score, b.score AS new_score,
  b.score < a.score - 0.1e0 AS leg_a_failure, abs(a.score - 0.8e0) <= 0.03e0 OR abs(b.score - 0.8e0) <= 0.03e0 AS jitter_excluded
  FROM a JOIN b USING (sample_id, file, line)),
f AS (SELECT *, NOT jitter_excluded AND base_score >= 0.8e0 AS base_surfaced, NOT jitter_excluded AND new_score >= 0.8e0 AS new_surfaced FROM k),
flags AS (SELECT *, base_surfaced <> new_surfaced AS surfaced_delta FROM f)
"""


def _arm(spark, sf, parity):
    return (V.judged(spark, sf).filter((F.col("repeat") % 2 == parity) & F.col("is_real").isNotNull())
            .groupBy("sample_id", "file", "line").agg(F.max("is_real").alias("score")))


ARMS = ARMS_SQL.replace("repeat = {k}", "repeat % 2 = 1").replace("repeat = {l}", "repeat % 2 = 0")


@query("f15_regression_keys", V.sql_with("v_judged", ARMS + "SELECT * FROM flags"))
def f15(spark, sf):
    return S.regression_keys(_arm(spark, sf, 1), _arm(spark, sf, 0), 0.1, keys=["sample_id", "file", "line"])


@query("f15_regression_result", V.sql_with("v_judged", ARMS + """
SELECT sample_id, count(*) AS n_common, count(*) FILTER (WHERE leg_a_failure) AS n_leg_a_failures,
  count(*) FILTER (WHERE jitter_excluded) AS n_jitter_excluded, count(*) FILTER (WHERE surfaced_delta) AS n_surfaced_delta,
  count(*) FILTER (WHERE leg_a_failure) = 0 AS leg_a_pass, count(*) FILTER (WHERE surfaced_delta) = 0 AS leg_b_pass,
  count(*) FILTER (WHERE leg_a_failure) = 0 AND count(*) FILTER (WHERE surfaced_delta) = 0 AS overall_pass FROM flags GROUP BY sample_id"""))
def f15_result(spark, sf):
    return S.regression_result(S.regression_keys(_arm(spark, sf, 1), _arm(spark, sf, 0), 0.1, keys=["sample_id", "file", "line"]),
                               by=["sample_id"])


BARS = [0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]


@query("f16_separability", match_sql(""",
bars AS (SELECT bar FROM (VALUES """ + ", ".join(f"({b}e0)" for b in BARS) + """) b(bar)),
u AS (SELECT r.run_id, r.is_real, m.ord IS NOT NULL AS is_tp FROM rep r LEFT JOIN matches m USING (run_id, ord)),
k AS (SELECT bar, run_id, count(*) FILTER (WHERE is_real >= bar AND NOT is_tp) AS fp, count(*) FILTER (WHERE is_real >= bar AND is_tp) AS tp
  FROM u, bars GROUP BY bar, run_id),
n AS (SELECT run_id, count(*) AS n_golden FROM v_runs JOIN v_golden USING (sample_id) GROUP BY run_id)
SELECT bar, CAST(sum(coalesce(fp, 0)) AS BIGINT) AS fp_kept, CAST(sum(coalesce(tp, 0)) AS BIGINT) AS tp_kept,
  count(*) FILTER (WHERE coalesce(tp, 0) = n_golden) AS full_recall_runs FROM (SELECT * FROM n, bars) LEFT JOIN k USING (bar, run_id) GROUP BY bar""",
                                    "v_judged v_golden v_runs"))
def f16(spark, sf):
    rep = _reported(spark, sf)
    tp = _matches(spark, sf, rep).select("run_id", "ord", F.lit(True).alias("is_tp"))
    units = rep.join(tp, ["run_id", "ord"], "left").select("run_id", "is_real", F.coalesce("is_tp", F.lit(False)).alias("is_tp"))
    counts = (V.runs(spark, sf).select("run_id", "sample_id").join(
        V.golden(spark, sf).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_golden")), "sample_id"))
    return S.separability(units, counts, BARS)


@query("f17_metric_table", match_sql(SCORES_ONE + TOTALS.format(extra="", extra_only="", miss_sums=MISS_SUMS, miss_cols=MISS_NAMES)
       .replace("\nSELECT  repo, samples", ",\nfin AS (SELECT repo, samples") + """)
SELECT repo, metric, value FROM (SELECT repo, CAST(samples AS DOUBLE) AS samples, CAST(positive AS DOUBLE) AS positive, CAST(clean AS DOUBLE) AS clean,
  CAST(golden_total AS DOUBLE) AS golden_total, recall_strict, recall_cluster, precision, f1, fp_per_clean, findings_per_pr, verdict_accuracy,
  CAST(known_fp_repeats AS DOUBLE) AS known_fp_repeats, avg_latency_ms FROM fin) UNPIVOT INCLUDE NULLS (value FOR metric IN (samples, positive, clean,
  golden_total, recall_strict, recall_cluster, precision, f1, fp_per_clean, findings_per_pr, verdict_accuracy, known_fp_repeats, avg_latency_ms))""", ALL_VIEWS))
def f17(spark, sf):
    return S.metric_table(_totals(spark, sf))


SURFACED_SQL = f"""
s AS (SELECT sample_id AS head, CASE repeat % 3 WHEN 1 THEN 'baseline-1' WHEN 2 THEN 'baseline-2' ELSE 'new' END AS role, count(*) AS n
  FROM ({reported_sql('0.8e0')}) GROUP BY ALL),
w AS (SELECT head, CAST(coalesce(sum(n) FILTER (WHERE role = 'baseline-1'), 0) AS BIGINT) AS base_1, CAST(coalesce(sum(n) FILTER (WHERE role = 'baseline-2'), 0) AS BIGINT) AS base_2,
  CAST(coalesce(sum(n) FILTER (WHERE role = 'new'), 0) AS BIGINT) AS new FROM s GROUP BY head)
SELECT *, (SELECT max(abs(base_1 - base_2)) FROM w) AS band, new <= greatest(base_1, base_2) + (SELECT max(abs(base_1 - base_2)) FROM w) AS within_band FROM w"""


@query("f18_noise_band", V.sql_with("v_judged", "WITH " + SURFACED_SQL.strip()))
def f18(spark, sf):
    rep = compose(V.judged(spark, sf), K.REFLEX_GATE)
    role = F.when(F.col("repeat") % 3 == 1, "baseline-1").when(F.col("repeat") % 3 == 2, "baseline-2").otherwise("new")
    return S.noise_band(rep.groupBy(F.col("sample_id").alias("head"), role.alias("role")).agg(F.count(F.lit(1)).alias("n")))


@query("f18_declaration_flips", V.sql_with("v_judged", f"""
WITH flat AS ({verdict_sql(False)}), per AS ({verdict_sql(True)})
SELECT run_id, flat.verdict AS flat, per.verdict AS per_declaration FROM flat JOIN per USING (run_id) WHERE flat.verdict <> per.verdict"""))
def f18_flips(spark, sf):
    return S.declaration_flips(_reported(spark, sf), RUN)


@query("f3_top_findings_eval", V.sql_with("v_judged v_runs", f"""
SELECT run_id, count(t.ord) AS n_top FROM v_runs LEFT JOIN (SELECT run_id, ord, row_number() OVER (PARTITION BY run_id
  ORDER BY coalesce(severity, 0) DESC, coalesce(is_real, 0) DESC, ord) AS rank FROM ({reported_sql('0.8e0')})) t USING (run_id)
WHERE coalesce(t.rank, 1) <= 5 GROUP BY run_id"""))
def f3_top(spark, sf):
    top = rank_and_cap(compose(V.judged(spark, sf), K.REFLEX_GATE), RUN)
    n = top.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_top"))
    return V.runs(spark, sf).select("run_id").join(n, "run_id", "left").select(
        "run_id", F.coalesce("n_top", F.lit(0).cast("bigint")).alias("n_top"))
