"""Registered queries: run gates, threshold sweeps, field sweeps."""

from pyspark.sql import functions as F

from judgelake.operators import sweep as W
from judgelake.plans import views as V
from judgelake.plans.queries_compose import LEVEL
from judgelake.plans.queries_evaluate import GRID_SQL, match_sql
from judgelake.plans.registry import query

# Ledger records with the fields a gate reads; a share of them is bad in each way.
GATE_RUNS_SQL = """
SELECT run_id, sample_id, repeat, kind, label, provider, n_analyzed, fail_open, ts, CAST(NULL AS VARCHAR) AS model,
  CASE WHEN n % 29 = 0 THEN 'ast' END AS enrichment,
  CASE WHEN n % 31 = 1 THEN NULL WHEN n % 31 = 2 THEN n_analyzed - 1 ELSE n_analyzed END AS judged_size,
  CASE WHEN n % 2 = 0 THEN 'ok' END AS base_verdict,
  CASE WHEN n % 13 = 2 THEN NULL WHEN n % 13 = 3 THEN 'true' WHEN n % 13 = 4 THEN '-1' WHEN n % 13 = 5 THEN '2' ELSE '0' END AS n_dropped,
  CASE WHEN n % 17 = 6 THEN '1' ELSE '0' END AS n_unjudged,
  CASE WHEN n % 3 = 0 THEN '4' ELSE '0' END AS n_size_skipped_code,
  CASE WHEN n % 11 = 7 THEN 'Approved (incomplete review)' ELSE 'Approved' END AS verdict,
  CASE WHEN n % 19 = 8 THEN 'v08-ast' ELSE 'v09' END AS packaging_version,
  CASE n % 7 WHEN 0 THEN 'hunk' WHEN 1 THEN 'line-window' WHEN 2 THEN 'ast-units' WHEN 3 THEN 'ts-units' WHEN 4 THEN 'sites' WHEN 5 THEN 'hunk' ELSE
    CASE WHEN repeat % 2 = 0 THEN 'hunk_state-v1' ELSE 'sites' END END AS wire_format,
  CASE WHEN n % 23 = 9 THEN '' WHEN n % 23 = 10 THEN repeat('0', 40) ELSE sha END AS fixture_head,
  CASE WHEN kind = 'clean' THEN 'negative' ELSE 'positive' END AS fixture
FROM (SELECT *, sample_id * 7 + repeat AS n, sha256(CASE WHEN kind = 'clean' THEN 'negative' ELSE 'positive' END)[1:40] AS sha FROM v_runs)
"""
V.VIEWS_SQL["v_gate_runs"] = (("v_runs",), GATE_RUNS_SQL)


def gate_runs(spark, sf):
    n = F.col("n")

    def cases(mod, table, other):
        out = None
        for k, v in table.items():
            cond = n % mod == k
            out = F.when(cond, v) if out is None else out.when(cond, v)
        return out.otherwise(other)

    fixture = F.when(F.col("kind") == "clean", "negative").otherwise("positive")
    null = F.lit(None).cast("string")
    return (V.runs(spark, sf).withColumn("n", F.col("sample_id") * 7 + F.col("repeat"))
            .withColumn("sha", F.substring(F.sha2(fixture, 256), 1, 40))
            .select("run_id", "sample_id", "repeat", "kind", "label", "provider", "n_analyzed", "fail_open", "ts",
                    null.alias("model"), F.when(n % 29 == 0, "ast").alias("enrichment"),
                    cases(31, {1: F.lit(None), 2: F.col("n_analyzed") - 1}, F.col("n_analyzed")).alias("judged_size"),
                    F.when(n % 2 == 0, "ok").alias("base_verdict"),
                    cases(13, {2: null, 3: F.lit("true"), 4: F.lit("-1"), 5: F.lit("2")}, F.lit("0")).alias("n_dropped"),
                    F.when(n % 17 == 6, "1").otherwise("0").alias("n_unjudged"),
                    F.when(n % 3 == 0, "4").otherwise("0").alias("n_size_skipped_code"),
                    F.when(n % 11 == 7, "Approved (incomplete review)").otherwise("Approved").alias("verdict"),
                    F.when(n % 19 == 8, "v08-ast").otherwise("v09").alias("packaging_version"),
                    cases(7, {0: "hunk", 1: "line-window", 2: "ast-units", 3: "ts-units", 4: "sites", 5: "hunk"},
                          F.when(F.col("repeat") % 2 == 0, "hunk_state-v1").otherwise("sites")).alias("wire_format"),
                    cases(23, {9: F.lit(""), 10: F.lit("0" * 40)}, F.col("sha")).alias("fixture_head"),
                    fixture.alias("fixture")))


def expected_heads(spark, sf):
    """The committed head of each fixture, one row per kind of sample."""
    return (V.samples(spark, sf).select(F.when(F.col("kind") == "clean", "negative").otherwise("positive").alias("fixture"))
            .distinct().withColumn("expected_head", F.substring(F.sha2("fixture", 256), 1, 40)))


GATE = """
CASE WHEN judged_size IS NULL THEN 'no-judged-array' WHEN fail_open THEN 'fail-open' WHEN judged_size <> n_analyzed THEN 'judged-count-differs'
  WHEN base_verdict IS NOT NULL AND (n_dropped IS NULL OR n_unjudged IS NULL OR n_size_skipped_code IS NULL) THEN 'missing-counts'
  WHEN base_verdict IS NOT NULL AND (TRY_CAST(n_dropped AS UINTEGER) IS NULL OR n_dropped = 'true') THEN 'malformed-counts'
  WHEN base_verdict IS NOT NULL AND (CAST(n_dropped AS INTEGER) > 0 OR CAST(n_unjudged AS INTEGER) > 0) THEN 'incomplete-review'
  WHEN base_verdict IS NULL AND verdict LIKE '%(incomplete%' THEN 'incomplete-verdict'
  WHEN packaging_version <> 'v09' THEN 'packaging-version'
  WHEN wire_format NOT IN ('hunk', 'line-window', 'ast-units', 'ts-units', 'sites') THEN 'wire-format'
  WHEN fixture_head = '' THEN 'no-head'
  WHEN fixture_head <> sha256(fixture)[1:40] THEN 'head-differs' END"""


@query("g1_gate_runs", V.sql_with("v_gate_runs", f"SELECT run_id, {GATE} AS reject_reason FROM v_gate_runs"))
def g1(spark, sf):
    return W.gate_runs(gate_runs(spark, sf), expected_heads(spark, sf)).select("run_id", "reject_reason")


SELECTED = f"sel AS (SELECT * FROM v_gate_runs WHERE {GATE} IS NULL AND label LIKE 'corpus:v08:%')"


def selected(spark, sf):
    return W.select_runs(gate_runs(spark, sf), expected_heads(spark, sf), "corpus:v08:")


@query("g2_select_runs", V.sql_with("v_gate_runs", f"WITH {SELECTED} SELECT fixture, run_id, label FROM sel"))
def g2(spark, sf):
    return selected(spark, sf).select("fixture", "run_id", "label")


@query("g3_selection_errors", V.sql_with("v_gate_runs", f"""
WITH {SELECTED}, n AS (SELECT count(*) FILTER (WHERE fixture = 'positive') AS n_positive, count(*) FILTER (WHERE fixture = 'negative') AS n_negative,
  count(DISTINCT provider || coalesce(model, '-')) AS n_groups, count(DISTINCT coalesce(enrichment, 'none')) AS n_enrichments FROM sel)
SELECT error, n_positive, n_negative, n_groups, n_enrichments FROM (
  SELECT 'too-few-positive' AS error, n_positive < 3 AS hit, n.* FROM n UNION ALL SELECT 'too-few-negative', n_negative < 3, n.* FROM n
  UNION ALL SELECT 'mixed-providers', n_groups > 1, n.* FROM n UNION ALL SELECT 'mixed-enrichment', n_enrichments > 1, n.* FROM n) WHERE hit"""))
def g3(spark, sf):
    return W.selection_errors(selected(spark, sf))


@query("g3_provider_groups", V.sql_with("v_gate_runs", f"""
WITH {SELECTED} SELECT provider, model, coalesce(enrichment, 'none') AS enrichment, count(*) AS n_runs FROM sel GROUP BY ALL"""))
def g3_groups(spark, sf):
    return W.provider_groups(selected(spark, sf))


@query("g4_grid", f"SELECT o_orderpriority, t, count(*) FILTER (WHERE l / 1e2 >= t) AS n FROM (SELECT o_orderpriority, o_orderkey % 100 AS l FROM orders), {GRID_SQL} GROUP BY ALL")
def g4(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderpriority", (F.col("o_orderkey") % 100 / F.lit(100.0)).alias("score"))
    return W.with_grid(o).groupBy("o_orderpriority", "t").agg(F.count_if(F.col("score") >= F.col("t")).alias("n"))


def _eras(spark, sf):
    """Judged rows of mixed eras: older records lack rubric and class."""
    era = F.when(F.col("repeat") % 3 == 0, "v02").otherwise("v09")
    return (V.judged(spark, sf).withColumn("packaging_version", era)
            .withColumn("rubric", F.when(F.col("ord") % 4 != 3, F.col("rubric")))
            .withColumn("reflex_class", F.when(F.col("ord") % 6 != 1, F.col("reflex_class"))))


@query("g5_rewrap", V.sql_with("v_judged", """
SELECT run_id, ord, CASE WHEN ord % 4 = 3 THEN 'code-change' ELSE rubric END AS rubric,
  CASE WHEN ord % 6 = 1 THEN 'code' ELSE reflex_class END AS reflex_class
FROM v_judged WHERE NOT (ord % 4 = 3 AND repeat % 3 <> 0)"""))
def g5(spark, sf):
    return W.rewrap(_eras(spark, sf))[0].select("run_id", "ord", "rubric", "reflex_class")


@query("g5_broken_rows", V.sql_with("v_judged", "SELECT run_id, ord, file FROM v_judged WHERE ord % 4 = 3 AND repeat % 3 <> 0"))
def g5_broken(spark, sf):
    return W.rewrap(_eras(spark, sf))[1].select("run_id", "ord", "file")


@query("g6_replay", V.sql_with("v_judged", f"""
SELECT t, run_id, count(*) AS n_reported, count(*) FILTER (WHERE reflex_class = 'test') AS n_test FROM v_judged, {GRID_SQL}
WHERE is_real >= CASE WHEN rubric = 'deletion' THEN 0.7e0 ELSE t END AND coalesce(severity, 0) >= 1 GROUP BY t, run_id"""))
def g6(spark, sf):
    return W.replay(V.judged(spark, sf), include_test=True).groupBy("t", "run_id").agg(
        F.count(F.lit(1)).alias("n_reported"), F.count_if(F.col("reflex_class") == "test").alias("n_test"))


@query("g7_negative_fp", V.sql_with("v_judged v_runs", f"""
SELECT t, run_id, count(*) FILTER (WHERE NOT coalesce(lvl = 1 AND category = 'style', FALSE)) AS fp_neg
FROM (SELECT *, {LEVEL} AS lvl FROM v_judged JOIN v_runs USING (run_id) WHERE kind = 'clean'), {GRID_SQL}
WHERE is_real >= CASE WHEN rubric = 'deletion' THEN 0.7e0 ELSE t END AND severity >= 1 AND reflex_class <> 'test' GROUP BY t, run_id"""))
def g7(spark, sf):
    clean = V.runs(spark, sf).filter("kind = 'clean'").select("run_id")
    return W.negative_fp(W.replay(V.judged(spark, sf).join(clean, "run_id", "left_semi")), ["t", "run_id"])


@query("g7_triage_leaks", """
SELECT page_id, path FROM (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) || CASE page_id % 3 WHEN 0 THEN '/README.md' WHEN 1 THEN '/yarn.lock' ELSE '/main.py' END AS path FROM pages)
WHERE path LIKE '%.md' OR path LIKE '%/yarn.lock'""")
def g7_leaks(spark, sf):
    tail = F.when(F.col("page_id") % 3 == 0, "/README.md").when(F.col("page_id") % 3 == 1, "/yarn.lock").otherwise("/main.py")
    rows = V.table(spark, sf, "pages").select("page_id", F.concat(F.regexp_extract("url", "//([^/]*)", 1), tail).alias("file"))
    return W.triage_leaks(rows, rows).select("page_id", F.col("file").alias("path"))


# Check SQL of the curve: the greedy walk at every grid value, then plain aggregates.
PER_RUN = """,
minor AS (SELECT *, coalesce(LEVEL = 1 AND category = 'style', FALSE) AS minor FROM rep),
runs_t AS (SELECT t, run_id, sample_id, CASE WHEN kind = 'clean' THEN 'negative' ELSE 'positive' END AS fixture FROM v_runs, GRID WHERE NOT fail_open),
tps AS (SELECT run_id, t, count(*) AS tp FROM matches GROUP BY run_id, t),
fps AS (SELECT m.run_id, m.t, count(*) FILTER (WHERE NOT minor AND NOT EXISTS (SELECT 1 FROM matches x WHERE x.run_id = m.run_id AND x.t = m.t AND x.ord = m.ord)) AS fp_pos,
   count(*) FILTER (WHERE NOT minor AND severity IS NOT NULL) AS fp_neg FROM minor m GROUP BY m.run_id, m.t),
n_gold AS (SELECT sample_id, count(*) AS n_golden FROM v_golden GROUP BY sample_id),
per_run AS (SELECT t, run_id, fixture, coalesce(n_golden, 0) AS n_golden, coalesce(tp, 0) AS tp, coalesce(fp_pos, 0) AS fp_pos, coalesce(fp_neg, 0) AS fp_neg
  FROM runs_t LEFT JOIN tps USING (run_id, t) LEFT JOIN fps USING (run_id, t) LEFT JOIN n_gold USING (sample_id)),
neg AS (SELECT t, avg(fp_neg) AS fp_neg_mean FROM per_run WHERE fixture = 'negative' GROUP BY t),
f AS (SELECT p.*, fp_neg_mean, CASE WHEN n_golden > 0 THEN tp / n_golden ELSE 0e0 END AS recall FROM per_run p JOIN neg USING (t) WHERE fixture = 'positive'),
f2 AS (SELECT *, CASE WHEN tp + fp_pos + fp_neg_mean > 0 THEN tp / (tp + fp_pos + fp_neg_mean) WHEN recall = 1 THEN 1e0 ELSE 0e0 END AS precision FROM f),
f1s AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM f2),
curve AS (SELECT t, min(tp) AS tp_lo, max(tp) AS tp_hi, min(fp_pos) AS fp_pos_lo, max(fp_pos) AS fp_pos_hi, min(f1) AS min_f1, max(f1) AS max_f1,
  any_value(fp_neg_mean) AS fp_neg_mean FROM f1s GROUP BY t)
""".replace("LEVEL", LEVEL).replace("GRID", GRID_SQL)
CAND = """,
tied AS (SELECT list(t ORDER BY t) AS ts FROM curve WHERE min_f1 = (SELECT max(min_f1) FROM curve)),
cand AS (SELECT ts[CAST((len(ts) - 1) // 2 + 1 AS BIGINT)] AS candidate, CAST(len(ts) AS INTEGER) AS n_tied FROM tied)
"""
SWEEP_VIEWS = "v_judged v_golden v_runs"


def _fixture_runs(spark, sf, j):
    return V.runs(spark, sf, j).filter("not fail_open").select(
        "run_id", "sample_id", F.when(F.col("kind") == "clean", "negative").otherwise("positive").alias("fixture"))


def _sweep_inputs(spark, sf):
    j = V.judged(spark, sf)
    return _fixture_runs(spark, sf, j), j, V.golden(spark, sf, j)


def _per_run(spark, sf):
    return W.sweep_runs(*_sweep_inputs(spark, sf))


def _decision(spark, sf):
    return W.sweep_decision(*_sweep_inputs(spark, sf))


@query("g8_sweep_runs", match_sql(PER_RUN + """
SELECT t, run_id, fixture, n_golden, tp, fp_neg, CASE WHEN fixture = 'positive' THEN fp_pos END AS fp_pos FROM per_run""", SWEEP_VIEWS, grid=True))
def g8_runs(spark, sf):
    return _per_run(spark, sf).withColumn("fp_pos", F.when(F.col("fixture") == "positive", F.col("fp_pos")))


@query("g8_sweep_curve", match_sql(PER_RUN + """
SELECT t, tp_lo, tp_hi, fp_pos_lo, fp_pos_hi, round(min_f1, 6) AS min_f1, round(max_f1, 6) AS max_f1, round(fp_neg_mean, 6) AS fp_neg_mean,
  round(fp_neg_mean - (SELECT fp_neg_mean FROM curve WHERE t = 0.5e0), 6) AS d_fp_neg FROM curve""", SWEEP_VIEWS, grid=True))
def g8(spark, sf):
    return _decision(spark, sf)[0].withColumns(
        {c: F.round(c, 6) for c in ("min_f1", "max_f1", "fp_neg_mean", "d_fp_neg")})


@query("g9_candidate", match_sql(PER_RUN + CAND + "SELECT * FROM cand", SWEEP_VIEWS, grid=True))
def g9(spark, sf):
    return _decision(spark, sf)[1]


@query("g10_change_rules", match_sql(PER_RUN + CAND + """,
r1 AS (SELECT bool_and(c.f1 - b.f1 >= 0.2e0) AS every_run FROM f1s c JOIN cand ON c.t = candidate JOIN f1s b ON b.run_id = c.run_id AND b.t = 0.5e0),
r2 AS (SELECT bool_and(c.fp_neg <= b.fp_neg) AS ok FROM per_run c JOIN cand ON c.t = candidate JOIN per_run b ON b.run_id = c.run_id AND b.t = 0.5e0
  WHERE c.fixture = 'negative')
SELECT candidate, every_run AND candidate <> 0.5e0 AS rule_margin_ok, ok AS rule_neg_fp_ok, every_run AND candidate <> 0.5e0 AND ok AS change FROM cand, r1, r2""",
                                     SWEEP_VIEWS, grid=True))
def g10(spark, sf):
    return _decision(spark, sf)[2]


# Field cohort: every run is the run of a pull request; in every fourth sample two repeats
# share one, and some runs have a head that nobody knows.
_PR = "sample_id * 1000 + repeat - CASE WHEN sample_id % 4 = 0 AND repeat % 2 = 0 THEN 1 ELSE 0 END"
FIELD_SQL = f"""
golds AS (SELECT DISTINCT CAST({_PR} AS INTEGER) AS pr, sha256('pr' || ({_PR}))[1:40] AS sha FROM v_runs),
fr AS (SELECT label, run_id, sample_id, sha256('pr' || CASE WHEN sample_id % 2 = 1 AND repeat % 5 = 3 THEN 'x' ELSE '' END || ({_PR}))[1:40] AS fixture_head,
  fail_open, n_analyzed FROM v_runs)
"""


def _field(spark, sf):
    runs = V.runs(spark, sf).withColumn("pr", F.expr(_PR).cast("int"))

    def head(mark):
        return F.substring(F.sha2(F.concat(F.lit("pr"), mark, F.col("pr").cast("string")), 256), 1, 40)

    golds = runs.select("pr", head(F.lit("")).alias("sha")).distinct()
    stray = (F.col("sample_id") % 2 == 1) & (F.col("repeat") % 5 == 3)
    runs = runs.select("label", "run_id", "sample_id", "fail_open", "n_analyzed", head(F.when(stray, "x").otherwise("")).alias("fixture_head"),
                       F.col("n_analyzed").alias("judged_size"), F.lit("ok").alias("base_verdict"), F.lit("0").alias("n_dropped"),
                       F.lit("0").alias("n_unjudged"), F.lit("0").alias("n_size_skipped_code"), F.lit("").alias("verdict"),
                       F.lit("v09").alias("packaging_version"), F.lit("hunk").alias("wire_format"))
    return runs, golds


ONE_RUN = "one AS (SELECT pr, min(run_id) AS run_id, min(label) AS label FROM golds JOIN fr ON fixture_head = sha WHERE NOT fail_open GROUP BY pr HAVING count(*) = 1)"


@query("g11_field_runs", V.sql_with("v_runs v_samples", f"WITH {FIELD_SQL}, {ONE_RUN} SELECT pr, label FROM one"))
def g11(spark, sf):
    return W.select_field_runs(*_field(spark, sf))[0].select("pr", "label")


@query("g11_field_errors", V.sql_with("v_runs v_samples", f"""
WITH {FIELD_SQL}, good AS (SELECT * FROM fr WHERE NOT fail_open)
SELECT label, 'fail-open' AS error FROM fr WHERE fail_open
UNION ALL SELECT label, 'unknown-head' FROM good WHERE fixture_head NOT IN (SELECT sha FROM golds)
UNION ALL SELECT 'pr ' || pr, 'runs:' || count(label) FROM golds LEFT JOIN good ON fixture_head = sha GROUP BY pr HAVING count(label) <> 1"""))
def g11_errors(spark, sf):
    return W.select_field_runs(*_field(spark, sf))[1]


FIELD_SWEEP = f"""
WITH {FIELD_SQL}, {ONE_RUN},
rep AS (SELECT o.pr, dt, j.*, {LEVEL} AS lvl FROM v_judged j JOIN one o USING (run_id), {GRID_SQL.replace('g(t)', 'g(dt)')}
  WHERE is_real >= CASE WHEN rubric = 'deletion' THEN dt ELSE 0.5e0 END AND severity >= 1 AND reflex_class <> 'test'),
c AS (SELECT pr, dt, count(*) FILTER (WHERE rubric = 'deletion' AND NOT coalesce(lvl = 1 AND category = 'style', FALSE)) AS deletion_fp,
  count(*) FILTER (WHERE rubric <> 'deletion' AND NOT coalesce(lvl = 1 AND category = 'style', FALSE)) AS code_fp FROM rep GROUP BY pr, dt),
rows_ AS (SELECT dt, pr, coalesce(deletion_fp, 0) AS deletion_fp, coalesce(code_fp, 0) AS code_fp
  FROM (SELECT pr, dt FROM one, {GRID_SQL.replace('g(t)', 'g(dt)')}) LEFT JOIN c USING (pr, dt))"""


@query("g12_field_sweep", V.sql_with("v_judged v_runs v_samples", FIELD_SWEEP + " SELECT * FROM rows_"))
def g12(spark, sf):
    return W.field_sweep(V.judged(spark, sf), W.select_field_runs(*_field(spark, sf))[0])


@query("g12_field_decision", V.sql_with("v_judged v_runs v_samples", FIELD_SWEEP + """
SELECT dt, CAST(sum(deletion_fp) AS BIGINT) AS deletion_total, CAST(sum(code_fp) AS BIGINT) AS code_total,
  (SELECT CASE WHEN sum(deletion_fp) = 0 THEN 'KEEP' ELSE 'RAISE_ABOVE_GRID' END FROM rows_ WHERE dt = 0.7e0) AS decision FROM rows_ GROUP BY dt"""))
def g12_decision(spark, sf):
    return W.field_decision(W.field_sweep(V.judged(spark, sf), W.select_field_runs(*_field(spark, sf))[0]))


