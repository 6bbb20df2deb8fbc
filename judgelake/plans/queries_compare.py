"""Registered queries: two-arm comparisons and ledger statistics."""

from pyspark.sql import functions as F

from judgelake.operators import compare as A
from judgelake.operators import stats as T
from judgelake.plans import views as V
from judgelake.plans.queries_compose import PASS
from judgelake.plans.queries_evaluate import GREEDY
from judgelake.plans.registry import query

# Odd repeats are the on arm, even ones the off arm; two repeats make a pair.
ARMS_SQL = """
SELECT * REPLACE (CAST((repeat + 1) // 2 AS INTEGER) AS repeat, CAST(line // 4 AS INTEGER) AS line, CAST(line // 4 + 2 AS INTEGER) AS line_end),
  CASE WHEN repeat % 2 = 1 THEN 'on' ELSE 'off' END AS arm FROM v_judged
"""
V.VIEWS_SQL["v_arms"] = (("v_judged",), ARMS_SQL)


def arms(spark, sf, j=None):
    place = F.floor(F.col("line") / 4).cast("int")
    return ((V.judged(spark, sf) if j is None else j).withColumn("arm", F.when(F.col("repeat") % 2 == 1, "on").otherwise("off"))
            .withColumn("repeat", F.floor((F.col("repeat") + 1) / 2).cast("int")).withColumn("line_end", place + 2).withColumn("line", place))


def _golden(spark, sf, j=None):
    return V.golden(spark, sf, j).withColumn("line", F.floor(F.col("line") / 4).cast("int"))


GOLD4 = "v_golden4 AS (SELECT * REPLACE (CAST(line // 4 AS INTEGER) AS line) FROM v_golden)"


@query("h1_guard", V.sql_with("v_runs", """
SELECT run_id, arm, CASE WHEN fail_open OR status = 'fail-open' THEN 'fail-open' WHEN status <> 'ok' THEN 'status' WHEN arm = 'off' AND stamp <> 'none' THEN 'off-arm-stamped'
  WHEN arm = 'on' AND stamp NOT IN ('ts-ast', 'ast+ts-ast') THEN 'on-arm-not-stamped' WHEN arm = 'on' AND n % 5 = 0 THEN 'wheels-unavailable' END AS reason
FROM (SELECT run_id, fail_open, n, CASE WHEN repeat % 2 = 1 THEN 'on' ELSE 'off' END AS arm, CASE n % 11 WHEN 0 THEN 'fail-open' WHEN 1 THEN 'incomplete review' ELSE 'ok' END AS status,
  CASE n % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'ts-ast' WHEN 2 THEN 'ast+ts-ast' ELSE CASE WHEN repeat % 2 = 1 THEN 'ast' ELSE 'none' END END AS stamp
  FROM (SELECT *, sample_id * 7 + repeat AS n FROM v_runs))"""))
def h1(spark, sf):
    n, odd = F.col("n"), F.col("repeat") % 2 == 1
    r = V.runs(spark, sf).withColumn("n", F.col("sample_id") * 7 + F.col("repeat")).select(
        "run_id", "fail_open", F.when(odd, "on").otherwise("off").alias("arm"),
        F.when(n % 11 == 0, "fail-open").when(n % 11 == 1, "incomplete review").otherwise("ok").alias("status"),
        F.when(n % 4 == 0, "none").when(n % 4 == 1, "ts-ast").when(n % 4 == 2, "ast+ts-ast").when(odd, "ast").otherwise("none").alias("enrichment"),
        F.create_map(F.lit("ts"), F.struct((n % 5 != 0).alias("available"), F.lit("1").alias("version"))).alias("wheels"))
    return r.select("run_id", "arm", A.guard_reason(F.col("arm"), F.lit("ts-ast")).alias("reason"))


ARM_COUNTS = f"""
rep AS (SELECT run_id || ':' || arm AS run_id, 0.8e0 AS t, * EXCLUDE (run_id) FROM v_arms WHERE {PASS.format(t='0.8e0')} AND reflex_class <> 'test'),
{GREEDY.replace('v_golden', 'v_golden4')},
tp AS (SELECT m.sample_id, r.repeat, r.arm, count(*) AS tp FROM matches m JOIN rep r USING (run_id, ord) GROUP BY ALL),
counts AS (SELECT sample_id, repeat, arm, coalesce(n_surfaced, 0) AS n_surfaced, coalesce(tp, 0) AS tp FROM (SELECT DISTINCT sample_id, repeat, arm FROM v_arms)
  LEFT JOIN (SELECT sample_id, repeat, arm, count(*) AS n_surfaced FROM rep GROUP BY ALL) USING (sample_id, repeat, arm) LEFT JOIN tp USING (sample_id, repeat, arm))"""


@query("h2_arm_counts", V.sql_with("v_arms v_golden", f"WITH {GOLD4}, {ARM_COUNTS} SELECT * FROM counts", recursive=True))
def h2(spark, sf):
    return A.arm_counts(arms(spark, sf), _golden(spark, sf))


@query("h3_unreachable_golden", V.sql_with("v_arms v_golden", f"""
WITH {GOLD4} SELECT r.sample_id, r.repeat, r.arm, g.golden_idx, g.file, g.line FROM (SELECT DISTINCT sample_id, repeat, arm FROM v_arms) r JOIN v_golden4 g USING (sample_id)
WHERE NOT EXISTS (SELECT 1 FROM v_arms j WHERE j.sample_id = r.sample_id AND j.repeat = r.repeat AND j.arm = r.arm AND j.file = g.file AND abs(j.line - g.line) <= 1)"""))
def h3(spark, sf):
    return A.unreachable_golden(arms(spark, sf), _golden(spark, sf)).select("sample_id", "repeat", "arm", "golden_idx", "file", "line")


FILES_SQL = "files AS (SELECT DISTINCT sample_id, file FROM v_golden UNION SELECT DISTINCT sample_id, file FROM v_judged WHERE file = 'src/purchase.py' OR file LIKE 'src/s%')"


@query("h4_enriched_shares", V.sql_with("v_arms v_golden", f"""
WITH {FILES_SQL}, due AS (SELECT r.sample_id, repeat, file FROM (SELECT DISTINCT sample_id, repeat FROM v_arms WHERE arm = 'on') r JOIN files f ON f.sample_id = r.sample_id)
SELECT d.sample_id, d.repeat, d.file, count(j.ord) AS n_units, count(*) FILTER (WHERE enrichment = 'ast') AS n_enriched,
  round(coalesce(count(*) FILTER (WHERE enrichment = 'ast') / nullif(count(j.ord), 0), 0), 6) AS share,
  CASE WHEN count(j.ord) = 0 THEN 'not-judged' WHEN count(*) FILTER (WHERE enrichment = 'ast') = 0 THEN 'no-enriched-unit' END AS abort
FROM due d LEFT JOIN (SELECT * FROM v_arms WHERE arm = 'on') j ON j.sample_id = d.sample_id AND j.repeat = d.repeat AND j.file = d.file GROUP BY d.sample_id, d.repeat, d.file"""))
def h4(spark, sf):
    j = arms(spark, sf).filter("arm = 'on'")
    names = V.judged(spark, sf).select("sample_id", "file")
    negative = names.filter(F.col("file").startswith("src/s")).select("sample_id", "file", F.lit("x").alias("verify_substring")).unionByName(
        names.filter(F.col("file").startswith("src/c")).select("sample_id", "file", F.lit("GONE").alias("verify_substring")))
    files = A.guard_file_set(V.golden(spark, sf), negative, names.filter("file = 'src/purchase.py'"), "ast")
    return A.enriched_shares(j, files, "ast").withColumn("share", F.round("share", 6))


PAIRS = """
units AS (SELECT *, file || ':' || line || ':' || line_end AS unit FROM v_arms),
on_ AS (SELECT sample_id, repeat, unit, arg_max(is_real, ord) AS v FROM units WHERE arm = 'on' AND is_real IS NOT NULL GROUP BY ALL),
off_ AS (SELECT * FROM (SELECT sample_id, repeat, unit, is_real AS v, row_number() OVER (PARTITION BY sample_id, repeat, unit ORDER BY ord DESC) AS r FROM units WHERE arm = 'off') WHERE r = 1),
deltas AS (SELECT sample_id, repeat, unit, on_.v - off_.v AS delta FROM on_ JOIN off_ USING (sample_id, repeat, unit) WHERE off_.v IS NOT NULL),
means AS (SELECT sample_id, unit, round(avg(delta), 9) AS delta FROM deltas GROUP BY sample_id, unit),
summ AS (SELECT sample_id, count(*) AS n_paired_units, avg(delta) AS mean_delta, count(*) FILTER (WHERE delta > 0) AS better, count(*) FILTER (WHERE delta < 0) AS worse FROM means GROUP BY sample_id),
tails AS (SELECT sample_id, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2e0))) AS tail FROM
  (SELECT sample_id, CAST(better + worse AS DOUBLE) AS n, unnest(range(0, least(better, worse) + 1)) AS i FROM summ) GROUP BY sample_id),
tested AS (SELECT s.*, CASE WHEN better + worse = 0 THEN 1e0 ELSE least(1e0, 2e0 * tail) END AS sign_test_p FROM summ s JOIN tails USING (sample_id))"""


@query("h5_paired_deltas", V.sql_with("v_arms", f"WITH {PAIRS.strip()} SELECT sample_id, repeat, unit, round(delta, 6) AS delta FROM deltas"))
def h5(spark, sf):
    return A.paired_deltas(arms(spark, sf)).withColumn("delta", F.round("delta", 6))


@query("h6_unit_means", V.sql_with("v_arms", f"WITH {PAIRS.strip()} SELECT sample_id, unit, round(delta, 6) AS delta FROM means"))
def h6(spark, sf):
    return A.unit_means(A.paired_deltas(arms(spark, sf))).withColumn("delta", F.round("delta", 6))


def _summary(spark, sf):
    return A.delta_summary(A.unit_means(A.paired_deltas(arms(spark, sf))))


@query("h7_sign_test", V.sql_with("v_arms", f"""WITH {PAIRS.strip()} SELECT sample_id, n_paired_units, round(mean_delta, 6) AS mean_delta, better, worse, round(sign_test_p, 6) AS sign_test_p FROM tested"""))
def h7(spark, sf):
    return _summary(spark, sf).withColumns({"mean_delta": F.round("mean_delta", 6), "sign_test_p": F.round("sign_test_p", 6)})


DECIDE = """
cells AS (SELECT sample_id, repeat, coalesce(sum(fp) FILTER (WHERE arm = 'on'), 0) AS on_fp, coalesce(sum(fp) FILTER (WHERE arm = 'off'), 0) AS off_fp,
    coalesce(sum(tp) FILTER (WHERE arm = 'on'), 0) AS on_tp, coalesce(sum(tp) FILTER (WHERE arm = 'off'), 0) AS off_tp
  FROM (SELECT *, n_surfaced - CASE WHEN sample_id % 3 = 0 THEN 0 ELSE tp END AS fp FROM counts) GROUP BY ALL),
per AS (SELECT sample_id, sum(on_fp) <= sum(off_fp) + 1 AS precision_ok, bool_and(on_tp >= off_tp + 2) AS recall_signal FROM cells GROUP BY sample_id),
dec AS (SELECT p.sample_id, precision_ok, recall_signal, coalesce(n_paired_units, 0) AS n_paired_units, coalesce(better, 0) + coalesce(worse, 0) < 6 AS underpowered,
  CASE WHEN NOT precision_ok OR coalesce(mean_delta < 0 AND worse > better AND sign_test_p < 0.05e0, FALSE) THEN 'KILL' WHEN recall_signal THEN 'SIGNAL' ELSE 'NO-DETECTABLE-EFFECT' END AS verdict
  FROM per p LEFT JOIN tested USING (sample_id))"""


def _decided(spark, sf):
    j = V.judged(spark, sf)
    samples = V.samples(spark, sf, V.runs(spark, sf, j)).select("sample_id", (F.col("kind") == "clean").alias("clean"))
    pairs = arms(spark, sf, j)
    return A.decide(A.arm_counts(pairs, _golden(spark, sf, j)), A.delta_summary(A.unit_means(A.paired_deltas(pairs))), samples)


@query("h8_decide", V.sql_with("v_arms v_golden", f"WITH {GOLD4}, {ARM_COUNTS}, {PAIRS}, {DECIDE} SELECT * FROM dec", recursive=True))
def h8(spark, sf):
    return _decided(spark, sf).select("sample_id", "precision_ok", "recall_signal", "n_paired_units", "underpowered", "verdict")


@query("h9_combine", V.sql_with("v_arms v_golden v_samples", f"""WITH {GOLD4}, {ARM_COUNTS}, {PAIRS}, {DECIDE},
res AS (SELECT *, sample_id % 3 <> 0 AS golden FROM dec WHERE sample_id % 10 <> 9 AND verdict <> 'KILL'),
miss AS (SELECT count(*) AS n_missing FROM v_samples WHERE sample_id NOT IN (SELECT sample_id FROM res))
SELECT n_missing, CASE WHEN (SELECT count(*) FROM res WHERE verdict = 'KILL') > 0 THEN 'KILL' WHEN n_missing > 0 THEN 'NO-DETECTABLE-EFFECT'
  WHEN (SELECT bool_and(verdict = 'SIGNAL') FROM res WHERE golden) THEN 'SIGNAL' ELSE 'NO-DETECTABLE-EFFECT' END AS combined_verdict FROM miss""", recursive=True))
def h9(spark, sf):
    res = _decided(spark, sf).filter("sample_id % 10 <> 9 and verdict <> 'KILL'").withColumn("golden", F.col("sample_id") % 3 != 0)
    return A.combine(res, V.samples(spark, sf))


def _probe(spark, sf):
    e, k = V.table(spark, sf, "events"), F.col("event_id")
    return e.select(F.concat(F.when(F.col("user_id") % 5 == 0, "CONTROL-").otherwise("U-"), F.col("user_id").cast("string")).alias("unit"),
                    F.when(k % 2 == 0, "clean").otherwise("fact").alias("variant"), (k % 13 != 0).alias("ok"),
                    (F.floor(F.least(F.col("value"), F.lit(100.0))) / F.lit(100.0)).alias("is_real"))


PROBE = """p AS (SELECT CASE WHEN user_id % 5 = 0 THEN 'CONTROL-' ELSE 'U-' END || user_id AS unit, CASE WHEN event_id % 2 = 0 THEN 'clean' ELSE 'fact' END AS variant,
  event_id % 13 <> 0 AS ok, floor(least(value, 1e2)) / 1e2 AS is_real FROM events)"""


@query("h10_probe_arms", f"WITH {PROBE} SELECT unit, " + ", ".join(
    f"round(avg(is_real) FILTER (WHERE variant = '{v}') + 1e-9, 6) AS {v}_mean, min(is_real) FILTER (WHERE variant = '{v}') AS {v}_min, max(is_real) FILTER (WHERE variant = '{v}') AS {v}_max"
    for v in ("clean", "fact")) + " FROM p WHERE ok GROUP BY unit")
def h10(spark, sf):
    return A.probe_arms(_probe(spark, sf)).withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("clean_mean", "fact_mean")})


@query("h10_probe_control", f"WITH {PROBE} SELECT max(is_real) AS max_is_real, max(is_real) < 0.5e0 AS passes FROM p WHERE ok AND unit LIKE 'CONTROL%' AND variant = 'fact'")
def h10_control(spark, sf):
    return A.probe_control(_probe(spark, sf))


@query("h11_batching_metrics", V.sql_with("v_arms", """
WITH u AS (SELECT sample_id, repeat, rubric, file || ':' || line || ':' || line_end AS unit, arg_max(is_real, ord) FILTER (WHERE arm = 'on') AS a, arg_max(is_real, ord) FILTER (WHERE arm = 'off') AS b
  FROM v_arms WHERE is_real IS NOT NULL GROUP BY ALL),
d AS (SELECT rubric, a - b AS delta, (a >= g) <> (b >= g) AS flip FROM (SELECT *, CASE WHEN rubric = 'deletion' THEN 0.7e0 ELSE 0.5e0 END AS g FROM u) WHERE a IS NOT NULL AND b IS NOT NULL),
s AS (SELECT rubric, count(*) AS n_pairs, count(*) FILTER (WHERE flip) AS n_flips, avg(delta) AS mean_delta, count(*) FILTER (WHERE delta > 0) AS better, count(*) FILTER (WHERE delta < 0) AS worse FROM d GROUP BY rubric),
tails AS (SELECT rubric, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2e0))) AS tail FROM
  (SELECT rubric, CAST(better + worse AS DOUBLE) AS n, unnest(range(0, least(better, worse) + 1)) AS i FROM s) GROUP BY rubric)
SELECT rubric, n_pairs, n_flips, round(mean_delta, 6) AS mean_delta, better, worse, round(n_flips / n_pairs, 6) AS flip_rate, round(least(1e0, 2e0 * tail), 6) AS sign_test_p FROM s JOIN tails USING (rubric)"""))
def h11(spark, sf):
    return A.batching_metrics(arms(spark, sf)).withColumns({c: F.round(c, 6) for c in ("mean_delta", "flip_rate", "sign_test_p")})


@query("h12_findings_jaccard", V.sql_with("v_arms", f"""
WITH p AS (SELECT sample_id, repeat, file, line, bool_or(arm = 'on') AS a, bool_or(arm = 'off') AS b FROM v_arms WHERE {PASS.format(t='0.5e0')} AND reflex_class <> 'test' GROUP BY ALL),
c AS (SELECT sample_id, repeat, count(*) FILTER (WHERE a AND b) / count(*) AS j FROM p GROUP BY ALL) SELECT sample_id, round(avg(j), 6) AS jaccard, count(*) AS n_repeats FROM c GROUP BY sample_id"""))
def h12(spark, sf):
    from judgelake.operators.compose import compose
    return A.findings_jaccard(compose(arms(spark, sf))).withColumn("jaccard", F.round("jaccard", 6))


def _firings(spark, sf):
    return V.judged(spark, sf).select(F.col("file").alias("class"), "ts", F.col("ord").alias("id"), F.when(F.col("ord") % 4 != 3, F.col("is_real") >= 0.2).alias("sustained"),
                                      F.floor("value").alias("cost"))


FIRINGS = "fir AS (SELECT file AS class, ts, ord AS id, CASE WHEN ord % 4 <> 3 THEN is_real >= 0.2e0 END AS sustained, CAST(floor(value) AS BIGINT) AS cost FROM v_judged)"


@query("j1_sustained_rates", V.sql_with("v_judged", f"""
WITH {FIRINGS} SELECT class, count(*) AS n_firings, count(sustained) AS n_adjudicated, count(*) FILTER (WHERE sustained) AS n_sustained, CAST(sum(cost) AS BIGINT) AS cost,
  round(count(*) FILTER (WHERE sustained) / count(sustained), 6) AS sustained_rate, round(sum(cost) / count(*) FILTER (WHERE sustained), 6) AS cost_per_sustained FROM fir GROUP BY class"""))
def j1(spark, sf):
    return T.sustained_rates(_firings(spark, sf)).withColumns({c: F.round(c, 6) for c in ("sustained_rate", "cost_per_sustained")})


def _outcomes(spark, sf):
    return _firings(spark, sf).filter(F.col("sustained").isNotNull()).drop("cost")


@query("j2_class_status", V.sql_with("v_judged", f"""
WITH {FIRINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY ts DESC, id DESC) AS r FROM fir WHERE sustained IS NOT NULL),
s AS (SELECT class, count(*) AS n_adjudicated, count(*) FILTER (WHERE sustained) AS n_sustained, count(*) FILTER (WHERE r <= 10) AS n_last,
  count(*) FILTER (WHERE sustained) / count(*) AS rate, count(*) FILTER (WHERE sustained AND r <= 10) / count(*) FILTER (WHERE r <= 10) AS recent_rate FROM o GROUP BY class)
SELECT class, n_adjudicated, n_sustained, n_last, round(rate, 6) AS rate, round(recent_rate, 6) AS recent_rate,
  CASE WHEN n_last >= 10 AND recent_rate < 0.5e0 THEN 'retire' WHEN n_adjudicated >= 10 AND rate >= 0.7e0 THEN 'ship' ELSE 'hold' END AS status FROM s"""))
def j2(spark, sf):
    return T.class_status(_outcomes(spark, sf)).withColumns({c: F.round(c, 6) for c in ("rate", "recent_rate")})


@query("j2_rolling_rate", V.sql_with("v_judged", f"""
WITH {FIRINGS} SELECT class, id, row_number() OVER (PARTITION BY class ORDER BY ts, id) - 1 AS pos, count(*) OVER w AS n_window, round(count(*) FILTER (WHERE sustained) OVER w / count(*) OVER w, 6) AS rate
FROM fir WHERE sustained IS NOT NULL WINDOW w AS (PARTITION BY class ORDER BY ts, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""))
def j2_rolling(spark, sf):
    return T.rolling_rate(_outcomes(spark, sf), chunk=100).select("class", "id", F.col("pos").cast("bigint").alias("pos"), "n_window", F.round("rate", 6).alias("rate"))


@query("j3_change_classes", """
SELECT conv_id AS range_id, count(*) AS n_files, bool_and(turn % 8 = 0) AS docs_only, bool_and(turn % 8 = 1) AS lockfile, bool_and(turn % 8 = 2) AS generated, bool_and(turn % 2 = 0 AND conv_id % 3 = 0) AS rename_only,
  bool_and(turn % 2 = 1 AND conv_id % 3 <> 1 AND regexp_matches(text, '\\s')) AS whitespace_only, bool_and(turn % 8 = 3) AS test_only FROM (SELECT * REPLACE (CASE WHEN conv_id % 5 = 0 THEN conv_id // 5 % 4 ELSE turn END AS turn) FROM conversations) GROUP BY conv_id""")
def j3(spark, sf):
    return T.change_classes(_ranges(spark, sf))


def _ranges(spark, sf):
    c = V.table(spark, sf, "conversations")
    turn = F.when(F.col("conv_id") % 5 == 0, F.floor(F.col("conv_id") / 5) % 4).otherwise(F.col("turn"))
    path = V._pick(["a/readme.md", "a/yarn.lock", "dist/x.js", "tests/a.py", "src/a.py", "src/b.py", "src/c.py", "src/d.py"], turn % 8)
    even = turn % 2 == 0
    third = F.col("conv_id") % 3
    return c.select(F.col("conv_id").alias("range_id"), path.alias("path"), F.when(even & (third == 0), "old/name.py").otherwise(path).alias("old_path"),
                    F.col("text").alias("before"), F.when(even, F.col("text")).when(third != 1, F.regexp_replace("text", "\\s+", "  \t"))
                    .otherwise(F.concat("text", F.lit("!"))).alias("after"))


@query("j3_class_yield", """
WITH c AS (SELECT conv_id, bool_and(turn % 8 = 0) AS docs_only, bool_and(turn % 8 = 1) AS lockfile, bool_and(turn % 8 = 2) AS generated, bool_and(turn % 2 = 0 AND conv_id % 3 = 0) AS rename_only,
  bool_and(turn % 2 = 1 AND conv_id % 3 <> 1 AND regexp_matches(text, '\\s')) AS whitespace_only, bool_and(turn % 8 = 3) AS test_only FROM (SELECT * REPLACE (CASE WHEN conv_id % 5 = 0 THEN conv_id // 5 % 4 ELSE turn END AS turn) FROM conversations) GROUP BY conv_id),
s AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT class, count(*) AS n_ranges, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_sustained FROM c UNPIVOT (member FOR class IN (docs_only, lockfile, generated, rename_only, whitespace_only, test_only)) LEFT JOIN s USING (conv_id) WHERE member GROUP BY class""")
def j3_yield(spark, sf):
    sustained = V.table(spark, sf, "conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("range_id"))
    return T.class_yield(T.change_classes(_ranges(spark, sf)), sustained)


@query("j4_score_distribution", V.sql_with("v_judged", "SELECT category, CAST(least(10, floor(confidence * 10) + 1) AS INTEGER) AS bin, count(*) AS n FROM (SELECT category, (ord % 11) / 1e1 AS confidence FROM v_judged) GROUP BY ALL"))
def j4(spark, sf):
    return T.score_distribution(V.judged(spark, sf), "confidence", ["category"])


@query("j4_score_quantiles", V.sql_with("v_judged", "SELECT category, rubric, count(is_real) AS n, round(quantile_cont(is_real, 0.25), 6) AS q25, round(quantile_cont(is_real, 0.5), 6) AS median, round(quantile_cont(is_real, 0.75), 6) AS q75 FROM v_judged WHERE is_real IS NOT NULL GROUP BY ALL"))
def j4_quantiles(spark, sf):
    return T.score_quantiles(V.judged(spark, sf), "is_real", ["category", "rubric"]).withColumns({c: F.round(c, 6) for c in ("q25", "median", "q75")})


ADJ = "adj AS (SELECT ord, CASE WHEN repeat % 2 = 0 THEN 'on' ELSE 'off' END AS arm, sample_id AS pr, CASE WHEN is_real IS NULL THEN 'DUP' WHEN is_real >= 0.3e0 THEN 'REAL' ELSE 'FP' END AS verdict FROM v_judged)"


def _adjudicated(spark, sf):
    return V.judged(spark, sf).select("ord", F.when(F.col("repeat") % 2 == 0, "on").otherwise("off").alias("arm"), F.col("sample_id").alias("pr"),
                                      F.when(F.col("is_real").isNull(), "DUP").when(F.col("is_real") >= 0.3, "REAL").otherwise("FP").alias("verdict"))


ARM_RATES = f"""
WITH {ADJ}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY ord) AS k FROM adj WHERE verdict <> 'DUP') WHERE k <= 10),
rates AS (SELECT arm, count(*) FILTER (WHERE verdict = 'REAL') AS n_real, count(*) FILTER (WHERE verdict = 'FP') AS n_fp, round(count(*) FILTER (WHERE verdict = 'REAL') / count(*), 6) AS sustained_rate, count(*) >= 10 AS stopped FROM f GROUP BY arm)"""


@query("j5_arm_rates", V.sql_with("v_judged", ARM_RATES + " SELECT * FROM rates"))
def j5(spark, sf):
    return T.arm_rates(_adjudicated(spark, sf)).withColumn("sustained_rate", F.round("sustained_rate", 6))


@query("j5_arm_decision", V.sql_with("v_judged", ARM_RATES + """, d AS (SELECT max(sustained_rate) FILTER (WHERE arm = 'on') AS on_rate, max(sustained_rate) FILTER (WHERE arm = 'off') AS off_rate, count(*) FILTER (WHERE stopped) AS n_stopped,
  (SELECT count(DISTINCT pr) FROM adj) AS n_prs FROM rates) SELECT *, CASE WHEN n_stopped < 2 AND n_prs < 15 THEN 'open' WHEN on_rate >= off_rate THEN 'keep' ELSE 'flip' END AS decision FROM d"""))
def j5_decision(spark, sf):
    adj = _adjudicated(spark, sf)
    return T.arm_decision(T.arm_rates(adj).withColumn("sustained_rate", F.round("sustained_rate", 6)), adj.select("pr"))


@query("j6_detector_screen", V.sql_with("v_judged", """
SELECT detector, round(coalesce(avg(fired) FILTER (WHERE sample_id % 3 = 0), 0), 6) AS clean_rate, round(coalesce(avg(fired) FILTER (WHERE sample_id % 3 <> 0), 0), 6) AS positive_rate,
  coalesce(avg(fired) FILTER (WHERE sample_id % 3 = 0), 0) >= coalesce(avg(fired) FILTER (WHERE sample_id % 3 <> 0), 0) AS dropped
FROM (SELECT category AS detector, sample_id, CASE WHEN is_real >= 0.5e0 THEN 1 ELSE 0 END AS fired FROM v_judged WHERE category IS NOT NULL) GROUP BY detector"""))
def j6(spark, sf):
    fires = V.judged(spark, sf).filter("category is not null").select(F.col("category").alias("detector"), F.when(F.col("sample_id") % 3 == 0, "clean").otherwise("positive").alias("kind"),
                                                                      F.coalesce(F.col("is_real") >= 0.5, F.lit(False)).alias("fired"))
    return T.detector_screen(fires).withColumns({c: F.round(c, 6) for c in ("clean_rate", "positive_rate")})


def _labelled(spark, sf):
    return V.paths(spark, sf).withColumn("label", F.when(F.col("page_id") % 16 % 5 == 0, "test").otherwise("production"))


AUDIT = "a AS (SELECT CASE WHEN page_id % 16 % 5 = 0 THEN 'test' ELSE 'production' END AS label, CASE WHEN page_id % 16 IN (2, 5, 8, 9, 10, 13) THEN 'test' ELSE 'code' END AS routed, count(*) AS n FROM v_paths GROUP BY ALL)"


@query("j7_routing_audit", V.sql_with("v_paths", f"WITH {AUDIT} SELECT * FROM a"))
def j7(spark, sf):
    return T.routing_audit(_labelled(spark, sf))


@query("j7_routing_gate", V.sql_with("v_paths", f"WITH {AUDIT} SELECT CAST(coalesce(sum(n) FILTER (WHERE label = 'production' AND routed = 'test'), 0) AS BIGINT) AS production_as_test, coalesce(sum(n) FILTER (WHERE label = 'production' AND routed = 'test'), 0) = 0 AS passes FROM a"))
def j7_gate(spark, sf):
    return T.routing_gate(T.routing_audit(_labelled(spark, sf)))
