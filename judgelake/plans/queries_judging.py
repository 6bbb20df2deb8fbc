"""Registered queries: batch judgment and the ledger streams."""

import pandas as pd
from pyspark.sql import functions as F

from judgelake.operators import compose as C
from judgelake.operators import judging as J
from judgelake.operators import packaging as P
from judgelake.plans import queries_compare as QC
from judgelake.plans import views as V
from judgelake.plans.queries_compose import LEVEL
from judgelake.plans.queries_packaging import CLUSTER_SQL, members, units
from judgelake.plans.registry import query
from judgelake.session import scratch_path
from judgelake.streaming import ledger_stream as LS


def length_scorer() -> J.Scorer:
    """A deterministic stand-in for a model: scores follow the state's length.

    A nested function travels to the executors by value, so this package need not be
    installed there.
    """

    def score(states: pd.DataFrame) -> pd.DataFrame:
        n = states["state"].str.len()
        text = ('{"answers": {"severity": {"score": ' + (n % 31 / 10).map("{:.1f}".format) + ', "confidence": 0.5}, "is_real_issue": {"noul": '
                + (n % 101 / 100).map("{:.2f}".format) + '}, "category": {"choice": "bug-risk"}}, "usage": {"input_tokens": ' + n.astype(str) + "}}")
        return pd.DataFrame({"payload": text, "latency_ms": (n % 50).astype(float)})

    return score


def questions(spark, sf):
    """Question texts per rubric, taken from the longest region names of the star schema."""
    r = V.table(spark, sf, "region")
    return r.select(F.when(F.col("r_regionkey") == 0, "deletion").otherwise("code-change").alias("rubric"), "r_name").groupBy("rubric").agg(F.max("r_name").alias("questions"))


@query("d1_route", V.sql_with("v_parsed", "WITH " + CLUSTER_SQL.strip() + """
SELECT change_id, line, n_changed, CASE WHEN change_type = 'code-change' THEN 'code-change' ELSE 'deletion' END AS rubric,
  (SELECT max(r_name) FROM region WHERE (r_regionkey = 0) = (change_type <> 'code-change')) AS questions FROM cl"""))
def d1(spark, sf):
    return J.route(units(spark, sf), questions(spark, sf)).select("change_id", "line", "n_changed", "rubric", "questions")


@query("d2_score_units", """
SELECT doc_id AS unit_id, CAST(length(text) % 50 AS DOUBLE) AS latency_ms, outcome, round((length(text) % 31) / 1e1, 6) AS severity, round((length(text) % 101) / 1e2, 6) AS is_real, 'bug-risk' AS category,
  CAST(length(text) AS DOUBLE) AS input_tokens FROM (SELECT *, 'ok' AS outcome FROM documents)""")
def d2(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), F.col("text").alias("state"), F.lit("q").alias("questions"))
    return J.parse_answers(J.score_units(d, length_scorer())).select("unit_id", "latency_ms", "outcome", "severity", "is_real", "category", "input_tokens")


@query("d2_score_clusters", V.sql_with("v_parsed", "WITH " + CLUSTER_SQL.strip() + """,
names AS (SELECT doc_id, h, lo, unnest(regexp_extract_all(text, '\\b(?:def|class|function|const|let|var)\\s+([A-Za-z_][\\p{L}\\p{N}_]*)', 1)) AS n FROM win WHERE kind = '-'),
sides AS (SELECT doc_id, h, lo, coalesce(list(text ORDER BY i) FILTER (WHERE kind <> '+'), []) AS b, coalesce(list(text ORDER BY i) FILTER (WHERE kind <> '-'), []) AS a FROM win GROUP BY doc_id, h, lo),
built AS (SELECT cl.*, b, a, EXISTS (SELECT 1 FROM names n WHERE n.doc_id = cl.change_id AND n.h = cl.h AND n.lo = cl.lo AND length(n) >= 3
    AND regexp_matches(array_to_string(a, chr(10)), '(^|[^\\p{L}\\p{N}_])' || n || '($|[^\\p{L}\\p{N}_])')) AS refs
  FROM cl JOIN sides s ON s.doc_id = cl.change_id AND s.h = cl.h AND s.lo = cl.lo),
sized AS (SELECT *, length(CASE WHEN change_type = 'code-change' THEN to_json({'file': file, 'location': 'around line ' || line, 'change_type': change_type, 'code_before_change': b, 'code_after_change': a})
  ELSE to_json({'file': file, 'location': 'around line ' || line, 'change_type': change_type, 'code_before_change': b, 'code_after_change': a, 'references_remaining': refs}) END) AS n FROM built)
SELECT change_id, line, n_changed, file, CASE WHEN change_type = 'code-change' THEN 'code-change' ELSE 'deletion' END AS rubric, round((n % 31) / 1e1, 6) AS severity, round((n % 101) / 1e2, 6) AS is_real, 'ok' AS outcome FROM sized"""))
def d2_clusters(spark, sf):
    keys = ["change_id", "line", "n_changed", "file", "rubric"]
    states = J.route(P.unit_states(P.clusters(members(spark, sf), with_entries=True)), questions(spark, sf))
    return J.parse_answers(J.score_units(states, length_scorer(), keys)).select(*keys, "severity", "is_real", "outcome")


def _payloads(spark, sf):
    e, k = V.table(spark, sf, "events"), F.col("event_id") % 12
    v = F.col("value").cast("string")

    def doc(sev, real, cat, usage=""):
        return F.concat(F.lit('{"answers": {"severity": '), sev, F.lit(', "is_real_issue": '), real, F.lit(', "category": '), cat, F.lit("}"), F.lit(usage), F.lit("}"))

    ok_sev, ok_real, ok_cat = F.concat(F.lit('{"score": '), v, F.lit(', "confidence": 0.25}')), F.lit('{"noul": 0.5}'), F.lit('{"choice": "style"}')
    text = (F.when(k == 0, None).when(k == 1, "{bad").when(k == 2, doc(ok_sev, F.lit('{"noul": null}'), ok_cat)).when(k == 3, doc(ok_sev, F.lit('{"noul": "0.5"}'), ok_cat))
            .when(k == 4, doc(ok_sev, F.lit('{"noul": true}'), ok_cat)).when(k == 5, doc(F.lit('{"score": "high"}'), ok_real, ok_cat)).when(k == 6, doc(F.lit("{}"), ok_real, F.lit('{"choice": null}')))
            .when(k == 7, doc(F.lit('{"score": "NaN"}'), ok_real, ok_cat)).when(k == 8, F.lit('{"answers": {"severity": {"score": 1}}}'))
            .otherwise(doc(ok_sev, ok_real, ok_cat, ', "usage": {"input_tokens": 10}')))
    return e.select("event_id", "user_id", text.alias("payload"))


OUTCOME = "CASE event_id % 12 WHEN 0 THEN 'transport' WHEN 1 THEN 'shape' WHEN 2 THEN 'shape' WHEN 3 THEN 'shape' WHEN 5 THEN 'shape' WHEN 7 THEN 'shape' WHEN 8 THEN 'shape' ELSE 'ok' END"


@query("d3_parse_answers", f"""
SELECT event_id, outcome, CASE WHEN outcome = 'ok' THEN CASE WHEN event_id % 12 = 6 THEN 0e0 ELSE value END END AS severity, CASE WHEN outcome = 'ok' THEN CASE WHEN event_id % 12 = 4 THEN 1e0 ELSE 0.5e0 END END AS is_real,
  CASE WHEN outcome = 'ok' AND event_id % 12 <> 6 THEN 'style' END AS category, CASE WHEN event_id % 12 >= 9 THEN 10e0 END AS input_tokens FROM (SELECT *, {OUTCOME} AS outcome FROM events)""")
def d3(spark, sf):
    return J.parse_answers(_payloads(spark, sf)).select("event_id", "outcome", "severity", "is_real", "category", "input_tokens")


def _calls(spark, sf):
    h = F.col("event_id") * 7 % 23
    few = F.col("user_id") % 4
    outcome = (F.when(few == 0, F.when(h % 5 == 0, "shape").otherwise("ok")).when(few == 1, F.when(h < 3, "transport").when(h < 5, "leaf").otherwise("ok"))
               .when(few == 2, F.when(h < 2, "shape").when(h < 4, "transport").otherwise("ok")).otherwise(F.when(h < 9, "leaf").when(h == 9, "transport").otherwise("ok")))
    return V.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), outcome.alias("outcome"), F.col("value").alias("latency_ms"),
                                               F.when(outcome == "ok", F.floor("value").cast("double")).alias("input_tokens"))


CALLS = """c AS (SELECT user_id AS run_id, event_id AS ord, floor(value) AS tok, value, CASE user_id % 4 WHEN 0 THEN CASE WHEN h % 5 = 0 THEN 'shape' ELSE 'ok' END WHEN 1 THEN CASE WHEN h < 3 THEN 'transport' WHEN h < 5 THEN 'leaf' ELSE 'ok' END
  WHEN 2 THEN CASE WHEN h < 2 THEN 'shape' WHEN h < 4 THEN 'transport' ELSE 'ok' END ELSE CASE WHEN h < 9 THEN 'leaf' WHEN h = 9 THEN 'transport' ELSE 'ok' END END AS outcome FROM (SELECT *, event_id * 7 % 23 AS h FROM events))"""


@query("d4_fail_open", f"""
WITH RECURSIVE {CALLS}, s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS k FROM c WHERE outcome <> 'leaf'),
walk(run_id, k, f, p, hit) AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT), 0, 0, FALSE FROM c UNION ALL
  SELECT s.run_id, s.k, CASE s.outcome WHEN 'ok' THEN 0 WHEN 'transport' THEN w.f + 1 ELSE 1 END, CASE s.outcome WHEN 'ok' THEN 0 WHEN 'shape' THEN w.p + 1 ELSE w.p END,
    w.hit OR (s.outcome = 'transport' AND w.f + 1 >= 2) OR (s.outcome = 'shape' AND w.p + 1 >= 2) FROM walk w JOIN s ON s.run_id = w.run_id AND s.k = w.k + 1)
SELECT run_id, n_calls, n_ok, n_leaf, hit OR (n_ok = 0 AND n_leaf = 0) AS fail_open FROM (SELECT run_id, bool_or(hit) AS hit FROM walk GROUP BY run_id) JOIN
  (SELECT run_id, count(*) AS n_calls, count(*) FILTER (WHERE outcome = 'ok') AS n_ok, count(*) FILTER (WHERE outcome = 'leaf') AS n_leaf FROM c GROUP BY run_id) USING (run_id)""")
def d4(spark, sf):
    return J.fail_open(_calls(spark, sf))


@query("d5_d8_call_stats", f"WITH {CALLS} SELECT run_id, round(sum(value), 1) AS total_latency_ms, round(avg(value), 1) AS avg_call_ms, round(avg(tok) FILTER (WHERE outcome = 'ok'), 6) AS avg_input_tokens FROM c GROUP BY run_id")
def d5(spark, sf):
    return J.call_stats(_calls(spark, sf)).withColumn("avg_input_tokens", F.round("avg_input_tokens", 6))


@query("d6_coverage", f"""
WITH {CALLS}, r AS (SELECT run_id, count(*) AS n_units_pre, run_id % 3 AS added_units, count(*) FILTER (WHERE outcome IN ('leaf', 'shape') AND run_id % 5 <> 0) AS n_unjudged, CASE WHEN run_id % 7 = 0 THEN 2 ELSE 0 END AS n_dropped,
  CASE WHEN run_id % 11 = 0 THEN 1 ELSE 0 END AS n_size_skipped_code, run_id % 13 = 0 AS fail_open FROM c GROUP BY run_id)
SELECT run_id, n_units_pre + added_units AS n_units_total, n_units_pre + added_units - n_unjudged AS n_judged, CASE WHEN fail_open THEN 'fail-open' WHEN n_unjudged > 0 OR n_dropped > 0 OR n_size_skipped_code > 0 THEN 'incomplete review' ELSE 'ok' END AS status FROM r""")
def d6(spark, sf):
    k = F.col("run_id")
    r = _calls(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_units_pre"), F.count_if(F.col("outcome").isin("leaf", "shape") & (k % 5 != 0)).alias("n_unjudged")).withColumns(
        {"added_units": k % 3, "n_dropped": F.when(k % 7 == 0, 2).otherwise(0), "n_size_skipped_code": F.when(k % 11 == 0, 1).otherwise(0), "fail_open": k % 13 == 0})
    return J.coverage(r).select("run_id", "n_units_total", "n_judged", "status")


def _findings(spark, sf):
    k = F.col("ord") % 9
    return V.judged(spark, sf).withColumn("parse_error", k.isin(0, 1)).withColumn("skip_reason", F.when(k == 0, "unsplittable>cap"))


DIGEST = f"""'- ' || file || ':' || line || CASE WHEN ord % 9 = 0 THEN ' unjudged (skipped: unsplittable>cap)' WHEN ord % 9 = 1 THEN ' unjudged (provider call failed)'
  ELSE ' severity=' || ['none', 'MINOR', 'MAJOR', 'BLOCKER'][{LEVEL} + 1] || ' category=' || coalesce(category, 'None') END"""


@query("b27_digest_label", V.sql_with("v_judged", f"SELECT ord, {DIGEST} AS label FROM v_judged"))
def b27(spark, sf):
    return _findings(spark, sf).select("ord", J.digest_label().alias("label"))


@query("d7_run_digest", V.sql_with("v_judged v_skipped", f"""
WITH l AS (SELECT run_id, 0 AS z, ord, {DIGEST} AS t FROM v_judged UNION ALL SELECT run_id, 1, ord, '- ' || file || ':' || coalesce('' || line_start, '?') || ' unjudged (skipped: ' || reason || ')' FROM v_skipped
  WHERE reason LIKE 'hunk>%' AND change_type NOT IN ('deletion-only', 'whole-file-deleted'))
SELECT run_id, string_agg(t, chr(10) ORDER BY z, ord) AS digest FROM l GROUP BY run_id"""))
def d7(spark, sf):
    return J.run_digest(_findings(spark, sf), C.size_skipped_code(V.skipped(spark, sf)), V.runs(spark, sf))


@query("s1_latest_stream", "SELECT label, event_id, value FROM (SELECT 'u' || user_id || ':' || event_type AS label, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def s1(spark, sf):
    src, store, check = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-check"))
    V.table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("label"), "event_id", "value").repartition(4).write.json(src)
    order = ("event_id",)
    LS.start_latest(LS.read_ledger_stream(spark, src, "label string, event_id bigint, value double", 2), store, check, order).awaitTermination()
    return LS.latest(spark, store, order).select("label", "event_id", "value")


# Fifty events share a time; their order in the file decides. Times do not cross files.
@query("s1_equal_times", "SELECT label, event_id, value FROM (SELECT 'u' || user_id || ':' || event_type AS label, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def s1_equal_times(spark, sf):
    src, store, check = (scratch_path(spark, n) for n in ("ties-in", "ties-out", "ties-check"))
    rows = V.table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("label"), "event_id", "value",
                                               F.floor(F.col("event_id") / 50).alias("ts"))
    rows.repartitionByRange(8, "ts").sortWithinPartitions("event_id").write.json(src)
    stream = LS.read_ledger_stream(spark, src, "label string, event_id bigint, value double, ts bigint", 1)
    LS.start_latest(stream, store, check, folders=3).awaitTermination()
    return LS.latest(spark, store).select("label", "event_id", "value")


@query("s2_class_stream", V.sql_with("v_judged", f"""
WITH {QC.FIRINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY id DESC) AS r FROM fir WHERE sustained IS NOT NULL),
s AS (SELECT class, count(*) AS n_adjudicated, count(*) FILTER (WHERE sustained) AS n_sustained, count(*) FILTER (WHERE r <= 10) AS n_last,
  count(*) FILTER (WHERE sustained) / count(*) AS rate, count(*) FILTER (WHERE sustained AND r <= 10) / count(*) FILTER (WHERE r <= 10) AS recent_rate FROM o GROUP BY class)
SELECT class, n_adjudicated, n_sustained, n_last, round(rate, 6) AS rate, round(recent_rate, 6) AS recent_rate,
  CASE WHEN n_last >= 10 AND recent_rate < 0.5e0 THEN 'retire' WHEN n_adjudicated >= 10 AND rate >= 0.7e0 THEN 'ship' ELSE 'hold' END AS status FROM s"""))
def s2(spark, sf):
    src, store, check = (scratch_path(spark, n) for n in ("class-in", "class-out", "class-check"))
    QC._outcomes(spark, sf).select("class", F.col("id").alias("ts"), "id", "sustained").repartition(5).write.parquet(src)
    stream = spark.readStream.schema("class string, ts bigint, id bigint, sustained boolean").option("maxFilesPerTrigger", 2).parquet(src)
    LS.start_class_state(stream, store, check).awaitTermination()
    return LS.class_state(spark, store).select("class", "n_adjudicated", "n_sustained", "n_last", F.round("rate", 6).alias("rate"), F.round("recent_rate", 6).alias("recent_rate"), "status")

