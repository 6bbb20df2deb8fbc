"""Registered queries: gates, holds, ranking, verdicts, skips."""


from judgelake.operators import compose as C
from judgelake.plans import views as V
from judgelake.plans.registry import query

RUN = ["run_id"]

OWN = "CASE WHEN rubric = 'deletion' THEN 0.7e0 ELSE {t} END"
LEVEL = "CAST(least(3, greatest(0, floor(coalesce(severity, 0) + 0.5e0))) AS INTEGER)"
PASS = f"is_real >= {OWN} AND coalesce(severity, 0) >= 1"


def reported_sql(t: str = "0.5e0") -> str:
    return f"SELECT * FROM v_judged WHERE {PASS.format(t=t)} AND reflex_class <> 'test'"


@query("e1_compose", V.sql_with("v_judged", f"""
SELECT run_id, ord, file, line, severity, is_real, category, rubric FROM v_judged
WHERE {PASS.format(t='0.5e0')} AND reflex_class <> 'test'"""))
def e1(spark, sf):
    return C.compose(V.judged(spark, sf)).select(
        "run_id", "ord", "file", "line", "severity", "is_real", "category", "rubric")


@query("e2_jitter", V.sql_with("v_judged", f"""
SELECT run_id, ord, file, is_real FROM v_judged
WHERE is_real IS NOT NULL AND abs(is_real - {OWN.format(t='0.5e0')}) <= 0.03e0"""))
def e2(spark, sf):
    return C.jitter_rows(V.judged(spark, sf)).select("run_id", "ord", "file", "is_real")


@query("e3_held_counts", V.sql_with("v_judged", f"""
SELECT run_id, count(*) FILTER (WHERE {PASS.format(t='0.8e0')}) AS n_passing,
  count(*) FILTER (WHERE {PASS.format(t='0.8e0')} AND reflex_class <> 'test') AS n_reported,
  count(*) FILTER (WHERE {PASS.format(t='0.8e0')} AND reflex_class = 'test') AS n_held
FROM v_judged GROUP BY run_id"""))
def e3(spark, sf):
    return C.held_counts(V.judged(spark, sf), RUN)


@query("e4_rank_and_cap", V.sql_with("v_judged", f"""
SELECT run_id, ord, file, line, severity, is_real, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id
    ORDER BY coalesce(severity, 0) DESC, coalesce(is_real, 0) DESC, ord) AS rank
  FROM ({reported_sql()})) WHERE rank <= 5"""))
def e4(spark, sf):
    return C.rank_and_cap(C.compose(V.judged(spark, sf)), RUN).select(
        "run_id", "ord", "file", "line", "severity", "is_real", "rank")


def verdict_sql(per_declaration: bool, t: str = "0.5e0", source: str = "v_judged", run: str = "run_id") -> str:
    majors = ("count(DISTINCT CASE WHEN lvl = 2 THEN coalesce(parent_declaration, file || ':' || line) END)"
              if per_declaration else "count(*) FILTER (WHERE lvl = 2)")
    rep = reported_sql(t).replace("v_judged", source)
    return f"""
WITH rep AS (SELECT *, {LEVEL} AS lvl FROM ({rep})),
counted AS (
  SELECT * FROM rep r WHERE lvl >= 2 AND NOT (rubric = 'deletion' AND NOT coalesce(references_remaining, FALSE)
    AND NOT EXISTS (SELECT 1 FROM rep c WHERE c.{run} = r.{run} AND c.rubric <> 'deletion'
      AND (c.lvl >= 2 OR (c.file = r.file AND c.category IS NOT NULL AND c.category <> 'style'))))),
totals AS (SELECT {run}, count(*) FILTER (WHERE lvl = 3) AS n_blockers, {majors} AS n_majors
  FROM counted GROUP BY {run})
SELECT r.{run}, coalesce(n_blockers, 0) AS n_blockers, coalesce(n_majors, 0) AS n_majors,
  CASE WHEN coalesce(n_blockers, 0) > 0 OR coalesce(n_majors, 0) >= 2 THEN 'Changes requested' ELSE 'Approved' END AS verdict
FROM (SELECT DISTINCT {run} FROM rep) r LEFT JOIN totals USING ({run})"""


@query("e5_measurement_verdict", V.sql_with("v_judged", verdict_sql(False)))
def e5(spark, sf):
    return C.measurement_verdict(C.compose(V.judged(spark, sf)), RUN)


@query("e6_declaration_majors", V.sql_with("v_judged", verdict_sql(True)))
def e6(spark, sf):
    return C.measurement_verdict(C.compose(V.judged(spark, sf)), RUN, per_declaration=True)


@query("e7_skip_rollup", V.sql_with("v_skipped", """
SELECT run_id, file, reason, n, CAST(pos AS INTEGER) AS pos, greatest(n_all - 3, 0) AS n_more FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY f) AS pos, count(*) OVER (PARTITION BY run_id) AS n_all
  FROM (SELECT run_id, file, reason, count(*) AS n, min(ord) AS f FROM v_skipped
        WHERE reason <> 'max-hunks>ceiling' GROUP BY run_id, file, reason)) WHERE pos <= 3"""))
def e7(spark, sf):
    return C.skip_rollup(V.skipped(spark, sf), RUN, top=3)


@query("e7_ceiling_skips", V.sql_with("v_skipped", """
SELECT run_id, file, count(*) AS n FROM v_skipped WHERE reason = 'max-hunks>ceiling' GROUP BY run_id, file"""))
def e7b(spark, sf):
    return C.ceiling_skips(V.skipped(spark, sf), RUN)


@query("e8_size_skipped_code", V.sql_with("v_skipped", """
SELECT run_id, ord, file, reason FROM v_skipped
WHERE reason LIKE 'hunk>%' AND change_type NOT IN ('deletion-only', 'whole-file-deleted')"""))
def e8(spark, sf):
    return C.size_skipped_code(V.skipped(spark, sf)).select("run_id", "ord", "file", "reason")


