"""Registered queries: one per scalar rule, over whole tables."""

from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions import paths as P
from judgelake.functions import scores as S
from judgelake.functions import texts as X
from judgelake.plans import views as V
from judgelake.plans.queries_compose import LEVEL
from judgelake.plans.registry import query


def _docs(spark, sf):
    return V.table(spark, sf, "documents")


@query("b1_sev_level", V.sql_with("v_judged", f"SELECT ord, {LEVEL} AS level FROM v_judged"))
def b1(spark, sf):
    return V.judged(spark, sf).select("ord", S.sev_level(F.col("severity")).alias("level"))


@query("b2_sev_name", V.sql_with("v_judged", f"SELECT name, count(*) AS n FROM (SELECT ['none', 'MINOR', 'MAJOR', 'BLOCKER'][{LEVEL} + 1] AS name FROM v_judged) GROUP BY name"))
def b2(spark, sf):
    return V.judged(spark, sf).groupBy(S.sev_name(F.col("severity")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("b3_near", V.sql_with("v_judged", "SELECT ord, coalesce(abs(is_real - 0.5e0) <= 0.03e0, FALSE) AS near_gate FROM v_judged"))
def b3(spark, sf):
    return V.judged(spark, sf).select("ord", S.near(F.col("is_real"), F.lit(0.5)).alias("near_gate"))


@query("b4_path_triage", V.sql_with("v_paths", """
SELECT page_id, path, CASE WHEN page_id % 16 IN (0, 1, 4, 7, 12) THEN 'docs/generated/lockfile' WHEN page_id % 16 IN (3, 11) THEN 'data/snapshot' END AS reason FROM v_paths"""))
def b4(spark, sf):
    return V.paths(spark, sf).select("page_id", "path", P.path_triage_reason(F.col("path")).alias("reason"))


@query("b5_reflex_class", V.sql_with("v_paths", """
SELECT page_id, path, CASE WHEN page_id % 16 IN (2, 5, 8, 9, 10, 13) THEN 'test' ELSE 'code' END AS class FROM v_paths"""))
def b5(spark, sf):
    return V.paths(spark, sf).select("page_id", "path", P.reflex_class(F.col("path")).alias("class"))


@query("b6_input_status", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' WHEN 3 THEN 'modified' END AS status FROM documents""")
def b6(spark, sf):
    k = F.col("doc_id") % 6
    before = F.when(k.isin(1, 2, 3, 4), F.col("text"))
    after = F.when(k.isin(0, 2, 4), F.col("text")).when(k == 3, F.concat("text", F.lit("x")))
    old = F.when(k.isin(0, 1, 2), "old.py").when(k == 4, "new.py")
    return _docs(spark, sf).select("doc_id", X.input_status(before, after, F.lit("new.py"), old).alias("status"))


@query("b7_path_error", """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'must not be empty' WHEN 2 THEN 'path contains a control character'
  WHEN 3 THEN 'path must not be /dev/null' WHEN 4 THEN CASE WHEN length(replace(text, chr(10), ' ')) + 4 > 1024 THEN 'longer than 1024 characters' END END AS error FROM documents""")
def b7(spark, sf):
    k, flat = F.col("doc_id") % 7, F.translate("text", "\n", " ")
    p = (F.when(k == 0, None).when(k == 1, "").when(k == 2, F.concat(F.lit("a "), F.substring_index("text", " ", 1)))
         .when(k == 3, "\\dev\\null").when(k == 4, F.concat(F.lit("src/"), flat)).otherwise(F.concat("source", F.lit("/x.py"))))
    return _docs(spark, sf).select("doc_id", P.path_error(p).alias("error"))


@query("b8_label_error", """
SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN 'longer than 200 characters' WHEN contains(text, chr(10)) THEN 'contains a control character'
  WHEN text = '' THEN 'must not be empty' END AS error FROM conversations""")
def b8(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", "turn", P.label_error(F.col("text")).alias("error"))


@query("b9_head_is_sha", "SELECT c_custkey, c_custkey % 3 <> 1 AND c_custkey % 3 <> 2 AS is_sha FROM customer")
def b9(spark, sf):
    k = F.col("c_custkey") % 3
    sha = F.sha2("c_name", 256)
    head = F.when(k == 0, F.substring(sha, 1, 40)).when(k == 1, F.substring(sha, 1, 41)).otherwise(F.upper(F.concat(F.lit("A"), F.substring(sha, 1, 39))))
    return V.table(spark, sf, "customer").select("c_custkey", P.head_is_sha(head).alias("is_sha"))


LINES = "CASE WHEN text LIKE '%' || chr(10) THEN len(string_split(text, chr(10))) - 1 WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END"


@query("b10_oversize_binary", f"""
SELECT doc_id, length(text) > 5000 OR {LINES} > 30 OR len(list_filter(string_split(text, chr(10)), lambda l: length(l) > 700)) > 0 AS oversize,
  doc_id % 9 = 0 AS bin FROM documents""")
def b10(spark, sf):
    t = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("\x00"))).otherwise(F.col("text"))
    return _docs(spark, sf).select("doc_id", X.is_oversize(F.col("text"), 5000, 30, 700).alias("oversize"), X.is_binary(t).alias("bin"))


@query("b11_split_lines", f"SELECT doc_id, CAST({LINES} AS INTEGER) AS n_lines, text <> '' AND text NOT LIKE '%' || chr(10) AS no_newline FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || chr(10) ELSE text END AS text FROM documents)")
def b11(spark, sf):
    t = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(X.split_lines(t)).alias("n_lines"), X.lacks_final_newline(t).alias("no_newline"))


@query("b12_sample_id", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 9 THEN 'acme/r.' || (o_custkey % 7) END AS repo, CASE WHEN o_orderkey % 10 <> 9 THEN CAST(o_orderkey AS INTEGER) END AS pr,
  CASE WHEN o_orderkey % 10 <> 9 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'pre' ELSE 'final' END END AS phase FROM orders""")
def b12(spark, sf):
    k = F.col("o_orderkey")
    sid = X.sample_id(F.concat(F.lit("acme/r."), (F.col("o_custkey") % 7).cast("string")), k,
                      F.when(k % 10 == 9, "draft").when(k % 2 == 0, "pre").otherwise("final"))
    return V.table(spark, sf, "orders").select("o_orderkey", X.parse_sample_id(sid).alias("p")).select("o_orderkey", "p.repo", "p.pr", "p.phase")


SPLIT_SQL = """CASE WHEN (6 * (CAST(('0x' || h[1:16])::UBIGINT % 10 AS INTEGER) + CAST(('0x' || h[17:32])::UBIGINT % 10 AS INTEGER) + CAST(('0x' || h[33:48])::UBIGINT % 10 AS INTEGER))
  + CAST(('0x' || h[49:64])::UBIGINT % 10 AS INTEGER)) % 10 < 3 THEN 'holdout' ELSE 'train' END"""


@query("b13_split_for", f"SELECT o_orderkey, {SPLIT_SQL} AS split FROM (SELECT o_orderkey, sha256('acme/r' || (o_custkey % 7) || '#' || o_orderkey) AS h FROM orders)")
def b13(spark, sf):
    repo = F.concat(F.lit("acme/r"), (F.col("o_custkey") % 7).cast("string"))
    return V.table(spark, sf, "orders").select("o_orderkey", X.split_for(repo, F.col("o_orderkey")).alias("split"))


@query("b14_is_disagreement", """
SELECT disposition, label, count(*) AS n FROM (SELECT ['fixed', 'not-applied', 'unaddressed', 'unknown'][l_orderkey % 4 + 1] AS disposition,
  ['real-bug', 'style', 'false-positive'][l_partkey % 3 + 1] AS label FROM lineitem)
WHERE (disposition = 'fixed' AND label = 'false-positive') OR (disposition IN ('not-applied', 'unaddressed') AND label = 'real-bug') GROUP BY ALL""")
def b14(spark, sf):
    d = V._pick(["fixed", "not-applied", "unaddressed", "unknown"], F.col("l_orderkey") % 4)
    lab = V._pick(["real-bug", "style", "false-positive"], F.col("l_partkey") % 3)
    return (V.table(spark, sf, "lineitem").select(d.alias("disposition"), lab.alias("label"))
            .filter(S.is_disagreement(F.col("disposition"), F.col("label"))).groupBy("disposition", "label").agg(F.count(F.lit(1)).alias("n")))


def follow_ups(spark, sf):
    """Every turn as a follow-up comment: one bullet a line, statuses by line length."""
    c = V.table(spark, sf, "conversations")
    bullets = F.transform(F.split("text", "\n"), lambda ln, i: F.concat(
        F.when(i % 3 == 0, "- **Fixed in abc** ").when(i % 3 == 1, "- **Not applied** ").otherwise("- **Later** "), F.lit("src/m"), i.cast("string"), F.lit(".py: "), ln))
    head = F.when(F.col("turn") % 4 == 3, "Thanks\n").otherwise("  \n" + K.FOLLOW_UP_HEADER + "\n")
    return c.select("conv_id", "turn", F.concat(head, F.array_join(bullets, "\n")).alias("body"))


@query("b15_follow_up_bullets", """
SELECT conv_id, turn, CASE WHEN (i - 1) % 3 = 0 THEN 'fixed' ELSE 'not-applied' END AS status, CASE WHEN (i - 1) % 3 = 0 THEN '- **Fixed in abc** ' ELSE '- **Not applied** ' END || 'src/m' || (i - 1) || '.py: ' || ln AS bullet
FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations WHERE turn % 4 <> 3)
WHERE (i - 1) % 3 <> 2""")
def b15(spark, sf):
    return follow_ups(spark, sf).select("conv_id", "turn", F.inline(X.follow_up_bullets(F.col("body"))))


def _zero_context_diff():
    """Two hunks: at linenumber*10 with a count, and at linenumber*100 without one."""
    a, q = F.col("l_linenumber") * 10, F.col("l_quantity").cast("int") % 5
    return F.concat(F.lit("diff --git a/x b/x\n@@ -"), a.cast("string"), F.lit(","), q.cast("string"), F.lit(" +1,2 @@\n-a\n@@ -"),
                    (a * 10).cast("string"), F.lit(" +9 @@ def f\n+b\n"))


@query("b17_old_side_touches", """
SELECT l_orderkey, l_linenumber, l_partkey, l BETWEEN a - 2 AND a + greatest(q, 1) + 1 OR l BETWEEN a * 10 - 2 AND a * 10 + 2 AS touches
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber * 10 AS a, CAST(l_quantity AS INTEGER) % 5 AS q, l_partkey % 80 AS l FROM lineitem)""")
def b17(spark, sf):
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.old_side_touches(
        _zero_context_diff(), F.col("l_partkey") % 80).alias("touches"))


@query("b18_path_parts", V.sql_with("v_paths", """
SELECT page_id, lower(regexp_extract(base, '.\\.([^.]*)$', 1)) AS ext, base, CASE WHEN contains(path, '/') THEN path[1:length(path) - length(base) - 1] ELSE '' END AS dir
FROM (SELECT page_id, path, regexp_extract(path, '[^/]*$', 0) AS base FROM v_paths)"""))
def b18(spark, sf):
    p = F.col("path")
    return V.paths(spark, sf).select("page_id", P.extension(p).alias("ext"), P.basename(p).alias("base"), P.dirname(p).alias("dir"))


@query("b19_triple_dot", """
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_name || '...HEAD' WHEN 1 THEN 'HEAD...' || c_name WHEN 2 THEN c_name || '...' || c_mktsegment
  WHEN 3 THEN c_name || '...x' WHEN 4 THEN c_name ELSE 'a..' || c_name || '..b' END AS r FROM customer""")
def b19(spark, sf):
    k, n = F.col("c_custkey") % 6, F.col("c_name")
    rng = (F.when(k == 0, F.concat(n, F.lit(".."))).when(k == 1, F.concat(F.lit(".."), n)).when(k == 2, F.concat(n, F.lit(".."), "c_mktsegment"))
           .when(k == 3, F.concat(n, F.lit("...x"))).when(k == 4, n).otherwise(F.concat(F.lit("a.."), n, F.lit("..b"))))
    return V.table(spark, sf, "customer").select("c_custkey", P.triple_dot(rng).alias("r"))


@query("b20_escape_cell", "SELECT doc_id, replace(replace(replace(text || '|' || lang, chr(10), ' '), chr(9), ' '), '|', '\\|') AS cell FROM documents")
def b20(spark, sf):
    return _docs(spark, sf).select("doc_id", X.escape_cell(F.concat("text", F.lit("|"), "lang")).alias("cell"))


@query("b21_estimate_tokens", "SELECT doc_id, round((length(text) + 900) / 3e0, 6) AS tokens FROM documents")
def b21(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(X.estimate_tokens(F.col("text"), F.lit(900)), 6).alias("tokens"))


@query("b22_over_hard_cap", "SELECT doc_id, (length(text) + 150000) / 3e0 > 56000 AS over FROM documents")
def b22(spark, sf):
    return _docs(spark, sf).select("doc_id", X.over_hard_cap(F.col("text"), F.lit(150000)).alias("over"))


@query("b23_unit_key", V.sql_with("v_judged", "SELECT ord, file || ':' || line || ':' || CASE WHEN ord % 8 = 0 THEN 'None' ELSE '' || line_end END AS key FROM v_judged"))
def b23(spark, sf):
    end = F.when(F.col("ord") % 8 != 0, F.col("line_end"))
    return V.judged(spark, sf).select("ord", X.unit_key(F.col("file"), F.col("line"), end).alias("key"))


@query("b24_run_labels", V.sql_with("v_runs", """
SELECT run_id, 'corpus' AS kind, 'v08' AS "group", regexp_extract(label, 'v08:(.*):r', 1) AS sample, repeat FROM v_runs
UNION ALL SELECT run_id, 'exp:enrich', 'on', '' || sample_id, repeat FROM v_runs UNION ALL SELECT run_id, NULL, NULL, NULL, NULL FROM v_runs"""))
def b24(spark, sf):
    r = V.runs(spark, sf)
    made = X.arm_label(F.lit("on"), F.col("sample_id").cast("string"), F.col("repeat"))
    labels = r.select("run_id", F.explode(F.array("label", made, F.concat(F.lit("manual-"), "run_id"))).alias("l"))
    return labels.select("run_id", X.parse_label(F.col("l")).alias("p")).select("run_id", "p.*")


@query("b25_finite", "SELECT event_id, event_id % 5 NOT IN (0, 1, 2, 3) AS ok FROM events")
def b25(spark, sf):
    k = F.col("event_id") % 5
    v = F.when(k == 0, "NaN").when(k == 1, "Infinity").when(k == 2, "high").when(k == 3, None).otherwise(F.col("value").cast("string"))
    return V.table(spark, sf, "events").select("event_id", S.finite(v).alias("ok"))


@query("b26_over_budget_body", "SELECT page_id, page_id % 4 = 0 AS over FROM pages")
def b26(spark, sf):
    tag = F.when(F.col("page_id") % 4 == 0, '{"error_type": "MAX_TOKENS_Exceeded"}').otherwise("max_tokens must not exceed 5")
    return V.table(spark, sf, "pages").select("page_id", X.over_budget_body(F.concat("html", tag)).alias("over"))


@query("b28_truncate", "SELECT doc_id, text[1:4000] AS body, CASE WHEN length(text) <= 120 THEN text ELSE text[1:117] || '...' END AS short FROM documents")
def b28(spark, sf):
    return _docs(spark, sf).select("doc_id", X.truncate(F.col("text"), K.BODY_MAX).alias("body"), X.shorten(F.col("text")).alias("short"))


@query("b29_enrichment_stamp", V.sql_with("v_paths", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'none' WHEN page_id % 16 IN (2, 4, 6, 7, 13) THEN 'ts-ast' ELSE 'ast' END AS stamp FROM v_paths"""))
def b29(spark, sf):
    return V.paths(spark, sf).select("page_id", P.enrichment_stamp(F.col("path"), F.col("page_id") % 3 != 0).alias("stamp"))


@query("b30_declared_names", """
SELECT doc_id, CAST(count(DISTINCT n) AS INTEGER) AS n_names, min(n) AS first_name, max(n) AS last_name FROM (
  SELECT doc_id, n FROM (SELECT doc_id, unnest([CASE WHEN i % 4 = 0 AND length(w) >= 3 THEN w END, CASE WHEN i % 4 = 1 THEN w END, CASE WHEN i % 4 = 1 THEN 'pkg' || (i % 3) END,
      CASE WHEN i % 4 = 2 THEN 'os' END]) AS n
    FROM (SELECT doc_id, regexp_extract(ln, '[A-Za-z]+', 0) AS w, i - 1 AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
    WHERE w <> '') WHERE n IS NOT NULL) RIGHT JOIN documents USING (doc_id) GROUP BY doc_id""")
def b30(spark, sf):
    def code(ln, i):
        w = F.regexp_extract(ln, "[A-Za-z]+", 0)
        return F.when(w != "", F.when(i % 4 == 0, F.concat(F.lit("def "), w, F.lit("(x):")))
                      .when(i % 4 == 1, F.concat(F.lit("  from ..pkg"), (i % 3).cast("string"), F.lit(".a import "), w, F.lit(" as q")))
                      .when(i % 4 == 2, "import os.path").otherwise(F.concat(F.lit("x = 1 # "), w))).otherwise("")
    names = F.array_sort(X.declared_names(F.transform(F.split("text", "\n"), code)))
    return _docs(spark, sf).select("doc_id", F.size(names).alias("n_names"), F.array_min(names).alias("first_name"), F.array_max(names).alias("last_name"))


@query("b31_damaged_text", "SELECT doc_id, doc_id % 6 = 0 AS damaged FROM documents")
def b31(spark, sf):
    t = F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("�"))).otherwise(F.col("text"))
    return _docs(spark, sf).select("doc_id", X.is_damaged(t).alias("damaged"))
