"""Registered queries: readers, writers and line formats over derived lines."""

from pyspark.sql import functions as F

from judgelake.plans import views as V
from judgelake.plans.registry import query
from judgelake.session import scratch_path
from judgelake.sources import changes as CH
from judgelake.sources import corpus as CO
from judgelake.sources import ledger as L
from judgelake.sources import lines as LN




def ledger_records(spark, sf):
    """Nested run records of the judged view."""
    j = V.judged(spark, sf)
    fields = ["ord", "file", "line", "line_start", "line_end", "severity", "is_real", "category", "confidence", "rubric",
              "references_remaining", "change_type", "enrichment", "reflex_class", "parent_declaration"]
    nested = j.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("u"))
    return (V.runs(spark, sf).join(nested, "run_id").withColumn("judged", F.transform("u", lambda u: u.dropFields("ord")))
            .select("label", "repo", "n_analyzed", "fail_open", "total_latency_ms", "judged", "provider", "ts",
                    F.lit("0").alias("n_dropped")))


@query("a1_read_ledger", V.sql_with("v_judged v_runs", """
SELECT r.label, CAST(row_number() OVER (PARTITION BY j.run_id ORDER BY j.ord) - 1 AS INTEGER) AS ord, file, line, line_end, severity, is_real,
  category, references_remaining, r.fail_open, r.total_latency_ms FROM v_judged j JOIN v_runs r USING (run_id)"""))
def a1(spark, sf):
    path = scratch_path(spark, "ledger")
    ledger_records(spark, sf).write.json(path)
    runs = L.read_ledger(spark, path)
    return L.explode_judged(runs, "label", "fail_open", "total_latency_ms").select(
        "label", "ord", "file", "line", "line_end", "severity", "is_real", "category", "references_remaining", "fail_open", "total_latency_ms")


def _jsonl_lines(spark, sf):
    e = F.col("event_id")
    value = (F.when(e % 50 == 0, F.concat(F.lit("# "), "props")).when(e % 51 == 0, "   ").when(e % 77 == 0, "{bad")
             .otherwise(F.col("props")))
    return V.table(spark, sf, "events").select(F.col("event_type").alias("path"), F.lit(0).cast("bigint").alias("block"), e.alias("seq"), value.alias("value"))


@query("a2_read_jsonl", "SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, count(*) AS n FROM events "
       "WHERE event_id % 50 <> 0 AND event_id % 51 <> 0 AND event_id % 77 <> 0 GROUP BY k")
def a2(spark, sf):
    return LN.parse_jsonl(_jsonl_lines(spark, sf), "k int")[0].groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("a2_jsonl_rejects", "SELECT event_type AS path, count(*) AS n FROM events WHERE event_id % 50 <> 0 AND event_id % 51 <> 0 AND event_id % 77 = 0 GROUP BY path")
def a2_rejects(spark, sf):
    return LN.parse_jsonl(_jsonl_lines(spark, sf), "k int")[1].groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("a3_read_meta", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents")
def a3(spark, sf):
    d = V.table(spark, sf, "documents")
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('# {"lang": "'), "lang", F.lit('"}'))).otherwise("#no meta")
    text = F.concat(F.lit("\n"), head, F.lit("\n"), "text")
    lines = d.select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("block"), F.posexplode(F.split(text, "\n")).alias("seq", "value"))
    return LN.parse_meta(lines).select("path", F.try_element_at("meta", F.lit("lang")).alias("lang"))


TSV_COLS = ["orderkey", "linenumber", "returnflag", "quote"]


def _tsv_lines(spark, sf):
    k = F.col("l_orderkey")
    full = F.concat_ws("\t", k.cast("string"), F.col("l_linenumber").cast("string"), "l_returnflag", F.lit('say "x"'))
    value = (F.when(k % 41 == 0, "").when(k % 43 == 0, F.concat(F.lit("# "), full)).when(k % 47 == 0, "\t".join(TSV_COLS))
             .when(k % 53 == 0, F.concat(full, F.lit("\textra"))).otherwise(full))
    return V.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("path"), (k * 10 + F.col("l_linenumber")).alias("line_no"), value.alias("value"))


TSV_KEEP = "l_orderkey % 41 <> 0 AND l_orderkey % 43 <> 0 AND l_orderkey % 47 <> 0"


@query("a4_read_tsv", f"""SELECT l_linestatus AS path, l_orderkey * 10 + l_linenumber AS line_no, CAST(l_orderkey AS VARCHAR) AS orderkey,
  CAST(l_linenumber AS VARCHAR) AS linenumber, l_returnflag AS returnflag, 'say "x"' AS quote FROM lineitem WHERE {TSV_KEEP} AND l_orderkey % 53 <> 0""")
def a4(spark, sf):
    return LN.parse_tsv(_tsv_lines(spark, sf), TSV_COLS)[0]


@query("a4_tsv_rejects", f"SELECT l_linestatus AS path, l_orderkey * 10 + l_linenumber AS line_no, 'expected 4 columns, got 5' AS error FROM lineitem WHERE {TSV_KEEP} AND l_orderkey % 53 = 0")
def a4_rejects(spark, sf):
    return LN.parse_tsv(_tsv_lines(spark, sf), TSV_COLS)[1]


@query("a5_write_tsv", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def a5(spark, sf):
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    path = scratch_path(spark, "orders-tsv")
    LN.write_tsv(V.table(spark, sf, "orders").select(*cols), path, cols, "written by a query\nsecond comment")
    return LN.read_tsv(spark, path, cols)


@query("a5_line_numbers", "SELECT CAST(o_orderkey AS VARCHAR) AS value, row_number() OVER (ORDER BY o_orderkey) AS line_no FROM orders")
def a5_numbers(spark, sf):
    path = scratch_path(spark, "numbered")
    V.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("value")).coalesce(1).sortWithinPartitions(
        F.col("value").cast("bigint")).write.text(path)
    return LN.number_lines(LN.read_lines(spark, path)).select("value", F.col("line_no").cast("bigint").alias("line_no"))


@query("a6_write_jsonl", """SELECT '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}' AS value FROM customer""")
def a6(spark, sf):
    path = scratch_path(spark, "customers-jsonl")
    LN.write_jsonl(V.table(spark, sf, "customer").select("c_name", "c_custkey", "c_mktsegment"), path, '{"seed": 42}')
    return LN.read_lines(spark, path).filter(~F.col("value").startswith("# ")).select("value")


def _golden_lines(spark, sf):
    """Two-cell and three-cell golden lines, comments, short and damaged rows."""
    k = F.col("ord")
    full = F.concat_ws("\t", F.col("file"), F.col("line").cast("string"))
    value = (F.when(k % 23 == 0, F.concat(F.lit("  # "), full)).when(k % 19 == 0, F.col("file")).when(k % 17 == 0, F.concat(F.col("file"), F.lit("\tx1")))
             .when(k % 3 == 0, F.concat(full, F.lit("\tfalls over\tmore"))).otherwise(F.concat(F.lit("  "), full, F.lit("  "))))
    return V.judged(spark, sf).select(F.col("run_id").alias("path"), k.alias("line_no"), value.alias("value"))


@query("a7_read_golden", V.sql_with("v_judged", """
SELECT run_id AS path, ord AS golden_idx, file, line, CASE WHEN ord % 3 = 0 THEN 'falls over' ELSE '' END AS description FROM v_judged
WHERE ord % 23 <> 0 AND ord % 19 <> 0 AND ord % 17 <> 0"""))
def a7(spark, sf):
    return LN.parse_golden(_golden_lines(spark, sf))[0]


@query("a8_strict_golden_rejects", V.sql_with("v_judged", """
SELECT run_id AS path, ord AS line_no, 'expected file and line' AS error FROM v_judged WHERE ord % 23 <> 0 AND (ord % 19 = 0 OR ord % 17 = 0)"""))
def a8(spark, sf):
    return LN.parse_golden_strict(_golden_lines(spark, sf))[1]


@query("a9_negative_golden", V.sql_with("v_paths", """
SELECT DISTINCT path AS file FROM v_paths WHERE page_id % 5 <> 0 AND lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs')"""))
def a9(spark, sf):
    p = V.paths(spark, sf)
    sub = F.when(F.col("page_id") % 5 == 0, "GONE").otherwise("const x")
    return LN.parse_negative_golden(p.select(F.concat_ws("\t", "path", sub).alias("value")), expect="ts-ast")


def _sha_lines(spark, sf):
    k = F.col("c_custkey")
    sha = F.substring(F.sha2(F.col("c_name"), 256), 1, 40)
    value = (F.when(k % 31 == 0, F.concat(F.lit("# "), "c_name")).when(k % 37 == 1, F.col("c_name"))
             .when(k % 41 == 2, F.concat(F.col("c_name"), F.lit("=abc"))).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ="), sha)))
    return V.table(spark, sf, "customer").select(F.lit("shas").alias("path"), k.alias("line_no"), value.alias("value"))


@query("a10_sha_map", """SELECT c_name AS name, sha256(c_name)[1:40] AS sha FROM customer WHERE c_custkey % 31 <> 0 AND c_custkey % 37 <> 1 AND c_custkey % 41 <> 2""")
def a10(spark, sf):
    return LN.parse_sha_map(_sha_lines(spark, sf), required=["Customer#000000003"])[0]


@query("a10_sha_map_rejects", """SELECT 'shas' AS path, c_custkey AS line_no, CASE WHEN c_custkey % 37 = 1 THEN 'expected name=sha' ELSE 'sha is not 40 characters' END AS error
  FROM customer WHERE c_custkey % 31 <> 0 AND (c_custkey % 37 = 1 OR c_custkey % 41 = 2)
  UNION ALL SELECT '', NULL, 'missing positive'""")
def a10_rejects(spark, sf):
    return LN.parse_sha_map(_sha_lines(spark, sf), required=["Customer#000000003", "positive"])[1]


def _field_lines(spark, sf):
    k = F.col("c_custkey")
    pr = F.when(k % 29 == 0, F.concat(F.lit("p"), k.cast("string"))).when(k % 50 == 7, (k - 1).cast("string")).otherwise(k.cast("string"))
    sha = F.substring(F.sha2(F.when(k % 60 == 8, F.lit("same")).otherwise(F.col("c_name")), 256), 1, 40)
    want = F.when(k % 43 == 3, "2").when(k % 47 == 4, "many").otherwise("0")
    return V.table(spark, sf, "customer").select(F.lit("field").alias("path"), k.alias("line_no"), F.concat_ws("\t", pr, sha, want).alias("value"))


FIELD = """
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 29 = 0 THEN 'p' || c_custkey WHEN c_custkey % 50 = 7 THEN '' || (c_custkey - 1) ELSE '' || c_custkey END AS pr,
  sha256(CASE WHEN c_custkey % 60 = 8 THEN 'same' ELSE c_name END)[1:40] AS sha FROM customer),
g AS (SELECT k, CAST(pr AS INTEGER) AS pr, sha FROM c WHERE k % 29 <> 0 AND k % 43 <> 3 AND k % 47 <> 4)"""


@query("a11_field_golden", FIELD + " SELECT 'field' AS path, k AS line_no, pr, sha FROM g")
def a11(spark, sf):
    return LN.parse_field_golden(_field_lines(spark, sf))[0]


@query("a11_field_golden_rejects", FIELD + """
SELECT 'field' AS path, k AS line_no, CASE WHEN k % 29 = 0 THEN 'bad pr or sha' WHEN k % 43 = 3 THEN 'nonzero expectation' ELSE 'expected is not a number' END AS error
  FROM c WHERE k % 29 = 0 OR k % 43 = 3 OR k % 47 = 4
UNION ALL SELECT 'field', max(k), 'duplicate pr' FROM g GROUP BY pr HAVING count(*) > 1
UNION ALL SELECT 'field', max(k), 'duplicate sha' FROM g GROUP BY sha HAVING count(*) > 1""")
def a11_rejects(spark, sf):
    return LN.parse_field_golden(_field_lines(spark, sf))[1]


@query("a12_change_documents", """
SELECT doc_id, source AS head, CASE WHEN doc_id % 3 = 0 THEN 'input' ELSE lang END AS repo, CAST(f AS INTEGER) AS file_idx, 'src/f' || f || '.py' AS path,
  CASE WHEN f = 0 OR doc_id % 5 <> 0 THEN text END AS before, CASE WHEN f = 0 THEN text || chr(10) || 'tail' ELSE lang END AS after
FROM documents, (SELECT unnest([0, 1]) AS f) WHERE doc_id % 7 <> 0""")
def a12(spark, sf):
    d, k = V.table(spark, sf, "documents"), F.col("doc_id")
    old = F.lit(None).cast("string")
    files = F.array(
        F.struct(F.lit("src/f0.py").alias("path"), old.alias("old_path"), F.col("text").alias("before"), F.concat("text", F.lit("\ntail")).alias("after")),
        F.struct(F.lit("src/f1.py").alias("path"), old.alias("old_path"), F.when(k % 5 != 0, F.col("text")).alias("before"), F.col("lang").alias("after")))
    text = F.to_json(F.struct(F.col("source").alias("head"), F.when(k % 3 != 0, F.col("lang")).alias("repo"), files.alias("files")))
    docs = CH.parse_documents(d.select("doc_id", F.when(k % 7 == 0, F.concat(F.lit("["), text)).otherwise(text).alias("value")))
    return CH.explode_files(docs.filter("not damaged")).select("doc_id", "head", "repo", "file_idx", "path", "before", "after")


@query("a14_report_skips", V.sql_with("v_skipped v_runs", """
SELECT label, file, reason, line_start FROM v_skipped s JOIN v_runs r USING (run_id) WHERE NOT r.fail_open"""))
def a14(spark, sf):
    runs = V.runs(spark, sf)
    rep = (V.skipped(spark, sf).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("ord", "file", "reason", "line_start"))).alias("s"))
           .join(runs.select("run_id", "label"), "run_id").select("label", F.transform("s", lambda x: x.dropFields("ord")).alias("skipped")))
    return L.report_skips(rep, runs.filter("not fail_open")).select("label", "file", "reason", "line_start")


@query("a15_overlay_duplicates", V.sql_with("v_samples", "SELECT sample_id, count(*) AS n FROM (SELECT sample_id FROM v_samples UNION ALL SELECT sample_id FROM v_samples WHERE repo = 'acme/repo1') GROUP BY sample_id HAVING count(*) > 1"))
def a15(spark, sf):
    s = V.samples(spark, sf)
    return CO.duplicate_samples(CO.overlay(s, s.filter("repo = 'acme/repo1'")))


@query("a17_spot_check_sheet", """
SELECT CAST(conv_id AS VARCHAR) || ':' || turn AS candidate_id, 'random' AS why, '[thread](u)' AS thread, '[code](c)' AS code, role AS disposition, 'style' AS label,
  'minor' AS severity, regexp_replace(regexp_replace(replace(replace(replace(text, '|', '\\|'), chr(10), ' '), chr(9), ' '), '^ +', ''), ' +$', '') AS evidence,
  'agree' AS verdict, '' AS correct_label, '' AS note FROM conversations""")
def a17(spark, sf):
    c = V.table(spark, sf, "conversations")
    rows = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("candidate_id"), F.lit("random").alias("why"),
                    F.lit("[thread](u)").alias("thread"), F.lit("[code](c)").alias("code"), F.col("role").alias("disposition"), F.lit("style").alias("label"),
                    F.lit("minor").alias("severity"), F.col("text").alias("evidence"), F.lit("agree").alias("verdict"), F.lit("").alias("correct_label"), F.lit("").alias("note"))
    return CO.parse_sheet(CO.encode_sheet(rows))[0]


@query("a18_append_ledger", V.sql_with("v_runs", "SELECT label, strftime(ts, '%f') AS micros, count(*) AS n FROM (SELECT * FROM v_runs UNION ALL SELECT * FROM v_runs WHERE fail_open) GROUP BY ALL"))
def a18(spark, sf):
    path = scratch_path(spark, "appended")
    r = V.runs(spark, sf).select("label", "repo", "fail_open", "n_analyzed", "ts")
    L.append_ledger(r, path, stamp=False)
    L.append_ledger(r.filter("fail_open"), path, stamp=False)
    back = L.read_ledger(spark, path)
    return back.groupBy("label", F.date_format("ts", "SSSSSS").alias("micros")).agg(F.count(F.lit(1)).alias("n"))


@query("a19_latest_by_label", "SELECT label, event_id, value FROM (SELECT 'u' || user_id || ':' || event_type AS label, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def a19(spark, sf):
    e = V.table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("label"), "event_id", "value", "ts")
    return L.latest_by_label(e, ("ts", "event_id")).select("label", "event_id", "value")


@query("a20_select", V.sql_with("v_runs", "SELECT label, 'all' AS split FROM v_runs WHERE label LIKE 'corpus:v08:acme/repo1%' UNION ALL SELECT label, 'positive' FROM v_runs WHERE kind = 'positive' AND label LIKE 'corpus:v08:acme/repo1%'"))
def a20(spark, sf):
    r = L.select_prefix(V.runs(spark, sf).withColumn("split", F.col("kind")), "corpus:v08:acme/repo1")
    return L.select_split(r, "all").select("label", F.lit("all").alias("split")).unionByName(L.select_split(r, "positive").select("label", "split"))


@query("a21_adjudications", V.sql_with("v_judged", """
SELECT run_id AS run_label, CASE WHEN repeat % 2 = 0 THEN 'on' ELSE 'off' END AS arm, file, line_start, line_end, enrichment AS unit_stamp, is_real,
  CASE ord % 4 WHEN 0 THEN 'REAL' WHEN 1 THEN 'FP' ELSE 'DUP' END AS verdict FROM v_judged WHERE ord % 4 <> 3"""))
def a21(spark, sf):
    j, k = V.judged(spark, sf), F.col("ord") % 4
    verdict = F.when(k == 0, "REAL").when(k == 1, "FP").when(k == 2, "DUP").otherwise("MAYBE")
    cells = [F.col("run_id"), F.when(F.col("repeat") % 2 == 0, "on").otherwise("off"), F.col("file"), F.col("line_start").cast("string"),
             F.col("line_end").cast("string"), F.col("enrichment"), F.coalesce(F.col("is_real").cast("string"), F.lit("")), verdict, F.lit("kim"), F.lit("")]
    lines = j.select(F.lit("adj").alias("path"), F.col("ord").alias("line_no"), F.concat_ws("\t", *cells).alias("value"))
    return LN.parse_adjudications(lines)[0].select("run_label", "arm", "file", "line_start", "line_end", "unit_stamp", "is_real", "verdict")


@query("a21_adjudication_rejects", V.sql_with("v_judged", "SELECT 'adj' AS path, ord AS line_no, 'bad verdict MAYBE' AS error FROM v_judged WHERE ord % 4 = 3"))
def a21_rejects(spark, sf):
    j = V.judged(spark, sf)
    cells = [F.col("run_id"), F.lit("on"), F.col("file"), F.col("line_start").cast("string"), F.col("line_end").cast("string"), F.col("enrichment"),
             F.lit("0.5"), F.when(F.col("ord") % 4 == 3, "MAYBE").otherwise("REAL"), F.lit("kim"), F.lit("")]
    lines = j.select(F.lit("adj").alias("path"), F.col("ord").alias("line_no"), F.concat_ws("\t", *cells).alias("value"))
    return LN.parse_adjudications(lines)[1]


