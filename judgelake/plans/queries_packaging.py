"""Registered queries: diffs to clusters, triage, states, run stamps."""

from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.operators import packaging as P
from judgelake.plans import views as V
from judgelake.plans.registry import query
from judgelake.session import scratch_path
from judgelake.sources.changes import read_diff_hunks

# A document becomes the diff of one file: every line is kept, removed or added by
# a rule, hunks hold 30 lines and lie 10 lines apart.  Every ninth document is a
# whole-file deletion.  Line numbers of the check SQL come straight from the rule.
CODE_SQL = """
SELECT doc_id, source, i, h, CASE WHEN doc_id % 9 = 8 THEN '-' WHEN (doc_id * 7 + i * 3 + length(ln)) % 6 = 0 THEN '-'
    WHEN (doc_id * 7 + i * 3 + length(ln)) % 6 = 1 THEN '+' ELSE ' ' END AS kind,
  CASE WHEN i % 4 = 0 AND w <> '' THEN 'def ' || w || '(x): ' || ln ELSE ln END AS text,
  CASE doc_id % 10 WHEN 3 THEN 'tests/' || source || '/doc' || doc_id || '.py' WHEN 7 THEN 'docs/doc' || doc_id || '.md'
    ELSE 'src/' || source || '/doc' || doc_id || '.py' END AS file
FROM (SELECT doc_id, source, ln, i - 1 AS i, CASE WHEN doc_id % 9 = 8 THEN 0 ELSE (i - 1) // 30 END AS h, regexp_extract(ln, '[A-Za-z]+', 0) AS w
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
"""
ENTRIES_SQL = """
SELECT *, 1 + h * 10 + sum(CASE WHEN kind <> '+' THEN 1 ELSE 0 END) OVER before AS at_old,
  CASE WHEN doc_id % 9 = 8 THEN 0 ELSE 1 + h * 10 + sum(CASE WHEN kind <> '-' THEN 1 ELSE 0 END) OVER before END AS at_new
FROM (SELECT doc_id, source, i, h, kind, text, file FROM v_code)
WINDOW before AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""
PARSED_SQL = """
SELECT doc_id, file, doc_id % 9 = 8 AS file_deleted, CAST(h AS INTEGER) AS h, i, kind,
  CAST(CASE WHEN kind <> '-' THEN at_new END AS INTEGER) AS new_line, CAST(CASE WHEN kind <> '+' THEN at_old END AS INTEGER) AS old_line,
  CAST(CASE WHEN doc_id % 9 = 8 THEN 1 WHEN kind = '-' THEN greatest(1, least(at_new, hunk_end)) ELSE at_new END AS INTEGER) AS head_line, text,
  CAST(hunk_start AS INTEGER) AS hunk_start
FROM (SELECT *, CASE WHEN n_new = 0 AND doc_id % 9 <> 8 THEN hunk_start ELSE hunk_start + n_new - 1 END AS hunk_end FROM (
  SELECT *, first_value(at_new) OVER (PARTITION BY doc_id, h ORDER BY i) AS hunk_start,
    sum(CASE WHEN kind <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, h) AS n_new FROM (
    SELECT * REPLACE (coalesce(at_old, 1 + h * 10) AS at_old, coalesce(at_new, 1 + h * 10) AS at_new) FROM v_entries)))
"""
V.VIEWS_SQL["v_code"] = ((), CODE_SQL)
V.VIEWS_SQL["v_entries"] = (("v_code",), ENTRIES_SQL)
V.VIEWS_SQL["v_parsed"] = (("v_entries",), PARSED_SQL)


def code_lines(spark, sf):
    d, k = V.table(spark, sf, "documents"), F.col("doc_id")
    rows = d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "ln"))
    w, score = F.regexp_extract("ln", "[A-Za-z]+", 0), (k * 7 + F.col("i") * 3 + F.length("ln")) % 6
    plain = F.concat(F.lit("src/"), "source", F.lit("/doc"), k.cast("string"), F.lit(".py"))
    file = (F.when(k % 10 == 3, F.concat(F.lit("tests/"), "source", F.lit("/doc"), k.cast("string"), F.lit(".py")))
            .when(k % 10 == 7, F.concat(F.lit("docs/doc"), k.cast("string"), F.lit(".md"))).otherwise(plain))
    return rows.select(
        "doc_id", "source", "i", F.when(k % 9 == 8, 0).otherwise(F.floor(F.col("i") / 30)).cast("int").alias("h"),
        F.when(k % 9 == 8, "-").when(score == 0, "-").when(score == 1, "+").otherwise(" ").alias("kind"),
        F.when((F.col("i") % 4 == 0) & (w != ""), F.concat(F.lit("def "), w, F.lit("(x): "), "ln")).otherwise(F.col("ln")).alias("text"),
        file.alias("file"))


def diffs(spark, sf):
    """doc_id, source and the unified diff text of its file."""
    lines = code_lines(spark, sf)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "kind", "text"))),
                                    lambda e: F.concat(e["kind"], e["text"])), "\n")
    hunks = lines.groupBy("doc_id", "source", "file", "h").agg(
        body.alias("body"), F.count_if(F.col("kind") != "+").alias("n_old"), F.count_if(F.col("kind") != "-").alias("n_new"))
    ordered = hunks.groupBy("doc_id", "source", "file").agg(F.sort_array(F.collect_list(F.struct("h", "n_old", "n_new", "body"))).alias("hs"))

    def before(h, field):
        return F.aggregate(F.filter("hs", lambda x: x["h"] < h), F.lit(0).cast("bigint"), lambda a, x: a + x[field])

    gone = F.col("doc_id") % 9 == 8
    new_start = F.when(gone, F.lit(0).cast("bigint"))
    text = F.array_join(F.transform("hs", lambda h: F.concat(
        F.lit("@@ -"), (1 + h["h"] * 10 + before(h["h"], "n_old")).cast("string"), F.lit(","), h["n_old"].cast("string"), F.lit(" +"),
        F.coalesce(new_start, 1 + h["h"] * 10 + before(h["h"], "n_new")).cast("string"), F.lit(","), h["n_new"].cast("string"), F.lit(" @@\n"), h["body"])), "\n")
    head = F.concat(F.lit("diff --git a/"), "file", F.lit(" b/"), "file", F.lit("\n--- a/"), "file", F.lit("\n+++ "),
                    F.when(gone, "/dev/null").otherwise(F.concat(F.lit("b/"), "file")), F.lit("\n"))
    return ordered.select("doc_id", "source", F.concat(head, text, F.lit("\n")).alias("diff_text"))


def _changes(spark, sf):
    return diffs(spark, sf).select(F.col("doc_id").alias("change_id"), "diff_text")


def members(spark, sf):
    return P.cluster_members(P.parse_diff(_changes(spark, sf)))


def units(spark, sf):
    return P.clusters(members(spark, sf))


@query("c8_parse_diff", V.sql_with("v_parsed", "SELECT doc_id AS change_id, file, file_deleted, kind, new_line, old_line, head_line, text, hunk_start FROM v_parsed"))
def c8(spark, sf):
    return P.parse_diff(_changes(spark, sf)).drop("hunk_no", "pos", "old_at")


@query("a13_diff_files", V.sql_with("v_parsed", "SELECT file, kind, new_line, old_line, head_line, count(*) AS n FROM v_parsed GROUP BY ALL"))
def a13(spark, sf):
    path = scratch_path(spark, "diffs")
    diffs(spark, sf).repartition("source").select("source", F.regexp_replace("diff_text", "\n$", "").alias("value")).write.partitionBy("source").text(path)
    return P.parse_diff(read_diff_hunks(spark, path)).groupBy("file", "kind", "new_line", "old_line", "head_line").agg(F.count(F.lit(1)).alias("n"))


# Check SQL for clusters: an island of changed lines, joined to every line of its
# hunk at most four away with no foreign changed line in between.
CLUSTER_SQL = """
isl AS (SELECT doc_id, h, i, i - row_number() OVER (PARTITION BY doc_id, h ORDER BY i) AS g FROM v_parsed WHERE kind <> ' '),
runs AS (SELECT doc_id, h, g, min(i) AS lo, max(i) AS hi FROM isl GROUP BY doc_id, h, g),
win AS (SELECT r.doc_id, r.h, r.lo, r.hi, p.* EXCLUDE (doc_id, h), p.i BETWEEN r.lo AND r.hi AS own FROM runs r JOIN v_parsed p ON p.doc_id = r.doc_id AND p.h = r.h
  AND p.i BETWEEN r.lo - 4 AND r.hi + 4 WHERE p.i BETWEEN r.lo AND r.hi OR (p.kind = ' ' AND NOT EXISTS (SELECT 1 FROM v_parsed q
    WHERE q.doc_id = r.doc_id AND q.h = r.h AND q.kind <> ' ' AND (q.i BETWEEN p.i AND r.lo - 1 OR q.i BETWEEN r.hi + 1 AND p.i)))),
cl AS (SELECT doc_id AS change_id, file, h, lo, CAST(coalesce(arg_min(new_line, i) FILTER (WHERE own AND kind = '+'), arg_min(head_line, i) FILTER (WHERE own AND kind = '-')) AS INTEGER) AS line,
  min(head_line) AS line_start, max(head_line) AS line_end, CAST(count(*) FILTER (WHERE own) AS INTEGER) AS n_changed, CAST(count(*) AS INTEGER) AS size,
  CASE WHEN bool_or(own AND kind = '+') THEN 'code-change' WHEN bool_or(file_deleted) THEN 'whole-file-deleted' ELSE 'deletion-only' END AS change_type, any_value(hunk_start) AS hunk_start
  FROM win GROUP BY doc_id, file, h, lo)
"""


@query("c9_cluster_runs", V.sql_with("v_parsed", "WITH " + CLUSTER_SQL.strip() + " SELECT change_id, count(*) AS n_clusters, CAST(sum(n_changed) AS BIGINT) AS n_changed FROM cl GROUP BY change_id"))
def c9(spark, sf):
    return units(spark, sf).groupBy("change_id").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n_changed").alias("n_changed"))


@query("c10_cluster_members", V.sql_with("v_parsed", "WITH " + CLUSTER_SQL.strip() + " SELECT doc_id AS change_id, file, kind, own, head_line, text, CAST(i - lo AS BIGINT) AS rel FROM win"))
def c10(spark, sf):
    m = members(spark, sf)
    from pyspark.sql import Window
    lo = F.min(F.when(F.col("own"), F.col("pos"))).over(Window.partitionBy("change_id", "hunk_no", "run"))
    return m.select("change_id", "file", "kind", "own", "head_line", "text", (F.col("pos") - lo).cast("bigint").alias("rel"))


@query("c11_cluster_anchor", V.sql_with("v_parsed", "WITH " + CLUSTER_SQL.strip() + " SELECT change_id, file, line, n_changed, hunk_start FROM cl"))
def c11(spark, sf):
    return units(spark, sf).select("change_id", "file", "line", "n_changed", "hunk_start")


@query("c12_cluster_span", V.sql_with("v_parsed", "WITH " + CLUSTER_SQL.strip() + """ SELECT change_id, line, line_start, line_end, size, size > 120 AS too_large,
  '@@ ' || file || ' around line ' || line || ' (' || n_changed || ' changed lines) @@' AS header FROM cl"""))
def c12(spark, sf):
    return units(spark, sf).select("change_id", "line", "line_start", "line_end", "size", "too_large", "header")


@query("c13_change_type", V.sql_with("v_parsed", "WITH " + CLUSTER_SQL.strip() + " SELECT change_type, count(*) AS n, CAST(sum(line) AS BIGINT) AS anchors FROM cl GROUP BY change_type"))
def c13(spark, sf):
    return units(spark, sf).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("anchors"))


TRIAGE = "CASE WHEN file LIKE '%.md' THEN 'docs/generated/lockfile' WHEN {by_size} END"


@query("c14_triage", V.sql_with("v_parsed", "WITH " + CLUSTER_SQL.strip() + f"""
SELECT change_id, line, line_end, 'whole' AS provider, {TRIAGE.format(by_size="size > 12 THEN 'hunk>12 lines'")} AS reason FROM cl
UNION ALL SELECT change_id, line, line_end, 'split', {TRIAGE.format(by_size="size > 12 AND change_type = 'whole-file-deleted' THEN 'whole-file-deleted>cap'")} FROM cl"""))
def c14(spark, sf):
    u = units(spark, sf)
    both = [P.triage(u, split, 12).select("change_id", "line", "line_end", F.lit(name).alias("provider"), "reason") for name, split in (("whole", False), ("split", True))]
    return both[0].unionByName(both[1])


@query("c14_skip_records", V.sql_with("v_parsed", "WITH " + CLUSTER_SQL.strip() + """
SELECT change_id, file, reason, CASE WHEN reason LIKE '%>cap' THEN change_type END AS change_type, line_start, line_end FROM (
  SELECT *, CASE WHEN file LIKE '%.md' THEN 'docs/generated/lockfile' WHEN size > 12 AND change_type = 'whole-file-deleted' THEN 'whole-file-deleted>cap' END AS reason FROM cl)
WHERE reason IS NOT NULL"""))
def c14_skips(spark, sf):
    return P.skipped(P.triage(units(spark, sf), True, 12)).drop("ord")


@query("c20_references_remaining", V.sql_with("v_parsed", "WITH " + CLUSTER_SQL.strip() + """,
names AS (SELECT doc_id, h, lo, unnest(regexp_extract_all(text, '\\b(?:def|class|function|const|let|var)\\s+([A-Za-z_][\\p{L}\\p{N}_]*)', 1)) AS n FROM win WHERE kind = '-'),
corpus AS (SELECT doc_id, h, lo, string_agg(text, chr(10) ORDER BY i) FILTER (WHERE kind <> '-') AS c FROM win GROUP BY doc_id, h, lo)
SELECT change_id, line, n_changed, CASE WHEN change_type <> 'code-change' THEN
  EXISTS (SELECT 1 FROM names n JOIN corpus c USING (doc_id, h, lo) WHERE n.doc_id = change_id AND n.h = cl.h AND n.lo = cl.lo AND length(n) >= 3
    AND regexp_matches(c.c, '(^|[^\\p{L}\\p{N}_])' || n || '($|[^\\p{L}\\p{N}_])')) END AS refs FROM cl"""))
def c20(spark, sf):
    return P.unit_states(P.clusters(members(spark, sf), with_entries=True)).select("change_id", "line", "n_changed", F.col("references_remaining").alias("refs"))


@query("c21_unit_state", V.sql_with("v_parsed", "WITH " + CLUSTER_SQL.strip() + """,
sides AS (SELECT doc_id, h, lo, string_agg(text, chr(10) ORDER BY i) FILTER (WHERE kind <> '+') AS before, string_agg(text, chr(10) ORDER BY i) FILTER (WHERE kind <> '-') AS after FROM win GROUP BY doc_id, h, lo)
SELECT change_id, file, 'around line ' || line AS location, change_type, coalesce(before, '') AS before, coalesce(after, '') AS after
FROM cl JOIN sides ON change_id = doc_id AND cl.h = sides.h AND cl.lo = sides.lo"""))
def c21(spark, sf):
    u = P.clusters(members(spark, sf), with_entries=True)
    schema = "file string, location string, change_type string, code_before_change array<string>, code_after_change array<string>"
    s = P.unit_states(u).select("change_id", F.from_json("state", schema).alias("s"))
    return s.select("change_id", "s.file", "s.location", "s.change_type", F.array_join("s.code_before_change", "\n").alias("before"),
                    F.array_join("s.code_after_change", "\n").alias("after"))


@query("c25_run_ceiling", V.sql_with("v_judged", "SELECT run_id, ord, row_number() OVER (PARTITION BY run_id ORDER BY ord) <= 40 AS judged FROM v_judged"))
def c25(spark, sf):
    return P.ceiling(V.judged(spark, sf), 40, ["run_id"]).select("run_id", "ord", "judged")


CUT = "['hunk', 'line-window', 'ast-units', 'ts-units', 'sites', 'hunk_state-v1'][CASE WHEN repeat % 4 = 0 THEN ord % 2 ELSE ord % (1 + sample_id % 6) END + 1]"


def _cut_units(spark, sf):
    names = [*K.WIRE_FORMATS, "hunk_state-v1"]
    i = F.when(F.col("repeat") % 4 == 0, F.col("ord") % 2).otherwise(F.col("ord") % (1 + F.col("sample_id") % 6))
    return V.judged(spark, sf).withColumn("cut", V._pick(names, i))


WIRE = f"""
w AS (SELECT run_id, ['hunk', 'line-window', 'ast-units', 'ts-units', 'sites'][max(greatest(1, list_position(['hunk', 'line-window', 'ast-units', 'ts-units', 'sites'], cut)))] AS wire_format
  FROM (SELECT run_id, coalesce(nullif({CUT}, 'hunk_state-v1'), 'hunk') AS cut FROM v_judged) GROUP BY run_id)"""


@query("c26_wire_format", V.sql_with("v_judged", "WITH " + WIRE.strip() + " SELECT * FROM w"))
def c26(spark, sf):
    return P.wire_format(_cut_units(spark, sf))


@query("c27_run_enrichment", V.sql_with("v_judged", """
SELECT run_id, coalesce(string_agg(DISTINCT enrichment, '+' ORDER BY enrichment) FILTER (WHERE enrichment <> 'none'), 'none') AS enrichment FROM v_judged
WHERE (ord + repeat) % 3 <> 1 OR sample_id % 5 = 0 GROUP BY run_id"""))
def c27(spark, sf):
    j = V.judged(spark, sf).filter(((F.col("ord") + F.col("repeat")) % 3 != 1) | (F.col("sample_id") % 5 == 0))
    return P.run_enrichment(j)


def _stamped(spark, sf):
    return V.runs(spark, sf).select("run_id", F.when(F.col("sample_id") % 3 == 0, "hunk").otherwise("sites").alias("wire_format"))


@query("f19_stamp_conflicts", V.sql_with("v_judged v_runs", "WITH " + WIRE.strip() + """
SELECT run_id, r.wire_format, w.wire_format AS implied FROM (SELECT run_id, CASE WHEN sample_id % 3 = 0 THEN 'hunk' ELSE 'sites' END AS wire_format FROM v_runs) r JOIN w USING (run_id)
WHERE r.wire_format <> w.wire_format"""))
def f19(spark, sf):
    return P.stamp_conflicts(_cut_units(spark, sf), _stamped(spark, sf))


@query("f19_undistinguished_arms", V.sql_with("v_judged v_runs", "WITH " + WIRE.strip() + """
SELECT sample_id AS "range", count(DISTINCT repeat % 2) AS n_arms, count(DISTINCT wire_format) AS n_formats FROM w JOIN v_runs USING (run_id) GROUP BY sample_id
HAVING count(DISTINCT repeat % 2) > 1 AND count(DISTINCT wire_format) < 2"""))
def f19_arms(spark, sf):
    w = P.wire_format(_cut_units(spark, sf)).join(V.runs(spark, sf).select("run_id", "sample_id", "repeat"), "run_id")
    return P.undistinguished_arms(w.select(F.col("sample_id").alias("range"), (F.col("repeat") % 2).alias("arm"), "wire_format"))
