"""Registered queries: review threads to a validated corpus."""

from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions import texts as X
from judgelake.operators import corpus as B
from judgelake.plans import views as V
from judgelake.plans.queries_scalars import SPLIT_SQL
from judgelake.plans.registry import query
from judgelake.session import forget, scratch_path, slices, written, written_in_turn
from judgelake.sources import threads as TH

# Conversations play pull requests: user turns are threads, assistant turns comments.
THREADS_SQL = """
SELECT 'org/repo' || (conv_id % 5) AS repo, CAST(conv_id AS INTEGER) AS pr, 'org/repo' || (conv_id % 5) || '#' || conv_id || ':T' || turn AS id, turn,
  CASE WHEN (conv_id + turn) % 11 = 0 THEN 'left_side' WHEN (conv_id + turn) % 13 = 0 OR (conv_id + turn) % 17 = 0 THEN 'no_line' WHEN (conv_id + turn) % 19 = 0 THEN 'no_commit' END AS skip,
  'src/m' || turn || '.py' AS path, CAST(length(text) % 200 + 1 AS INTEGER) AS line, sha256(conv_id || ':' || (turn // 4))[1:40] AS original_commit, text
FROM conversations WHERE role = 'user'
"""
BULLETS_SQL = """
SELECT CAST(conv_id AS INTEGER) AS pr, turn, CASE WHEN turn % 4 = 1 THEN 'fixed' ELSE 'not-applied' END AS status,
  CASE WHEN turn % 4 = 1 THEN '- **Fixed in x** ' ELSE '- **Not applied** ' END || 'm' || (turn - 1) || '.py' || CASE WHEN conv_id % 10 = 4 AND turn >= 3 THEN ' and m0.py' ELSE '' END || ' ' || replace(text, chr(10), ' ') AS bullet
FROM conversations WHERE role = 'assistant' AND conv_id % 2 = 0
"""
CANDS_SQL = """
SELECT t.*, coalesce(m.status, 'unknown') AS disposition, CASE WHEN m.status IS NOT NULL THEN 'fix-pr' END AS disposition_source, m.bullet AS disposition_note
FROM v_threads t LEFT JOIN (SELECT t.id, min(status) AS status, min(bullet) AS bullet FROM v_threads t JOIN v_bullets b ON t.pr = b.pr AND contains(b.bullet, 'm' || t.turn || '.py')
  GROUP BY t.id HAVING count(*) = 1) m USING (id) WHERE skip IS NULL
"""
V.VIEWS_SQL["v_threads"] = ((), THREADS_SQL)
V.VIEWS_SQL["v_bullets"] = ((), BULLETS_SQL)
V.VIEWS_SQL["v_cands"] = (("v_threads", "v_bullets"), CANDS_SQL)


def pages(spark, sf):
    c = V.table(spark, sf, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    key = conv + turn
    commit = F.substring(F.sha2(F.concat(conv.cast("string"), F.lit(":"), F.floor(turn / 4).cast("string")), 256), 1, 40)
    first = F.struct(F.concat(F.lit("rev"), (turn % 3).cast("string")).alias("author"), F.col("text").alias("body"), F.lit("http://t").alias("url"),
                     F.when(key % 19 != 0, commit).alias("originalCommit"))
    comments = F.when(key % 17 == 0, F.array().cast("array<struct<author:string,body:string,url:string,originalCommit:string>>")).otherwise(F.array(first))
    thread = F.struct(F.concat(F.lit("T"), turn.cast("string")).alias("id"), (turn % 2 == 0).alias("isOutdated"), F.concat(F.lit("src/m"), turn.cast("string"), F.lit(".py")).alias("path"),
                      F.when(key % 13 != 0, F.length("text") % 200 + 1).cast("int").alias("originalLine"), F.lit(None).cast("int").alias("originalStartLine"),
                      F.when(key % 11 == 0, "LEFT").otherwise("RIGHT").alias("diffSide"), comments.alias("comments"))
    bullet = F.concat(F.when(turn % 4 == 1, "- **Fixed in x** ").otherwise("- **Not applied** "), F.lit("m"), (turn - 1).cast("string"), F.lit(".py"),
                      F.when((conv % 10 == 4) & (turn >= 3), " and m0.py").otherwise(""), F.lit(" "), F.translate("text", "\n", " "))
    comment = F.struct(F.lit("bot").alias("author"), F.concat(F.when(conv % 2 == 0, "\n" + K.FOLLOW_UP_HEADER + "\n").otherwise("Thanks\n"), bullet).alias("body"))

    def gather(role, value):
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct(turn.alias("o"), value.alias("v"))))), lambda x: x["v"])

    return c.groupBy("conv_id").agg(gather("user", thread).alias("threads"), gather("assistant", comment).alias("comments")).select(
        F.concat(F.lit("org/repo"), (conv % 5).cast("string")).alias("repo"),
        F.struct(conv.cast("int").alias("number"), F.concat(F.lit("http://pr/"), conv.cast("string")).alias("url"), F.lit("b" * 40).alias("baseRefOid"), F.lit("c" * 40).alias("headRefOid"),
                 "comments", "threads", F.lit(False).alias("threads_truncated")).alias("pr"))


def cands(spark, sf):
    return B.candidates(pages(spark, sf))


@query("a16_review_threads", V.sql_with("v_threads", "SELECT repo, pr, 'T' || turn AS thread_id, path, CASE WHEN (pr + turn) % 13 <> 0 THEN line END AS line FROM v_threads"))
def a16(spark, sf):
    path = scratch_path(spark, "pages")
    pages(spark, sf).write.json(path)
    return TH.explode_threads(TH.read_pages(spark, path)).select("repo", "pr", "thread_id", "path", "line")


@query("b16_match_bullet", V.sql_with("v_threads v_bullets", """
SELECT id, min(bullet) AS bullet FROM v_threads t JOIN v_bullets b ON t.pr = b.pr AND contains(b.bullet, 'm' || t.turn || '.py') GROUP BY id HAVING count(*) = 1"""))
def b16(spark, sf):
    p = pages(spark, sf).withColumn("bullets", F.flatten(F.transform("pr.comments", lambda c: X.follow_up_bullets(c["body"]))))
    rows = p.select("repo", F.col("pr.number").alias("pr"), "bullets", F.explode("pr.threads").alias("t")).withColumn("path", F.col("t.path"))
    return B.match_bullet(rows).filter("hit is not null").select(
        F.concat("repo", F.lit("#"), F.col("pr").cast("string"), F.lit(":"), "t.id").alias("id"), F.col("hit.bullet").alias("bullet"))


@query("i1_candidates", V.sql_with("v_threads", "SELECT id, repo, pr, path, line, original_commit, text AS body FROM v_threads WHERE skip IS NULL"))
def i1(spark, sf):
    return cands(spark, sf).select("id", "repo", "pr", "path", "line", "original_commit", "body")


@query("i1_thread_stats", V.sql_with("v_threads", "SELECT repo, skip AS reason, count(*) AS n FROM v_threads WHERE skip IS NOT NULL GROUP BY ALL"))
def i1_stats(spark, sf):
    return B.thread_stats(pages(spark, sf))


@query("i2_dispositions", V.sql_with("v_cands", "SELECT id, disposition, disposition_source, disposition_note FROM v_cands"))
def i2(spark, sf):
    return cands(spark, sf).select("id", "disposition", "disposition_source", "disposition_note")


def commit_diffs(spark, sf):
    """Three later commits per thread file, each with two zero-context hunks."""
    t = TH.explode_threads(pages(spark, sf)).filter(B.thread_skip_reason().isNull()).withColumn("o", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    n = F.length("first.body")
    a = (n * (F.col("o") + 1) * 7) % 200 + 1
    diff = F.concat(F.lit("diff --git a/x b/x\n@@ -"), a.cast("string"), F.lit(","), (F.col("o") * 20).cast("string"), F.lit(" +1,2 @@\n-x\n+"), "first.body",
                    F.lit("\n@@ -"), (a + 60).cast("string"), F.lit(" +9,0 @@\n-y\n"))
    return t.select("repo", F.col("first.originalCommit").alias("since_sha"), "path", F.concat(F.lit("fix"), F.col("o").cast("string"), F.lit("-"), "pr").alias("commit"),
                    F.col("o").alias("ord"), diff.alias("diff_text"))


FIXES = """
fx AS (SELECT c.id, min(o) AS o FROM v_cands c, (SELECT unnest([0, 1, 2]) AS o) d
  WHERE c.line BETWEEN (length(text) * (o + 1) * 7) % 200 + 1 - 2 AND (length(text) * (o + 1) * 7) % 200 + 1 + greatest(o * 20, 1) + 1
    OR c.line BETWEEN (length(text) * (o + 1) * 7) % 200 + 61 - 2 AND (length(text) * (o + 1) * 7) % 200 + 61 + 2 GROUP BY c.id)"""


@query("i3_first_fix_commit", V.sql_with("v_cands", f"WITH {FIXES.strip()} SELECT id, 'fix' || o || '-' || pr AS fix_sha FROM v_cands JOIN fx USING (id)"))
def i3(spark, sf):
    c = cands(spark, sf)
    return c.join(B.first_fixes(c, commit_diffs(spark, sf)), ["repo", "original_commit", "path", "line"]).select("id", "fix_sha")


@query("i3_resolved_dispositions", V.sql_with("v_cands", f"""WITH {FIXES.strip()} SELECT id, CASE WHEN disposition IN ('unknown', 'fixed') AND o IS NOT NULL THEN 'fix' || o || '-' || pr END AS fix_sha,
  CASE WHEN disposition <> 'unknown' THEN disposition WHEN o IS NOT NULL THEN 'fixed' ELSE 'unaddressed' END AS disposition, CASE WHEN disposition = 'unknown' THEN 'thread-fix' ELSE disposition_source END AS disposition_source
FROM v_cands LEFT JOIN fx USING (id)"""))
def i3_resolved(spark, sf):
    c = cands(spark, sf)
    return B.resolve_dispositions(c, B.first_fixes(c, commit_diffs(spark, sf))).select("id", "fix_sha", "disposition", "disposition_source")


# Customers' orders play mined findings: nation = repo, customer = pull request.
MINED_SQL = """
SELECT 'n' || c_nationkey AS repo, c_custkey AS pr, 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 997 = 0 THEN 'gone' END AS error,
  ['fixed', 'not-applied', 'unaddressed', 'unknown'][o_orderkey % 4 + 1] AS disposition FROM orders JOIN customer ON o_custkey = c_custkey
"""
SIZES_SQL = """
SELECT repo, pr, count(*) AS n, sha256('7:' || repo || ':' || pr) AS key FROM v_mined m WHERE NOT EXISTS (SELECT 1 FROM v_mined e WHERE e.repo = m.repo AND e.pr = m.pr AND e.error IS NOT NULL)
GROUP BY repo, pr
"""
QUOTAS_SQL = """
SELECT repo, CAST(1200 // (SELECT count(DISTINCT repo) FROM v_sizes) + CASE WHEN row_number() OVER (ORDER BY repo) - 1 < 1200 % (SELECT count(DISTINCT repo) FROM v_sizes) THEN 1 ELSE 0 END AS BIGINT) AS quota
FROM (SELECT DISTINCT repo FROM v_sizes)
"""
FIRST_SQL = """
SELECT repo, pr, n FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY repo ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM v_sizes) JOIN v_quotas USING (repo) WHERE b < quota
"""
V.VIEWS_SQL["v_mined"] = ((), MINED_SQL)
V.VIEWS_SQL["v_sizes"] = (("v_mined",), SIZES_SQL)
V.VIEWS_SQL["v_quotas"] = (("v_sizes",), QUOTAS_SQL)
V.VIEWS_SQL["v_first"] = (("v_quotas",), FIRST_SQL)
TARGET = 1200


def mined(spark, sf):
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    k = F.col("o_orderkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repo"), F.col("c_custkey").alias("pr"), F.concat(F.lit("o"), k.cast("string")).alias("id"),
        F.when(k % 997 == 0, "gone").alias("error"), V._pick(["fixed", "not-applied", "unaddressed", "unknown"], k % 4).alias("disposition"))


def _sizes(spark, sf):
    return B.pr_sizes(B.exclude_errored(mined(spark, sf)), 7)


@query("i4_exclude_errored", V.sql_with("v_sizes", "SELECT repo, pr, n FROM v_sizes"))
def i4(spark, sf):
    return _sizes(spark, sf).select("repo", "pr", "n")


@query("i5_repo_quotas", V.sql_with("v_quotas", "SELECT * FROM v_quotas"))
def i5(spark, sf):
    return B.repo_quotas(_sizes(spark, sf), TARGET)


@query("i6_sample_first_pass", V.sql_with("v_first", "SELECT * FROM v_first"))
def i6(spark, sf):
    return B.sample_first_pass(_sizes(spark, sf), TARGET).select("repo", "pr", "n")


@query("i7_sample_second_pass")
def i7(spark, sf):
    # quotas overshoot here, so the leftover comes from a larger target
    sizes = _sizes(spark, sf)
    return B.sample_second_pass(sizes, B.sample_first_pass(sizes, TARGET), 2 * TARGET)


@query("i8_sample_report", V.sql_with("v_first v_mined", """
SELECT repo, count(*) AS n_findings, count(DISTINCT pr) AS n_prs, """ + ", ".join(
    f"count(*) FILTER (WHERE disposition = '{d}') AS n_{d.replace('-', '_')}" for d in ("fixed", "not-applied", "unaddressed", "unknown")) + """
FROM v_mined JOIN (SELECT repo, pr FROM v_first) USING (repo, pr) GROUP BY repo"""))
def i8(spark, sf):
    first = B.sample_first_pass(_sizes(spark, sf), TARGET).select("repo", "pr")
    return B.sample_report(mined(spark, sf).join(first, ["repo", "pr"], "left_semi"))


# Line items play adjudicated candidates of the pull request of their order.
ADJUDICATED_SQL = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INTEGER) AS candidate_id, 'acme/r' || (l_orderkey % 7) AS repo, CAST(l_orderkey AS INTEGER) AS pr,
  sha256(l_orderkey || ':' || (l_suppkey % 3))[1:40] AS original_commit, sha256('base' || l_orderkey)[1:40] AS base_ref_oid, sha256('head' || l_orderkey)[1:40] AS head_ref_oid,
  ['fixed', 'not-applied', 'unaddressed', 'unknown'][l_suppkey % 4 + 1] AS disposition, CASE WHEN l_partkey % 3 = 0 THEN 'fix-pr' ELSE 'thread-fix' END AS disposition_source,
  CASE WHEN l_suppkey % 4 = 0 THEN 'fix' || l_partkey END AS fix_sha, CASE WHEN l_partkey % 211 = 0 THEN 'gone' END AS error,
  'f' || (l_suppkey % 3) || '.py' AS file, CAST(l_partkey % 6 AS INTEGER) AS line,
  ['real-bug', 'style', 'false-positive', 'real-bug', 'unclear'][l_partkey % 5 + 1] AS label, CASE WHEN l_partkey % 2 = 0 THEN 'major' END AS severity_class, 'bug-risk' AS category,
  'seen | in ' || l_shipdate::DATE AS evidence, 'q' || CAST(l_quantity AS INTEGER) AS verify_substring, CASE WHEN l_partkey % 29 = 0 THEN NULL WHEN l_partkey % 31 = 0 THEN 'bogus' ELSE 'style-nit' END AS dismissal_reason,
  l_partkey % 4 <> 0 AS fixed_at_final, l_partkey * 10 + l_linenumber AS ord
FROM lineitem
"""
DECISIONS_SQL = """
SELECT candidate_id, CASE WHEN ord % 40 = 0 THEN 'style' WHEN ord % 40 = 1 THEN 'real-bug' WHEN ord % 40 = 2 THEN 'unclear' WHEN ord % 40 = 3 THEN 'wrong' END AS override,
  CASE WHEN ord % 40 IN (0, 2) THEN 'note ' || ord END AS human_note, ord % 40 BETWEEN 4 AND 6 AS agreed FROM v_adj WHERE ord % 40 < 7
"""
RESOLVED_SQL = """
SELECT *, coalesce(override, label) AS final, override IS NOT NULL AS human FROM v_adj a LEFT JOIN v_decisions d USING (candidate_id) WHERE pr % 1009 <> 5
"""
ROWS_SQL = """
SELECT * REPLACE (final AS label) FROM v_resolved WHERE error IS NULL AND final IN ('real-bug', 'style', 'false-positive')
  AND (human OR final = 'real-bug' OR dismissal_reason = 'style-nit')
"""
HEADS_SQL = """
SELECT repo, pr, coalesce(bug_head, first_head) AS pre_head, base_sha, final_head, source FROM (
  SELECT repo, pr, arg_min(original_commit, ord) AS first_head, arg_min(base_ref_oid, ord) AS base_sha, arg_min(head_ref_oid, ord) AS final_head,
    CASE WHEN bool_or(disposition_source = 'fix-pr') THEN 'fix-pr' ELSE 'thread-fix' END AS source FROM v_rows GROUP BY repo, pr)
LEFT JOIN (SELECT repo, pr, original_commit AS bug_head FROM (SELECT repo, pr, original_commit, row_number() OVER (PARTITION BY repo, pr ORDER BY count(*) DESC, original_commit) AS r
  FROM v_rows WHERE label = 'real-bug' GROUP BY repo, pr, original_commit) WHERE r = 1) USING (repo, pr)
"""
VERIFIED_SQL = """
SELECT r.*, pre_head, source, CASE WHEN n_lines IS NULL THEN 'missing' WHEN r.line < 1 OR r.line > n_lines THEN 'out of range' WHEN l.text IS NULL OR NOT contains(l.text, verify_substring) THEN 'lacks substring' END AS problem
FROM v_rows r JOIN v_heads USING (repo, pr) LEFT JOIN (SELECT repo, sha, file, max(line) AS n_lines FROM v_lines GROUP BY ALL) n ON n.repo = r.repo AND n.sha = pre_head AND n.file = r.file
  LEFT JOIN v_lines l ON l.repo = r.repo AND l.sha = pre_head AND l.file = r.file AND l.line = r.line
"""
LINES_SQL = """
SELECT repo, sha256(pr || ':' || s)[1:40] AS sha, file, line, string_agg(verify_substring, ' ' ORDER BY verify_substring) AS text
FROM (SELECT repo, pr, file, line, verify_substring FROM v_adj WHERE ord % 13 <> 0 AND line BETWEEN 1 AND 4), (SELECT unnest([0, 1, 2]) AS s) GROUP BY repo, pr, s, file, line
"""
KEPT_SQL = """
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY repo, pr, file, line ORDER BY NOT human, label <> 'real-bug', candidate_id) AS r,
  first_value(candidate_id) OVER (PARTITION BY repo, pr, file, line ORDER BY NOT human, label <> 'real-bug', candidate_id) AS kept_id FROM v_verified WHERE problem IS NULL) WHERE {cond}
"""
for _name, _deps, _sql in (("v_adj", (), ADJUDICATED_SQL), ("v_decisions", ("v_adj",), DECISIONS_SQL), ("v_resolved", ("v_decisions",), RESOLVED_SQL),
                           ("v_rows", ("v_resolved",), ROWS_SQL), ("v_heads", ("v_rows",), HEADS_SQL), ("v_lines", ("v_adj",), LINES_SQL),
                           ("v_verified", ("v_heads", "v_lines"), VERIFIED_SQL), ("v_kept", ("v_verified",), KEPT_SQL.format(cond="r = 1")),
                           ("v_losers", ("v_verified",), KEPT_SQL.format(cond="r > 1"))):
    V.VIEWS_SQL[_name] = (_deps, _sql)


def adjudicated(spark, sf):
    li, o, p, s = V.table(spark, sf, "lineitem"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")

    def sha(*parts):
        return F.substring(F.sha2(F.concat(*parts), 256), 1, 40)

    ok = o.cast("string")
    return li.select(
        F.concat_ws("-", ok, F.col("l_linenumber").cast("string"), p.cast("string"), s.cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("candidate_id"),
        F.concat(F.lit("acme/r"), (o % 7).cast("string")).alias("repo"), o.cast("int").alias("pr"), sha(ok, F.lit(":"), (s % 3).cast("string")).alias("original_commit"),
        sha(F.lit("base"), ok).alias("base_ref_oid"), sha(F.lit("head"), ok).alias("head_ref_oid"),
        V._pick(["fixed", "not-applied", "unaddressed", "unknown"], s % 4).alias("disposition"), F.when(p % 3 == 0, "fix-pr").otherwise("thread-fix").alias("disposition_source"),
        F.when(s % 4 == 0, F.concat(F.lit("fix"), p.cast("string"))).alias("fix_sha"), F.when(p % 211 == 0, "gone").alias("error"),
        F.concat(F.lit("f"), (s % 3).cast("string"), F.lit(".py")).alias("file"), (p % 6).cast("int").alias("line"),
        V._pick(["real-bug", "style", "false-positive", "real-bug", "unclear"], p % 5).alias("label"), F.when(p % 2 == 0, "major").alias("severity_class"), F.lit("bug-risk").alias("category"),
        F.concat(F.lit("seen | in "), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("evidence"), F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")).alias("verify_substring"),
        F.when(p % 29 == 0, None).when(p % 31 == 0, "bogus").otherwise("style-nit").alias("dismissal_reason"), (p % 4 != 0).alias("fixed_at_final"),
        (p * 10 + F.col("l_linenumber")).alias("ord"))


ADJ_COLS = ["candidate_id", "file", "line", "label", "severity_class", "category", "evidence", "verify_substring", "dismissal_reason", "fixed_at_final", "ord"]


def _adj(spark, sf):
    return adjudicated(spark, sf).select(*ADJ_COLS)


def _cand_rows(spark, sf):
    """Candidates; some adjudicated rows have none."""
    return adjudicated(spark, sf).filter(F.col("pr") % 1009 != 5).select(
        F.col("candidate_id").alias("id"), "repo", "pr", "original_commit", "base_ref_oid", "head_ref_oid", "disposition", "disposition_source", "fix_sha", "error",
        F.concat(F.lit("http://t/"), "candidate_id").alias("thread_url"))


def _sheet(spark, sf):
    k = F.col("ord") % 40
    a = adjudicated(spark, sf).filter(k < 7)
    blank = F.lit("")
    return a.select("candidate_id", F.when(F.col("ord") % 3 == 0, "random").otherwise("disagreement").alias("why"), blank.alias("thread"), blank.alias("code"), "disposition", "label", blank.alias("severity"),
                    blank.alias("evidence"), F.when(k < 4, "Disagree").otherwise("agree").alias("verdict"),
                    F.when(k == 0, "style").when(k == 1, "real-bug").when(k == 3, "wrong").otherwise("").alias("correct_label"),
                    F.when(k.isin(0, 2), F.concat(F.lit("note "), F.col("ord").cast("string"))).otherwise("").alias("note"))


def _rows(spark, sf, part=lambda *keys: F.lit(True)):
    """Resolved rows, of one slice of the candidates if ``part`` tells which."""
    return B.resolve_labels(_adj(spark, sf).filter(part("candidate_id")), _cand_rows(spark, sf).filter(part("id")),
                            B.sheet_decisions(_sheet(spark, sf)).filter(part("candidate_id")))[0]


def _in_slices(parts, make, name):
    """``make`` of each slice, written one after the other; no more than one slice is shuffled at one time."""
    return written(make(parts[0]), name) if len(parts) == 1 else written_in_turn(map(make, parts), name)


def _line_texts(spark, sf):
    a = adjudicated(spark, sf).filter((F.col("ord") % 13 != 0) & F.col("line").between(1, 4))
    # the lines of a file lie side by side, so its commit packs well in the next shuffle
    return a.repartition("repo", "pr", "file").groupBy("repo", "pr", "file", "line").agg(F.array_join(F.sort_array(F.collect_list("verify_substring")), " ").alias("text"))


def _file_lines(texts):
    return texts.withColumn("s", F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2")))).select(
        "repo", F.substring(F.sha2(F.concat(F.col("pr").cast("string"), F.lit(":"), "s"), 256), 1, 40).alias("sha"), "file", "line", "text")


ANCHORED = ["candidate_id", "repo", "pr", "file", "line", "label", "human"]


def _verified(spark, sf, shown, *more, ends=False, of=None):
    """(slices, rows after ``shown``, heads); base and head commits only if ``ends`` asks.
    Rows that ``of`` does not hold for compete for their anchor, but leave ``more`` empty."""
    columns = {*ANCHORED, *more, "original_commit", "disposition_source", "ord", "verify_substring", *(["base_ref_oid", "head_ref_oid"] if ends else [])}
    parts = slices(_adj(spark, sf))

    def resolved(part):
        rows = _rows(spark, sf, part).select(*sorted(columns))
        return rows if of is None else rows.withColumns({c: F.when(F.expr(of), F.col(c)) for c in more if c != "verify_substring"})

    rows = _in_slices(parts, resolved, "resolved")
    heads = _in_slices(parts, lambda part: B.pre_heads(rows.filter(part("repo", "pr"))), "heads")
    asked, given = rows.select(*dict.fromkeys([*ANCHORED, *more, "verify_substring"])), heads.select("repo", "pr", "pre_head")
    headed = _in_slices(parts, lambda part: asked.filter(part("repo", "pr")).join(given.filter(part("repo", "pr")), ["repo", "pr"]), "headed")
    forget(rows)
    texts = written(_line_texts(spark, sf), "lines")
    lines = _file_lines(texts)
    v = _in_slices(parts, lambda part: shown(B.verify_rows(headed.filter(part("repo", "pre_head")), lines.filter(part("repo", "sha")))), "verified")
    forget(headed, texts)
    return parts, v, heads


def _holding(spark, sf, *more, **asked):
    """(slices, rows that hold, heads)."""
    return _verified(spark, sf, lambda v: v.filter("problem is null").select(*dict.fromkeys([*ANCHORED, *more])), *more, **asked)


def _kept(spark, sf, *more, of=None):
    _, v, heads = _holding(spark, sf, *more, of=of)
    forget(heads)
    return B.dedupe_anchors(v)


@query("i9_spot_check_rows", V.sql_with("v_adj", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY sha256('3:' || candidate_id)) AS k, count(*) OVER () AS total FROM v_adj WHERE error IS NULL AND pr % 1009 <> 5),
w AS (SELECT *, k <= greatest(1, round_even(total * 0.2, 0)) AS rnd, (disposition = 'fixed' AND label = 'false-positive') OR (disposition IN ('not-applied', 'unaddressed') AND label = 'real-bug') AS dis FROM r)
SELECT candidate_id, CASE WHEN rnd AND dis THEN 'random+disagreement' WHEN rnd THEN 'random' ELSE 'disagreement' END AS why, '[thread](http://t/' || candidate_id || ')' AS thread,
  '[code](https://github.com/' || repo || '/blob/' || original_commit || '/' || file || '#L' || line || ')' AS code, disposition, label, coalesce(severity_class, '') AS severity, evidence,
  '' AS verdict, '' AS correct_label, '' AS note FROM w WHERE rnd OR dis"""))
def i9(spark, sf):
    return B.spot_check_rows(_adj(spark, sf), _cand_rows(spark, sf), seed=3)


@query("i10_sheet_decisions", V.sql_with("v_decisions", "SELECT * FROM v_decisions"))
def i10(spark, sf):
    return B.sheet_decisions(_sheet(spark, sf))


@query("i10_sheet_agreement", V.sql_with("v_adj", """
SELECT CAST(0 AS BIGINT) AS n_unfilled, count(*) AS n_random, count(*) FILTER (WHERE ord % 40 >= 4) AS n_agree, round(count(*) FILTER (WHERE ord % 40 >= 4) / count(*), 6) AS agreement,
  count(*) FILTER (WHERE ord % 40 >= 4) / count(*) >= 0.85 AS passes FROM v_adj WHERE ord % 40 < 7 AND ord % 3 = 0"""))
def i10_agreement(spark, sf):
    return B.sheet_agreement(_sheet(spark, sf)).withColumn("agreement", F.round("agreement", 6))


@query("i11_resolve_labels", V.sql_with("v_rows", "SELECT candidate_id, repo, pr, label, human FROM v_rows"))
def i11(spark, sf):
    return _rows(spark, sf).select("candidate_id", "repo", "pr", "label", "human")


@query("i11_label_errors", V.sql_with("v_decisions", """
SELECT candidate_id, fault FROM (SELECT candidate_id, CASE WHEN pr % 1009 = 5 THEN 'unknown candidate' WHEN error IS NULL AND coalesce(override, label) = 'wrong' THEN 'bad label'
  WHEN error IS NULL AND override IS NULL AND label IN ('style', 'false-positive') AND coalesce(dismissal_reason, '') <> 'style-nit' THEN 'missing dismissal reason' END AS fault
  FROM v_adj LEFT JOIN v_decisions USING (candidate_id)) WHERE fault IS NOT NULL"""))
def i11_errors(spark, sf):
    return B.resolve_labels(_adj(spark, sf), _cand_rows(spark, sf), B.sheet_decisions(_sheet(spark, sf)))[1]


@query("i12_pre_heads", V.sql_with("v_heads", "SELECT * FROM v_heads"))
def i12(spark, sf):
    return B.pre_heads(_rows(spark, sf))


@query("i13_verify_rows", V.sql_with("v_verified", "SELECT candidate_id, problem FROM v_verified"))
def i13(spark, sf):
    _, v, heads = _verified(spark, sf, lambda v: v.select("candidate_id", "problem"))
    forget(heads)
    return v


@query("i14_dedupe_anchors", V.sql_with("v_kept", "SELECT candidate_id, repo, pr, file, line, label FROM v_kept"))
def i14(spark, sf):
    return _kept(spark, sf)[0].select("candidate_id", "repo", "pr", "file", "line", "label")


@query("i14_duplicate_warnings", V.sql_with("v_losers", "SELECT candidate_id, repo, pr, file, line, label, kept_id FROM v_losers"))
def i14_losers(spark, sf):
    return _kept(spark, sf)[1].select("candidate_id", "repo", "pr", "file", "line", "label", "kept_id")


SAMPLES_SQL = f"""
pre AS (SELECT repo, pr, bool_or(label = 'real-bug') AS has_bug, coalesce(bool_and(fixed_at_final) FILTER (WHERE label = 'real-bug'), FALSE) AS all_fixed FROM v_kept GROUP BY repo, pr),
smp AS (SELECT p.*, pre_head, base_sha, final_head, source, {SPLIT_SQL} AS split FROM (SELECT *, sha256(repo || '#' || pr) AS h FROM pre) p JOIN v_heads USING (repo, pr))"""


@query("i15_pre_samples", V.sql_with("v_kept", f"""WITH {SAMPLES_SQL.strip()}
SELECT repo || '#' || pr || '@pre' AS sample_id, repo, base_sha, pre_head AS head_sha, CASE WHEN has_bug THEN 'positive' ELSE 'clean' END AS kind, split, source FROM smp"""))
def i15(spark, sf):
    return _pre(spark, sf)[1].select(*K.PRS_COLUMNS)


def _pre(spark, sf):
    """(slices, samples by pull request)."""
    parts, v, heads = _holding(spark, sf, "fixed_at_final", ends=True)
    pre = _in_slices(parts, lambda part: B.pre_samples(B.dedupe_anchors(v.filter(part("repo", "pr")))[0], heads.filter(part("repo", "pr"))), "pre-samples")
    forget(v, heads)
    return parts, pre


#: What issue rows show besides their anchor; dismissed rows show their reason only.
ISSUE_PARTS = ["verify_substring", "severity_class", "category", "evidence", "human_note", "fix_sha", "agreed"]


@query("i15_issue_rows", V.sql_with("v_kept", """
SELECT repo || '#' || pr || '@pre' AS sample_id, file, '' || line AS line, verify_substring, coalesce(severity_class, 'minor') AS severity_class, category,
  replace(coalesce(human_note, evidence), '|', '\\|') AS evidence, coalesce(fix_sha, '') AS fix_sha, CASE WHEN human THEN 'human' ELSE 'claude' END AS adjudicator,
  CASE WHEN human OR coalesce(agreed, FALSE) THEN 'y' ELSE 'n' END AS spot_checked FROM v_kept WHERE label = 'real-bug'"""))
def i15_issues(spark, sf):
    return B.corpus_rows(_kept(spark, sf, *ISSUE_PARTS, of="label = 'real-bug'")[0])[0].select(*K.ISSUE_COLUMNS)


@query("i15_dismissed_rows", V.sql_with("v_kept", """
SELECT repo || '#' || pr || '@pre' AS sample_id, file, '' || line AS line, label, coalesce(dismissal_reason, 'other') AS dismissal_reason, CASE WHEN human THEN 'human' ELSE 'claude' END AS adjudicator FROM v_kept WHERE label <> 'real-bug'"""))
def i15_dismissed(spark, sf):
    return B.corpus_rows(_kept(spark, sf, "dismissal_reason", of="label <> 'real-bug'")[0])[1].select("sample_id", "file", "line", "label", "dismissal_reason", "adjudicator")


def _promotions(spark, sf):
    """Unclear rows are promoted; some of them lie at a line that holds."""
    a = adjudicated(spark, sf).filter("label = 'unclear'")
    return a.select(X.sample_id(F.col("repo"), F.col("pr"), "final").alias("sample_id"), "file", "line", "verify_substring", "severity_class", "category", "evidence")


def _final_lines(texts):
    # the head follows from the pull request
    head = F.substring(F.sha2(F.concat(F.lit("head"), F.col("pr").cast("string")), 256), 1, 40)
    return texts.select("repo", head.alias("sha"), "file", "line", "text")


PROMOTED_SQL = f"""WITH {SAMPLES_SQL.strip()},
fl AS (SELECT repo, pr, file, line, string_agg(verify_substring, ' ') AS text, max(line) OVER (PARTITION BY repo, pr, file) AS n_lines FROM v_adj WHERE line BETWEEN 1 AND 4 AND ord % 13 <> 0 GROUP BY repo, pr, file, line),
promo AS (SELECT p.*, s.* EXCLUDE (repo, pr), CASE WHEN n.n_lines IS NULL THEN 'missing' WHEN p.line < 1 OR p.line > n.n_lines THEN 'out of range' WHEN NOT coalesce(contains(f.text, verify_substring), FALSE) THEN 'lacks substring' END AS problem
  FROM (SELECT repo, pr, file, line, verify_substring, severity_class, category, evidence FROM v_adj WHERE label = 'unclear') p JOIN (SELECT * FROM smp WHERE all_fixed) s ON s.repo = p.repo AND s.pr = p.pr
  LEFT JOIN (SELECT DISTINCT repo, pr, file, n_lines FROM fl) n ON n.repo = p.repo AND n.pr = p.pr AND n.file = p.file LEFT JOIN fl f ON f.repo = p.repo AND f.pr = p.pr AND f.file = p.file AND f.line = p.line)
"""


@query("i15_final_samples", V.sql_with("v_kept", PROMOTED_SQL + """,
ok AS (SELECT repo, pr, bool_or(problem IS NULL) AS ok FROM promo GROUP BY repo, pr)
SELECT s.repo || '#' || s.pr || '@final' AS sample_id, s.repo, base_sha, final_head AS head_sha, CASE WHEN ok THEN 'positive' ELSE 'clean' END AS kind, split, CASE WHEN ok THEN 'promoted' ELSE source END AS source
FROM smp s LEFT JOIN ok ON ok.repo = s.repo AND ok.pr = s.pr WHERE all_fixed AND coalesce(ok, TRUE)"""))
def i15_final(spark, sf):
    return _final(spark, sf, 0, *K.PRS_COLUMNS)


def _final(spark, sf, k, *columns):
    """Part ``k`` of the final samples, in slices by final head: all of a sample lies at one head."""
    parts, pre = _pre(spark, sf)
    texts = written(_line_texts(spark, sf), "lines")
    lines = _final_lines(texts)
    final = _in_slices(parts, lambda part: B.final_samples(
        pre.filter(part("repo", "final_head")), _promotions(spark, sf), lines.filter(part("repo", "sha")))[k].select(*columns), "final")
    forget(pre, texts)
    return final


@query("i15_promoted_issues", V.sql_with("v_kept", PROMOTED_SQL + """
SELECT repo || '#' || pr || '@final' AS sample_id, file, '' || line AS line, verify_substring, coalesce(severity_class, 'minor') AS severity_class, category, replace(evidence, '|', '\\|') AS evidence,
  '' AS fix_sha, 'claude' AS adjudicator, 'n' AS spot_checked FROM promo WHERE problem IS NULL"""))
def i15_promoted(spark, sf):
    return _final(spark, sf, 1, *K.ISSUE_COLUMNS)


@query("i15_promotion_warnings", V.sql_with("v_kept", PROMOTED_SQL + """
SELECT repo || '#' || pr || '@final' AS sample_id, file, line, verify_substring, problem FROM promo WHERE problem IS NOT NULL"""))
def i15_warnings(spark, sf):
    return _final(spark, sf, 2, "sample_id", "file", "line", "verify_substring", "problem")


@query("i16_route", V.sql_with("v_adj", "SELECT CASE WHEN repo IN ('acme/r2', 'acme/r5') THEN 'private' ELSE 'public' END AS root, repo, count(*) AS n FROM v_adj GROUP BY ALL"))
def i16(spark, sf):
    a = adjudicated(spark, sf)
    private = a.filter(F.col("pr") % 7 % 3 == 2).select("repo")
    return B.route(a.select("repo", "pr"), private).groupBy("root", "repo").agg(F.count(F.lit(1)).alias("n"))


# A written corpus with broken rows of every rule.
PRS_SQL = f"""
SELECT *, CASE WHEN o_orderkey % 101 = 0 THEN 'x' || sid ELSE sid END AS sample_id FROM (SELECT o_orderkey, 'acme/r' || (o_custkey % 7) || '#' || o_orderkey || '@pre' AS sid,
  CASE WHEN o_orderkey % 103 = 1 THEN 'other/r' ELSE 'acme/r' || (o_custkey % 7) END AS repo, CASE WHEN o_orderkey % 107 = 2 THEN 'abc' ELSE sha256('b' || o_orderkey)[1:40] END AS base_sha,
  sha256('h' || o_orderkey)[1:40] AS head_sha, CASE WHEN o_orderkey % 109 = 3 THEN 'odd' WHEN o_orderkey % 3 = 0 THEN 'clean' ELSE 'positive' END AS kind,
  CASE WHEN o_orderkey % 113 = 4 THEN 'train' ELSE {SPLIT_SQL} END AS split, {SPLIT_SQL} AS right_split, CASE WHEN o_orderkey % 127 = 5 THEN 'mail' ELSE 'fix-pr' END AS source
FROM (SELECT *, sha256('acme/r' || (o_custkey % 7) || '#' || o_orderkey) AS h FROM orders))
"""
CISSUES_SQL = """
SELECT 'acme/r' || (o_custkey % 7) || '#' || (l_orderkey + CASE WHEN l_partkey % 131 = 0 THEN 50000000 ELSE 0 END) || '@pre' AS sample_id, 'f' || (l_suppkey % 50) || '.py' AS file,
  CASE WHEN l_partkey % 137 = 1 THEN 'x1' ELSE '' || (l_partkey % 900) END AS line, CASE WHEN l_partkey % 139 = 2 THEN 'huge' ELSE 'major' END AS severity_class,
  CASE WHEN l_partkey % 149 = 3 THEN 'unclear' ELSE 'style' END AS label, CASE WHEN l_partkey % 151 = 4 THEN 'because' ELSE 'other' END AS dismissal_reason, l_suppkey % 2 = 0 AS is_issue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
V.VIEWS_SQL["v_prs"] = ((), PRS_SQL)
V.VIEWS_SQL["v_crows"] = ((), CISSUES_SQL)


def corpus_tables(spark, sf):
    o, k = V.table(spark, sf, "orders"), F.col("o_orderkey")
    repo = F.concat(F.lit("acme/r"), (F.col("o_custkey") % 7).cast("string"))
    sid = X.sample_id(repo, k, "pre")

    def sha(p):
        return F.substring(F.sha2(F.concat(F.lit(p), k.cast("string")), 256), 1, 40)

    prs = o.select(
        F.when(k % 101 == 0, F.concat(F.lit("x"), F.translate(sid, "#", ""))).otherwise(sid).alias("sample_id"), F.when(k % 103 == 1, "other/r").otherwise(repo).alias("repo"),
        F.when(k % 107 == 2, "abc").otherwise(sha("b")).alias("base_sha"), sha("h").alias("head_sha"),
        F.when(k % 109 == 3, "odd").when(k % 3 == 0, "clean").otherwise("positive").alias("kind"), F.when(k % 113 == 4, "train").otherwise(X.split_for(repo, k)).alias("split"),
        F.when(k % 127 == 5, "mail").otherwise("fix-pr").alias("source"))
    p = F.col("l_partkey")
    rows = V.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == k).select(
        X.sample_id(repo, F.col("l_orderkey") + F.when(p % 131 == 0, 50000000).otherwise(0), "pre").alias("sample_id"),
        F.concat(F.lit("f"), (F.col("l_suppkey") % 50).cast("string"), F.lit(".py")).alias("file"), F.when(p % 137 == 1, "x1").otherwise((p % 900).cast("string")).alias("line"),
        F.when(p % 139 == 2, "huge").otherwise("major").alias("severity_class"), F.when(p % 149 == 3, "unclear").otherwise("style").alias("label"),
        F.when(p % 151 == 4, "because").otherwise("other").alias("dismissal_reason"), (F.col("l_suppkey") % 2 == 0).alias("is_issue"))
    return prs, rows.filter("is_issue"), rows.filter("not is_issue")


@query("i17_violations", V.sql_with("v_prs v_crows", """
WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 101 = 0 THEN replace(sample_id, '#', '') ELSE sample_id END AS sample_id, * EXCLUDE (sample_id) FROM v_prs),
j AS (SELECT r.*, p.kind, p.sample_id IS NOT NULL AS known FROM v_crows r LEFT JOIN p ON r.sample_id = p.sample_id)
SELECT rule, sample_id, NULL AS file, NULL AS line FROM (
  SELECT 'bad sample_id' AS rule, sample_id, k % 101 = 0 AS hit FROM p UNION ALL SELECT 'repo differs', sample_id, k % 101 <> 0 AND k % 103 = 1 FROM p
  UNION ALL SELECT 'bad kind', sample_id, kind = 'odd' FROM p UNION ALL SELECT 'bad source', sample_id, source = 'mail' FROM p
  UNION ALL SELECT 'split differs', sample_id, k % 101 <> 0 AND split <> right_split FROM p UNION ALL SELECT 'bad base_sha', sample_id, base_sha = 'abc' FROM p) WHERE hit
UNION ALL SELECT rule, sample_id, file, line FROM (
  SELECT 'unknown sample' AS rule, sample_id, file, line, NOT known AS hit FROM j UNION ALL SELECT 'bad line', sample_id, file, line, line IN ('x1', '0') FROM j
  UNION ALL SELECT 'bad severity_class', sample_id, file, line, severity_class = 'huge' FROM j UNION ALL SELECT 'issue on non-positive sample', sample_id, file, line, is_issue AND known AND kind <> 'positive' FROM j
  UNION ALL SELECT 'bad label', sample_id, file, line, NOT is_issue AND label = 'unclear' FROM j UNION ALL SELECT 'bad dismissal_reason', sample_id, file, line, NOT is_issue AND dismissal_reason = 'because' FROM j) WHERE hit
UNION ALL SELECT 'duplicate anchor', sample_id, file, line FROM v_crows GROUP BY sample_id, file, line HAVING count(*) > 1"""))
def i17(spark, sf):
    return B.violations(*corpus_tables(spark, sf))


@query("i18_holdout_share", """
SELECT count(*) AS n_prs, count(*) FILTER (WHERE s = 'holdout') AS n_holdout, round(count(*) FILTER (WHERE s = 'holdout') / count(*), 6) AS share, count(*) FILTER (WHERE s = 'holdout') / count(*) BETWEEN 0.25 AND 0.35 AS ok
FROM (SELECT """ + SPLIT_SQL + " AS s FROM (SELECT sha256('acme/r' || (o_custkey % 7) || '#' || o_orderkey) AS h FROM orders))")
def i18(spark, sf):
    repo, k = F.concat(F.lit("acme/r"), (F.col("o_custkey") % 7).cast("string")), F.col("o_orderkey")
    prs = V.table(spark, sf, "orders").select(F.explode(F.array(X.sample_id(repo, k, "pre"), X.sample_id(repo, k, "final"))).alias("sample_id"), X.split_for(repo, k).alias("split"))
    return B.holdout_share(prs).withColumn("share", F.round("share", 6))


@query("i19_corpus_counts", V.sql_with("v_prs", "SELECT repo, split, count(*) AS n, count(*) FILTER (WHERE kind = 'positive') AS n_positive FROM v_prs GROUP BY ROLLUP (repo, split)"))
def i19(spark, sf):
    return B.corpus_counts(corpus_tables(spark, sf)[0])


@query("i19_issue_counts", V.sql_with("v_prs v_crows", "SELECT split, severity_class, label AS category, count(*) AS n FROM v_crows r JOIN v_prs p ON r.sample_id = p.sample_id WHERE is_issue AND o_orderkey % 101 <> 0 GROUP BY ALL"))
def i19_issues(spark, sf):
    prs, issues, _ = corpus_tables(spark, sf)
    return B.issue_counts(issues.withColumn("category", F.col("label")), prs)
