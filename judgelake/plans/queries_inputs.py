"""Registered queries: change documents to diffs."""

from pyspark.sql import functions as F

from judgelake.operators import inputs as N
from judgelake.operators import packaging as P
from judgelake.plans import views as V
from judgelake.plans.queries_packaging import code_lines
from judgelake.plans.registry import query
from judgelake.session import written

# Before and after texts of a document: the lines the diff rule keeps on each side.
# Every eleventh file is added, every ninth deleted, the docs are renames.
IMAGES_SQL = """
SELECT doc_id AS change_id, any_value(file) AS path, CASE WHEN doc_id % 10 = 7 AND doc_id % 11 <> 5 AND doc_id % 9 <> 8 THEN 'docs/old.md' END AS old_path,
  CASE WHEN doc_id % 11 <> 5 OR doc_id % 9 = 8 THEN coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (WHERE kind <> '+'), '') || CASE WHEN doc_id % 4 = 0 THEN '' ELSE chr(10) END END AS before,
  CASE WHEN doc_id % 9 <> 8 THEN coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (WHERE kind <> '-'), '') || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) END END AS after
FROM v_code GROUP BY doc_id
"""
V.VIEWS_SQL["v_images"] = (("v_code",), IMAGES_SQL)


def images(spark, sf):
    k = F.col("doc_id")

    def side(other):
        kept = F.sort_array(F.collect_list(F.when(F.col("kind") != other, F.struct("i", "text"))))
        return F.array_join(F.transform(kept, lambda e: e["text"]), "\n")

    f = code_lines(spark, sf).groupBy("doc_id").agg(F.first("file").alias("path"), side("+").alias("b"), side("-").alias("a"))
    added, gone = (k % 11 == 5) & (k % 9 != 8), k % 9 == 8
    # written, so that texts are put together once and not in every expression that reads them
    return written(f.select(k.alias("change_id"), "path", F.when((k % 10 == 7) & ~added & ~gone, "docs/old.md").alias("old_path"),
                    F.when(~added, F.concat("b", F.when(k % 4 == 0, "").otherwise("\n"))).alias("before"),
                    F.when(~gone, F.concat("a", F.when(k % 3 == 0, "").otherwise("\n"))).alias("after")), "images")


def _documents(spark, sf):
    """Two files a document, with broken ones of several kinds."""
    im = images(spark, sf)
    doc = F.floor(F.col("change_id") / 2)
    k = F.col("change_id")
    return im.select(
        doc.alias("doc_id"), F.when(doc % 31 == 3, "").otherwise("h").alias("head"), F.lit("input").alias("repo"), (k % 2).cast("int").alias("file_idx"),
        F.when(doc % 37 == 4, "same.py").when(k % 41 == 5, F.concat(F.lit("a\t"), "path")).when(k % 43 == 6, "\\dev\\null").otherwise(F.translate("path", "/", "\\")).alias("path"),
        F.when(k % 47 == 7, "").otherwise(F.col("old_path")).alias("old_path"),
        F.when(k % 53 == 8, None).otherwise(F.col("before")).alias("before"), F.when(k % 53 == 8, None).when(k % 59 == 9, F.col("before")).otherwise(F.col("after")).alias("after"))


DOCS_SQL = """
docs AS (SELECT change_id AS k, change_id // 2 AS doc_id, change_id % 2 AS file_idx, path, CASE WHEN change_id % 53 = 8 THEN NULL ELSE before END AS before,
  CASE WHEN change_id % 53 = 8 THEN NULL WHEN change_id % 59 = 9 THEN before ELSE after END AS after, CASE WHEN change_id % 47 = 7 THEN '' ELSE old_path END AS old_path FROM v_images),
faults AS (SELECT *, CASE WHEN doc_id % 37 <> 4 AND k % 41 = 5 THEN 'path contains a control character' WHEN doc_id % 37 <> 4 AND k % 43 = 6 THEN 'path must not be /dev/null' WHEN old_path = '' THEN 'must not be empty'
  WHEN doc_id % 37 = 4 AND file_idx = 1 THEN 'duplicate path' WHEN before IS NULL AND after IS NULL THEN 'before and after are both null' END AS fault FROM docs),
errs AS (SELECT doc_id, CASE WHEN doc_id % 31 = 3 THEN 'must not be empty' ELSE arg_min(fault, file_idx) FILTER (WHERE fault IS NOT NULL) END AS error,
  CASE WHEN doc_id % 31 <> 3 THEN CAST(min(file_idx) FILTER (WHERE fault IS NOT NULL) AS INTEGER) END AS file_idx FROM faults GROUP BY doc_id HAVING doc_id % 31 = 3 OR count(fault) > 0)
"""


@query("c1_validate_changes", V.sql_with("v_images", "WITH " + DOCS_SQL.strip() + """
SELECT doc_id, CAST(file_idx AS INTEGER) AS file_idx, CASE WHEN doc_id % 37 = 4 THEN 'same.py' ELSE path END AS path, CASE WHEN status = 'renamed' THEN old_path END AS old_path, status FROM (
  SELECT *, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'deleted' WHEN old_path IS NOT NULL THEN 'renamed' WHEN before <> after THEN 'modified' END AS status FROM faults
  WHERE doc_id NOT IN (SELECT doc_id FROM errs)) WHERE status IS NOT NULL"""))
def c1(spark, sf):
    return N.validate_changes(_documents(spark, sf))[0].select("doc_id", "file_idx", "path", "old_path", "status")


@query("c1_document_errors", V.sql_with("v_images", "WITH " + DOCS_SQL.strip() + " SELECT * FROM errs"))
def c1_errors(spark, sf):
    return N.validate_changes(_documents(spark, sf))[1]


INPUT_REASON = """CASE WHEN change_id % 17 = 1 THEN CASE WHEN path LIKE '%.md' THEN 'docs/generated/lockfile' ELSE 'input-binary' END
  WHEN coalesce(len(string_split(before, chr(10))) - CASE WHEN before LIKE '%' || chr(10) THEN 1 ELSE 0 END, 0) > 20 OR coalesce(len(string_split(after, chr(10))) - CASE WHEN after LIKE '%' || chr(10) THEN 1 ELSE 0 END, 0) > 20
    THEN CASE WHEN path LIKE '%.md' THEN 'docs/generated/lockfile' WHEN after IS NULL THEN 'whole-file-deleted>cap' ELSE 'hunk>input-oversize' END END"""


def _triaged(spark, sf):
    im = images(spark, sf)
    nul = F.when(F.col("change_id") % 17 == 1, "\x00").otherwise("")
    return N.triage_inputs(im.withColumn("before", F.concat("before", nul)).withColumn("after", F.concat("after", nul)), max_lines=20)


@query("c2_triage_inputs", V.sql_with("v_images", f"SELECT change_id, {INPUT_REASON} AS reason FROM v_images"))
def c2(spark, sf):
    return _triaged(spark, sf).select("change_id", "reason")


@query("c2_input_skips", V.sql_with("v_images", f"""
SELECT change_id, path AS file, reason, CASE WHEN reason LIKE 'whole%' THEN 'whole-file-deleted' END AS change_type, 1 AS line_start, 1 AS line_end
FROM (SELECT *, {INPUT_REASON} AS reason FROM v_images) WHERE reason IS NOT NULL"""))
def c2_skips(spark, sf):
    return N.input_skips(_triaged(spark, sf), "change_id")


SIDES = """
a AS (SELECT change_id, unnest(string_split(before, chr(10))) AS ln, generate_subscripts(string_split(before, chr(10)), 1) AS i, len(string_split(before, chr(10))) AS n, before FROM v_images WHERE before <> ''),
b AS (SELECT change_id, unnest(string_split(after, chr(10))) AS ln, generate_subscripts(string_split(after, chr(10)), 1) AS i, len(string_split(after, chr(10))) AS n, after FROM v_images WHERE after <> ''),
la AS (SELECT change_id, i, ln || CASE WHEN i < n THEN chr(10) ELSE '' END AS ln, CASE WHEN before LIKE '%' || chr(10) THEN n - 1 ELSE n END AS n FROM a WHERE i < n OR ln <> ''),
lb AS (SELECT change_id, i, ln || CASE WHEN i < n THEN chr(10) ELSE '' END AS ln, CASE WHEN after LIKE '%' || chr(10) THEN n - 1 ELSE n END AS n FROM b WHERE i < n OR ln <> ''),
size AS (SELECT change_id, coalesce(any_value(la.n), 0) AS na, coalesce(any_value(lb.n), 0) AS nb FROM v_images LEFT JOIN la USING (change_id) LEFT JOIN lb USING (change_id) GROUP BY change_id),
pre AS (SELECT s.change_id, na, nb, coalesce(min(la.i) FILTER (WHERE la.ln <> lb.ln) - 1, least(na, nb)) AS lo FROM size s LEFT JOIN la USING (change_id) LEFT JOIN lb ON lb.change_id = s.change_id AND lb.i = la.i GROUP BY s.change_id, na, nb),
post AS (SELECT p.change_id, na, nb, lo, least(coalesce(min(la.n - la.i) FILTER (WHERE la.ln <> lb.ln), least(na, nb)), least(na, nb) - lo) AS hi
  FROM pre p LEFT JOIN la USING (change_id) LEFT JOIN lb ON lb.change_id = p.change_id AND nb - lb.i = na - la.i GROUP BY p.change_id, na, nb, lo)"""


@query("c3_common_ends", V.sql_with("v_images", "WITH " + SIDES.strip() + " SELECT change_id, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM post"))
def c3(spark, sf):
    return N.with_cores(images(spark, sf)).select("change_id", "lo", "hi")


PAIRS_SQL = """,
ca AS (SELECT la.change_id, i - lo - 1 AS i, ln FROM la JOIN post USING (change_id) WHERE i > lo AND i <= na - hi), cb AS (SELECT lb.change_id, i - lo - 1 AS i, ln FROM lb JOIN post USING (change_id) WHERE i > lo AND i <= nb - hi),
pairs AS (SELECT change_id, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j FROM (SELECT change_id, ln, min(i) AS i FROM ca GROUP BY change_id, ln HAVING count(*) = 1) a JOIN (SELECT change_id, ln, min(i) AS i FROM cb GROUP BY change_id, ln HAVING count(*) = 1) b USING (change_id, ln))"""


@query("c4_unique_pairs", V.sql_with("v_images", "WITH " + SIDES.strip() + PAIRS_SQL + " SELECT * FROM pairs"))
def c4(spark, sf):
    return N.unique_pairs(N.with_cores(images(spark, sf)))


@query("c4_anchor_chain", V.sql_with("v_images", "WITH " + SIDES.strip() + PAIRS_SQL + """,
lis(change_id, i, j, len) AS (SELECT change_id, i, j, 1 FROM pairs UNION SELECT p.change_id, p.i, p.j, l.len + 1 FROM lis l JOIN pairs p ON p.change_id = l.change_id AND p.i > l.i AND p.j > l.j)
SELECT change_id, CAST(max(len) AS BIGINT) AS n_anchors FROM lis GROUP BY change_id""", recursive=True))
def c4_chain(spark, sf):
    return N.anchor_chain(N.unique_pairs(N.with_cores(images(spark, sf)))).groupBy("change_id").agg(F.count(F.lit(1)).alias("n_anchors"))


def _rebuilt(spark, sf):
    """Apply each synthesised diff to its before text."""
    im = images(spark, sf)
    entries = written(P.parse_diff(N.changes_to_diffs(im)).filter("kind <> ' '").select("change_id", "kind", "old_line", "old_at", "pos", "text"), "entries")
    old = im.select("change_id", F.posexplode(F.split(F.regexp_replace(F.coalesce("before", F.lit("")), "\n$", ""), "\n")).alias("p", "text"), "before").filter(
        "before is not null and before <> ''").select("change_id", (F.col("p") + 1).alias("old_line"), "text")
    gone = entries.filter("kind = '-'").select("change_id", "old_line")
    stay = old.join(gone, ["change_id", "old_line"], "left_anti").select("change_id", F.struct(F.col("old_line").cast("int").alias("at"), F.lit(1).alias("z"), F.lit(0).alias("p")).alias("o"), "text")
    new = entries.filter("kind = '+'").select("change_id", F.struct(F.col("old_at").alias("at"), F.lit(0).alias("z"), F.col("pos").cast("int").alias("p")).alias("o"), "text")
    both = stay.unionByName(new).groupBy("change_id").agg(F.sort_array(F.collect_list(F.struct("o", "text"))).alias("t"))
    return im.select("change_id").join(both, "change_id", "left").select(
        "change_id", F.coalesce(F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n")), F.lit("")).alias("after_md5"))


REBUILT = "SELECT change_id, CASE WHEN coalesce(after, '') IN ('', chr(10)) AND NOT coalesce(after = chr(10), FALSE) THEN '' ELSE md5(regexp_replace(after, '\\n$', '')) END AS after_md5 FROM v_images"


@query("c5_edits_rebuild", V.sql_with("v_images", REBUILT))
def c5(spark, sf):
    return _rebuilt(spark, sf)


@query("c7_diff_rebuild", V.sql_with("v_images", REBUILT))
def c7(spark, sf):
    return _rebuilt(spark, sf)


@query("c6_hunks")
def c6(spark, sf):
    cores = N.with_cores(images(spark, sf))
    return N.hunks(N.edits(cores)).groupBy("change_id", "hunk").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("i1").alias("i1"), F.max("i2").alias("i2"))
