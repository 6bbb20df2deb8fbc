"""Judge-shaped views derived from the driver tables, for Spark and as check SQL.

Each view reads whole tables.  ``events`` plays the ledger: a user is one run of
a sample, an event is one judged unit, its ``k`` the line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions.paths import reflex_class


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    user, eid = F.col("user_id"), F.col("event_id")
    line = F.regexp_extract("props", "([0-9]+)", 1).cast("int") + 1
    file = F.when(F.col("event_type") == "view", "tests/view.py").otherwise(
        F.concat(F.lit("src/"), F.col("event_type"), F.lit(".py")))
    rubric = F.when(eid % 5 == 0, "deletion").otherwise("code-change")
    return (e.select(
        F.concat(F.lit("s"), (user % 30).cast("string"), F.lit(":r"), (F.floor(user / 30) + 1).cast("string")).alias("run_id"),
        (user % 30).cast("int").alias("sample_id"), (F.floor(user / 30) + 1).cast("int").alias("repeat"),
        eid.alias("ord"), file.alias("file"), line.alias("line"),
        F.greatest(F.lit(1), line - (eid % 3).cast("int")).alias("line_start"),
        (line + (eid % 4).cast("int")).alias("line_end"),
        F.when(eid % 53 != 0, (eid % 31) / F.lit(10.0)).alias("severity"),
        F.when(eid % 97 != 0, F.floor(F.least(F.col("value"), F.lit(100.0))) / F.lit(100.0)).alias("is_real"),
        F.when(eid % 7 < 6, _pick(K.CATEGORIES, F.least(eid % 7, F.lit(5)))).alias("category"),
        ((eid % 11) / F.lit(10.0)).alias("confidence"),
        rubric.alias("rubric"),
        F.when(eid % 5 == 0, eid % 2 == 0).alias("references_remaining"),
        F.when(eid % 5 == 0, F.when(eid % 10 == 0, "deletion-only").otherwise("whole-file-deleted"))
        .otherwise("code-change").alias("change_type"),
        F.when(eid % 3 == 0, "ast").when(eid % 3 == 1, "ts-ast").otherwise("none").alias("enrichment"),
        F.concat(F.lit("fn"), F.floor(line / 20).cast("string")).alias("parent_declaration"),
        F.col("ts"), F.col("value"))
        .withColumn("reflex_class", reflex_class(F.col("file"))))


JUDGED_SQL = """
SELECT 's' || (user_id % 30) || ':r' || (user_id // 30 + 1) AS run_id,
  CAST(user_id % 30 AS INTEGER) AS sample_id, CAST(user_id // 30 + 1 AS INTEGER) AS repeat,
  event_id AS ord,
  CASE WHEN event_type = 'view' THEN 'tests/view.py' ELSE 'src/' || event_type || '.py' END AS file,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) + 1 AS line,
  CAST(greatest(1, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) + 1 - event_id % 3) AS INTEGER) AS line_start,
  CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) + 1 + event_id % 4 AS INTEGER) AS line_end,
  CASE WHEN event_id % 53 <> 0 THEN (event_id % 31) / 1e1 END AS severity,
  CASE WHEN event_id % 97 <> 0 THEN floor(least(value, 1e2)) / 1e2 END AS is_real,
  CASE event_id % 7 WHEN 0 THEN 'bug-risk' WHEN 1 THEN 'security' WHEN 2 THEN 'style'
    WHEN 3 THEN 'performance' WHEN 4 THEN 'test-gap' WHEN 5 THEN 'other' END AS category,
  (event_id % 11) / 1e1 AS confidence,
  CASE WHEN event_id % 5 = 0 THEN 'deletion' ELSE 'code-change' END AS rubric,
  CASE WHEN event_id % 5 = 0 THEN event_id % 2 = 0 END AS references_remaining,
  CASE WHEN event_id % 10 = 0 THEN 'deletion-only' WHEN event_id % 5 = 0 THEN 'whole-file-deleted'
    ELSE 'code-change' END AS change_type,
  CASE event_id % 3 WHEN 0 THEN 'ast' WHEN 1 THEN 'ts-ast' ELSE 'none' END AS enrichment,
  'fn' || ((CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) + 1) // 20) AS parent_declaration,
  ts, value,
  CASE WHEN event_type = 'view' THEN 'test' ELSE 'code' END AS reflex_class
FROM events
"""


def golden(spark: SparkSession, sf_dir: str, j: DataFrame | None = None) -> DataFrame:
    """Labelled lines of the positive samples, taken from their first run."""
    j = (judged(spark, sf_dir) if j is None else j).filter((F.col("repeat") == 1) & (F.col("sample_id") % 3 != 0)
                                     & (F.col("file") == "src/error.py") & (F.col("ord") % 2 == 0))
    return j.select("sample_id", F.col("ord").alias("golden_idx"), "file",
                    (F.col("line") + (F.col("ord") % 3).cast("int") - 1).alias("line"),
                    _pick(K.SEVERITY_CLASSES, F.col("ord") % 3).alias("severity_class"),
                    F.coalesce("category", F.lit("other")).alias("category"))


GOLDEN_SQL = """
SELECT sample_id, ord AS golden_idx, file, CAST(line + ord % 3 - 1 AS INTEGER) AS line,
  CASE ord % 3 WHEN 0 THEN 'blocker' WHEN 1 THEN 'major' ELSE 'minor' END AS severity_class,
  coalesce(category, 'other') AS category
FROM v_judged WHERE repeat = 1 AND sample_id % 3 <> 0 AND file = 'src/error.py' AND ord % 2 = 0
"""


def dismissed(spark: SparkSession, sf_dir: str, j: DataFrame | None = None) -> DataFrame:
    """Dismissed lines: first-run click units of every sample."""
    j = (judged(spark, sf_dir) if j is None else j).filter((F.col("repeat") == 1) & (F.col("file") == "src/click.py")
                                     & (F.col("ord") % 4 == 1))
    return j.select("sample_id", F.col("ord").alias("dismissed_idx"), "file",
                    (F.col("line") + 1).alias("line"))


DISMISSED_SQL = """
SELECT sample_id, ord AS dismissed_idx, file, line + 1 AS line
FROM v_judged WHERE repeat = 1 AND file = 'src/click.py' AND ord % 4 = 1
"""


def runs(spark: SparkSession, sf_dir: str, j: DataFrame | None = None) -> DataFrame:
    """One ledger record per user."""
    j = judged(spark, sf_dir) if j is None else j
    n = F.col("sample_id") * 7 + F.col("repeat")
    return (j.groupBy("run_id", "sample_id", "repeat").agg(
        F.count(F.lit(1)).alias("n_analyzed"), F.max("ts").alias("ts"),
        F.sum(F.floor("value").cast("bigint")).cast("double").alias("total_latency_ms"))
        .withColumn("label", F.concat(F.lit("corpus:v08:"), F.lit("acme/repo"), (F.col("sample_id") % 4).cast("string"),
                                      F.lit("#"), F.col("sample_id").cast("string"), F.lit("@pre:r"), F.col("repeat").cast("string")))
        .withColumn("kind", F.when(F.col("sample_id") % 3 == 0, "clean").otherwise("positive"))
        .withColumn("repo", F.concat(F.lit("acme/repo"), (F.col("sample_id") % 4).cast("string")))
        .withColumn("fail_open", n % 23 == 0)
        .withColumn("provider", F.lit("hosted")))


RUNS_SQL = """
SELECT run_id, sample_id, repeat, count(*) AS n_analyzed, max(ts) AS ts,
  CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) AS total_latency_ms,
  'corpus:v08:acme/repo' || (sample_id % 4) || '#' || sample_id || '@pre:r' || repeat AS label,
  CASE WHEN sample_id % 3 = 0 THEN 'clean' ELSE 'positive' END AS kind,
  'acme/repo' || (sample_id % 4) AS repo,
  (sample_id * 7 + repeat) % 23 = 0 AS fail_open, 'hosted' AS provider
FROM v_judged GROUP BY run_id, sample_id, repeat
"""


def samples(spark: SparkSession, sf_dir: str, r: DataFrame | None = None) -> DataFrame:
    r = runs(spark, sf_dir) if r is None else r
    return r.groupBy("sample_id").agg(F.first("kind").alias("kind"), F.first("repo").alias("repo"))


SAMPLES_SQL = "SELECT DISTINCT sample_id, kind, repo FROM v_runs"


def skipped(spark: SparkSession, sf_dir: str, j: DataFrame | None = None) -> DataFrame:
    """Skip records of each run: purchase units, with and without a line span."""
    j = (judged(spark, sf_dir) if j is None else j).filter(F.col("file") == "src/purchase.py")
    eid = F.col("ord")
    reason = (F.when(eid % 9 < 2, "max-hunks>ceiling").when(eid % 9 < 4, "hunk>120 lines")
              .when(eid % 9 < 6, "data/snapshot").otherwise("docs/generated/lockfile"))
    keep = eid % 2 == 0
    return j.select("run_id", "sample_id", "repeat", "ord",
                    F.when(eid % 9 == 8, "src/signup.py").when(eid % 9 == 1, "src/error.py").otherwise(F.col("file")).alias("file"),
                    reason.alias("reason"),
                    "change_type", F.when(keep, F.col("line_start")).alias("line_start"),
                    F.when(keep, F.col("line_end")).alias("line_end"))


SKIPPED_SQL = """
SELECT run_id, sample_id, repeat, ord,
  CASE ord % 9 WHEN 8 THEN 'src/signup.py' WHEN 1 THEN 'src/error.py' ELSE file END AS file,
  CASE WHEN ord % 9 < 2 THEN 'max-hunks>ceiling' WHEN ord % 9 < 4 THEN 'hunk>120 lines'
    WHEN ord % 9 < 6 THEN 'data/snapshot' ELSE 'docs/generated/lockfile' END AS reason,
  change_type, CASE WHEN ord % 2 = 0 THEN line_start END AS line_start,
  CASE WHEN ord % 2 = 0 THEN line_end END AS line_end
FROM v_judged WHERE file = 'src/purchase.py'
"""

PATHS_SQL = """
SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')
  || CASE page_id % 16 WHEN 0 THEN '.md' WHEN 1 THEN '/package-lock.json' WHEN 2 THEN '.test.ts'
     WHEN 3 THEN '/data.CSV' WHEN 4 THEN '/dist/app.js' WHEN 5 THEN '/__tests__/util.py'
     WHEN 6 THEN '/app.min.js' WHEN 7 THEN '/.min.js/a.js' WHEN 8 THEN '/test_mod.py'
     WHEN 9 THEN '/mod_test.go' WHEN 10 THEN '/conftest.py' WHEN 11 THEN '/snap.SNAP'
     WHEN 12 THEN '/.gitignore' WHEN 13 THEN '/e2e/flow.spec.tsx' ELSE '/src/main.py' END AS path
FROM pages
"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = [".md", "/package-lock.json", ".test.ts", "/data.CSV", "/dist/app.js", "/__tests__/util.py",
             "/app.min.js", "/.min.js/a.js", "/test_mod.py", "/mod_test.go", "/conftest.py", "/snap.SNAP",
             "/.gitignore", "/e2e/flow.spec.tsx", "/src/main.py", "/src/main.py"]
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(bare, _pick(tails, F.col("page_id") % 16)).alias("path"))


VIEWS_SQL = {
    "v_judged": ((), JUDGED_SQL),
    "v_golden": (("v_judged",), GOLDEN_SQL),
    "v_dismissed": (("v_judged",), DISMISSED_SQL),
    "v_runs": (("v_judged",), RUNS_SQL),
    "v_samples": (("v_runs",), SAMPLES_SQL),
    "v_skipped": (("v_judged",), SKIPPED_SQL),
    "v_paths": ((), PATHS_SQL),
}


def sql_with(names: str, body: str, recursive: bool = False) -> str:
    """Check SQL with the named views as common table expressions in front."""
    order: list[str] = []

    def add(name: str) -> None:
        deps, _ = VIEWS_SQL[name]
        for d in deps:
            add(d)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    views = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS_SQL[n][1].strip()})" for n in order)
    body = body.strip()
    more = ",\n" + body[len("WITH "):] if body.startswith("WITH ") else "\n" + body
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{more}"
