"""The run ledger: JSON records, one per run, appended over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JUDGED_SCHEMA = (
    "file string, line int, line_start int, line_end int, severity double, is_real double, category string, "
    "confidence double, rubric string, references_remaining boolean, change_type string, enrichment string, "
    "reflex_class string, parent_declaration string, cut string, reported boolean")

# Counts that a gate must tell from booleans and fractions are read as strings.
RUN_SCHEMA = (
    "label string, repo string, mode string, head string, n_hunks int, n_analyzed int, verdict string, base_verdict string, "
    "n_dropped string, n_unjudged string, n_size_skipped_code string, n_input_autojunk int, fail_open boolean, fail_reason string, "
    f"total_latency_ms double, avg_call_ms double, avg_input_tokens double, judged array<struct<{JUDGED_SCHEMA.replace(' ', ':').replace(',:', ',')}>>, "
    "transport string, wire_format string, enrichment string, record_version string, packaging_version string, status string, "
    "wheels map<string,struct<available:boolean,version:string>>, tool_version string, provider string, model string, "
    "fixture string, fixture_head string, "
    "findings array<struct<file:string,line:int,severity:double,is_real:double,category:string,header:string>>, "
    "jitter array<struct<file:string,is_real:double>>, "
    "pr_level struct<overall_risk:double,needs_human_review:double,latency_ms:double,error:string>, ts timestamp")


# ISO-8601 with microseconds, as the records carry it.
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Run records with their file and ``position`` in it (start of the split, then order of
    its records); a record that is no JSON keeps its text in ``_corrupt_record``.  Blank
    lines are ignored by the reader."""
    schema = f"{RUN_SCHEMA}, _corrupt_record string"
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("record"))
    return spark.read.schema(schema).json(path, mode="PERMISSIVE").withColumn("source_file", F.col("_metadata.file_path")).withColumn("position", at)


def with_judged_size(runs: DataFrame) -> DataFrame:
    """Size of the judged array, null when the record has none."""
    return runs.withColumn("judged_size", F.when(F.col("judged").isNotNull(), F.size("judged").cast("bigint")))


def explode_judged(runs: DataFrame, *keep: str) -> DataFrame:
    """One row per judged unit: kept run columns, ``ord`` and the unit fields."""
    cols = keep or ("label",)
    return runs.select(*cols, F.posexplode("judged").alias("ord", "unit")).select(*cols, "ord", "unit.*")


def latest_by_label(runs: DataFrame, order: tuple[str, ...] = ("ts",), key: str = "label") -> DataFrame:
    """The last record of each label.  Records of equal ``order`` are told apart by file and
    position where the rows have them.  Ranks are cut on the map side first, so a label
    that was appended very often costs one row per task in the shuffle."""
    ties = [c for c in ("source_file", "position") if c in runs.columns and c not in order]
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in (*order, *ties)])
    return runs.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def append_ledger(runs: DataFrame, path: str, stamp: bool = True) -> None:
    """Append records, stamped with the current time, partitioned by day."""
    stamped = runs.withColumn("ts", F.current_timestamp()) if stamp else runs
    stamped.withColumn("dt", F.to_date("ts")).withColumn("ts", F.col("ts").cast("timestamp")).write.mode(
        "append").partitionBy("dt").json(path, timestampFormat=TS_FORMAT)


def select_split(samples: DataFrame, split: str) -> DataFrame:
    return samples if split == "all" else samples.filter(F.col("split") == split)


def select_prefix(runs: DataFrame, prefix: str) -> DataFrame:
    return runs.filter(F.col("label").startswith(prefix))


def report_skips(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """Skip records of the run reports (label, skipped array) that have a ledger record."""
    rows = reports.select("label", F.posexplode("skipped").alias("ord", "s")).select("label", "ord", "s.*")
    return rows.join(runs.select("label"), "label", "left_semi")
