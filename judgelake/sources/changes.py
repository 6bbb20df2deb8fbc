"""Change documents (before and after texts) and unified diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from judgelake import constants as K

DOCUMENT_SCHEMA = "head string, repo string, files array<struct<path:string,old_path:string,before:string,after:string>>"


def read_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """doc_id (file and position), head, repo, files, damaged; a document is a line, or with
    ``multi_line`` a file.  Damaged documents keep their text in ``_corrupt_record``."""
    raw = spark.read.text(path, wholetext=multi_line).filter("trim(value) <> ''")
    doc_id = F.concat_ws("#", F.col("_metadata.file_path"), F.monotonically_increasing_id().cast("string"))
    return parse_documents(raw.select(doc_id.alias("doc_id"), "value"), keep_text=True)


def _problem(file: Column) -> Column:
    """What is wrong with the keys of a file entry (a variant); null if nothing is."""
    def kind(name):
        return F.schema_of_variant(F.try_variant_get(file, f"$.{name}", "variant"))

    out = F.lit(None).cast("string")
    for name, needed, empty in (("old_path", False, True), ("after", True, True), ("before", True, True), ("path", True, False)):
        k = kind(name)
        typed = k.isNull() | (k == "STRING") | (F.lit(empty) & (k == "VOID"))
        out = F.when(~typed, f"{name} must be a string").when(F.lit(needed) & k.isNull(), f"{name} is missing").otherwise(out)
    return out


def parse_documents(lines: DataFrame, key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Documents held as JSON text in ``value``; ``damaged`` marks what is no JSON.

    ``problems`` has, by file, an absent key or a value that is no string: the typed
    fields cannot tell those from null and from text.
    """
    doc = F.from_json("value", f"{DOCUMENT_SCHEMA}, _corrupt_record string",
                      {"columnNameOfCorruptRecord": "_corrupt_record", "allowNonNumericNumbers": "false"})
    entries = F.try_variant_get(F.try_parse_json("value"), "$.files", "array<variant>")
    damaged = F.col("d._corrupt_record").isNotNull()
    text = [F.when(damaged, F.col("value")).alias("_corrupt_record")] if keep_text else []
    return lines.select(key, "value", doc.alias("d"), F.transform(entries, _problem).alias("problems")).select(
        key, "d.head", "d.repo", "d.files", "problems", damaged.alias("damaged"), *text)


def explode_files(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per file entry, with its ``problem``; the default repo label is 'input'."""
    problems = F.col("problems") if "problems" in documents.columns else F.array().cast("array<string>")
    return documents.select(key, "head", F.coalesce("repo", F.lit("input")).alias("repo"), problems.alias("problems"),
                            F.posexplode("files").alias("file_idx", "f")).select(
        key, "head", "repo", "file_idx", "f.path", "f.old_path", "f.before", "f.after", F.get("problems", "file_idx").alias("problem"))


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """One diff per file: change_id (the file) and diff_text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("change_id"), F.col("value").alias("diff_text"))


def _section(text: Column) -> Column:
    """What the head lines in ``text`` say of the file of the next hunks; ``text`` starts a line.

    old: the first old path line, new: the last new path line, gone: the new side is absent.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\r+\z", ""))
    absent = r"^.{4}/dev/null(\t|\z)"
    old = F.filter(lines, lambda x: x.startswith("--- ") & ~x.rlike(absent))
    new = F.filter(lines, lambda x: x.startswith("+++ "))
    return F.struct(F.get(old, F.lit(0)).alias("old"), F.try_element_at(F.filter(new, lambda x: ~x.rlike(absent)), F.lit(-1)).alias("new"),
                    F.exists(new, lambda x: x.rlike(absent)).alias("gone"))


def _tail(text: Column) -> Column:
    """The section that a hunk without a git header leaves open: the first header line after
    the counts of the hunk are used up, and all lines from there; null if there is none."""
    lines = F.split(text, "\n", -1)
    head = F.get(lines, F.lit(0))

    def count(group):
        g = F.regexp_extract(head, K.HUNK_HEADER_PATTERN, group)
        return F.when(head.rlike(K.HUNK_HEADER_PATTERN), F.coalesce(g.try_cast("int"), F.lit(1))).otherwise(0)

    def step(acc, x):
        opens = (acc["at"] < 0) & (acc["old"] <= 0) & (acc["new"] <= 0) & (x.startswith("--- ") | x.startswith("+++ "))
        plus, minus = x.startswith("+"), x.startswith("-")
        neither = x.startswith("\\")
        return F.struct((acc["old"] - F.when(plus | neither, 0).otherwise(1)).alias("old"), (acc["new"] - F.when(minus | neither, 0).otherwise(1)).alias("new"),
                        (acc["i"] + 1).alias("i"), F.when(opens, acc["i"]).otherwise(acc["at"]).alias("at"))

    start = F.struct(count(2).alias("old"), count(4).alias("new"), F.lit(1).alias("i"), F.lit(-1).alias("at"))
    at = F.aggregate(F.slice(lines, 2, F.size(lines)), start, step, lambda acc: acc["at"])
    return F.when(at >= 0, _section(F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n")))


def read_diff_hunks(spark: SparkSession, path: str) -> DataFrame:
    """The hunks of diff files: change_id (the file), hunk_no, first_pos, diff_text.

    Files are read in splits, a record per line that starts a hunk; no task holds more than
    a split, no cell more than a hunk and the head of the next file.  Which file a hunk
    belongs to is said by the last head before it: heads and line counts are carried from
    record to record within a split, and from split to split by one row each.
    ``diff_text`` is the hunk below that head; ``first_pos`` makes its lines count on
    through the diff.  Compressed files are one split.
    """
    raw = spark.read.option("lineSep", "\n@@").text(path).select(
        F.col("_metadata.file_path").alias("change_id"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value")
    inside = Window.partitionBy("change_id", "split").orderBy("at")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    text = F.when((F.col("split") == 0) & (F.col("nth") == 1), F.col("value")).otherwise(F.concat(F.lit("@@"), F.col("value")))
    rows = raw.withColumn("nth", F.row_number().over(inside)).withColumn("text", text).drop("value")
    below = F.concat(F.lit("\n"), "text")
    git = F.when(below.contains("\ndiff --git "), F.substring_index(below, "\ndiff --git ", -1))
    looks = F.col("text").contains("\n--- ") | F.col("text").contains("\n+++ ")
    state = F.when(git.isNotNull(), _section(git)).when(~F.col("text").startswith("@@"), _section(F.col("text"))).when(looks, _tail(F.col("text")))
    rows = rows.withColumn("n", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")).withColumn("opens", state)
    rows = rows.withColumns({"lines": F.coalesce(F.sum("n").over(before), F.lit(0)), "head": F.last("opens", ignorenulls=True).over(before)})
    splits = rows.groupBy("change_id", "split").agg(F.max("nth").alias("records"), F.sum("n").alias("all"), F.max_by("opens", F.when(F.col("opens").isNotNull(), F.col("at"))).alias("last"))
    order = Window.partitionBy("change_id").orderBy("split")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "change_id", "split", "records", (F.lead("split").over(order).isNull()).alias("ends"), F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("records_before"),
        F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("lines_before"), F.last("last", ignorenulls=True).over(earlier).alias("head_before"))
    joined = rows.join(splits, ["change_id", "split"]).withColumn("head", F.coalesce("head", "head_before"))
    heads = F.filter(F.array(F.col("head.old"), F.when(F.col("head.gone"), F.lit("+++ /dev/null")), F.col("head.new")), lambda x: x.isNotNull())
    # only the end of the file is the end of a line, not the start of an empty one
    kept = F.when(F.col("ends") & (F.col("nth") == F.col("records")), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    return joined.select(
        "change_id", (F.col("records_before") + F.col("nth") - 1).cast("int").alias("hunk_no"),
        (F.col("lines_before") + F.col("lines") - F.size(heads)).alias("first_pos"), F.array_join(F.concat(heads, F.array(kept)), "\n").alias("diff_text"))
