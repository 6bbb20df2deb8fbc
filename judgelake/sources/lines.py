"""Line files: TSV tables, JSONL, golden files, sha maps.

Parsers take a table of lines (path, line_no, value) so that they serve files and
derived lines alike.  Bad lines go to a second DataFrame, which ``require_empty`` turns
into an error.  Readers and writers of files are strict inside their one pass: a bad
row fails the action that meets it and is named in the error.  ``tsv_rejects`` and
``jsonl_rejects`` list all bad rows of a file, with their lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions.paths import extension


class RejectedRows(ValueError):
    """A source holds rows that break its format."""


def require_empty(rejects: DataFrame, what: str) -> None:
    """Raise with the first rejected rows, if there are any."""
    first = rejects.limit(5).collect()
    if first:
        raise RejectedRows(f"{what}: " + "; ".join(str(r.asDict()) for r in first))


def strict(skip: Column, fits: Column, error: Column) -> Column:
    """A filter that drops rows to skip, keeps those that fit and fails at any other.

    It stands in a filter, so neither a count nor a narrow selection loses it; nulls of
    ``skip`` and ``fits`` count as false.
    """
    return F.when(skip, F.lit(False)).when(fits, F.lit(True)).otherwise(F.raise_error(error).cast("boolean"))


def read_lines(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """path, block, seq, value: (block, seq) orders the lines of a file."""
    try:
        raw = spark.read.text(path)
    except AnalysisException as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "path string, block bigint, seq bigint, value string")
        raise
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("seq"), "value")


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds the 1-based ``line_no``.  Lines are ranked inside their file block and
    shifted by the sizes of the blocks before, so no file is gathered in one task."""
    in_block = lines.withColumn("r", F.row_number().over(Window.partitionBy("path", "block").orderBy("seq")))
    sizes = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return in_block.join(shift, ["path", "block"]).select("path", (F.col("r") + F.col("shift")).alias("line_no"), "value")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def _tsv_cells(columns: Sequence[str]) -> tuple[Column, Column, Column, Column]:
    """The cells of a line, whether it is no data, whether it fits, and what is wrong if not."""
    cells = F.split("value", "\t", -1)
    skip = (F.col("value") == "") | F.col("value").startswith("#") | (F.col("value") == "\t".join(columns))
    return cells, skip, F.size(cells) == len(columns), F.concat(F.lit(f"expected {len(columns)} columns, got "), F.size(cells).cast("string"))


def parse_tsv(lines: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects).  Blank, comment and header lines are skipped; quotes are data."""
    cells, skip, fits, error = _tsv_cells(columns)
    kept = lines.filter(~skip)
    rows = kept.filter(fits).select("path", "line_no", *[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(columns)])
    return rows, kept.filter(~fits).select("path", "line_no", error.alias("error"))


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str], missing_ok: bool = False) -> DataFrame:
    """The rows of a file in one scan without a shuffle; a row of another arity fails the action."""
    cells, skip, fits, error = _tsv_cells(columns)
    named = F.concat(F.col("path"), F.lit(": "), error, F.lit(": "), "value")
    return read_lines(spark, path, missing_ok).select("path", "value").filter(strict(skip, fits, named)).select(
        *[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def tsv_rejects(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(path, line_no, error) of the rows that fail ``read_tsv``."""
    return parse_tsv(number_lines(read_lines(spark, path)), columns)[1]


def _tsv_line(columns: Sequence[str]) -> tuple[Column, Column]:
    """The line of a row and whether a value breaks it."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    bad = F.lit(False)
    for c in cells:
        bad = bad | c.rlike("[\\t\\n]")
    return F.concat_ws("\t", *cells), bad


def encode_tsv(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(value lines, rows holding a tab or newline in a value)."""
    line, bad = _tsv_line(columns)
    return rows.filter(~bad).select(line.alias("value")), rows.filter(bad)


BROKEN_CELL = "tab or newline in a TSV value"


def write_tsv(rows: DataFrame, path: str, columns: Sequence[str], comment: str = "") -> None:
    """Body files plus one head file of comment lines and the header, in one folder.

    The head carries the names; a reader of the folder skips it wherever it is read.  Rows
    are evaluated once: a value that would break its line fails the write, which then
    leaves no head and no body, and only then are the first such rows looked up.
    """
    line, bad = _tsv_line(columns)
    body = rows.filter(strict(F.lit(False), ~bad, F.lit(BROKEN_CELL))).select(line.alias("value"))
    try:
        body.write.mode("overwrite").text(path)
    except Exception as e:
        if BROKEN_CELL in str(e):
            require_empty(rows.filter(bad), BROKEN_CELL)
        raise
    head = [f"# {c}" for c in comment.splitlines()] + ["\t".join(columns)]
    rows.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("append").text(path)


def encode_jsonl(rows: DataFrame) -> DataFrame:
    """One JSON object a line with keys in sorted order; nulls are kept."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]),
                                 {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(rows: DataFrame, path: str, meta_json: str | None = None) -> None:
    body = encode_jsonl(rows)
    if meta_json:
        head = rows.sparkSession.createDataFrame([(f"# {meta_json}",)], "value string").coalesce(1)
        head.write.mode("overwrite").text(path)
        body.write.mode("append").text(path)
    else:
        body.write.mode("overwrite").text(path)


def _jsonl_rows(lines: DataFrame, schema: str) -> tuple[DataFrame, Column]:
    """Lines with ``row``, whose ``_corrupt_record`` is null if the line fits, and whether a line is no data."""
    row = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.withColumn("row", row), (_strip(F.col("value")) == "") | F.col("value").startswith("# ")


def parse_jsonl(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects).  Blank lines and lines starting '# ' are skipped."""
    parsed, skip = _jsonl_rows(lines, schema)
    kept = parsed.filter(~skip)
    good = kept.filter(F.col("row._corrupt_record").isNull()).select("row.*").drop("_corrupt_record")
    return good, kept.filter(F.col("row._corrupt_record").isNotNull()).select("path", "value")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file with comment lines, in one scan; a missing file is an empty
    table, a line that does not fit the schema fails the action."""
    parsed, skip = _jsonl_rows(read_lines(spark, path, missing_ok=True).select("path", "value"), schema)
    named = F.concat(F.col("path"), F.lit(": no record of the schema: "), "value")
    return parsed.filter(strict(skip, F.col("row._corrupt_record").isNull(), named)).select("row.*").drop("_corrupt_record")


def jsonl_rejects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, line_no, value) of the lines that fail ``read_jsonl``."""
    parsed, skip = _jsonl_rows(number_lines(read_lines(spark, path)), schema)
    return parsed.filter(~skip & F.col("row._corrupt_record").isNotNull()).select("path", "line_no", "value")


def parse_meta(lines: DataFrame) -> DataFrame:
    """path and the map of a first non-blank line ``# {json}``, an empty map otherwise."""
    text = _strip(F.col("value"))
    first = (lines.filter(text != "").groupBy("path").agg(F.min_by(text, F.struct("block", "seq")).alias("first")))
    body = F.when(F.col("first").startswith("# "), F.from_json(F.substr("first", F.lit(3)), "map<string,string>"))
    return first.select("path", F.coalesce(body, F.create_map().cast("map<string,string>")).alias("meta"))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return parse_meta(read_lines(spark, path))


def _data_cells(lines: DataFrame) -> DataFrame:
    text = _strip(F.col("value"))
    return (lines.filter((text != "") & ~text.startswith("#"))
            .withColumn("parts", F.split(text, "\t", -1)))


def parse_golden(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, line, description, golden_idx = line_no), rejects.  Rows with fewer than
    two cells are ignored, a line cell that is no integer is a reject."""
    cells = _data_cells(lines).filter(F.size("parts") >= 2).withColumn("line", F.get("parts", F.lit(1)).try_cast("int"))
    rows = cells.filter(F.col("line").isNotNull()).select(
        "path", F.col("line_no").alias("golden_idx"), F.get("parts", F.lit(0)).alias("file"), "line",
        F.coalesce(F.get("parts", F.lit(2)), F.lit("")).alias("description"))
    return rows, cells.filter(F.col("line").isNull()).select("path", "line_no", F.lit("line is not a number").alias("error"))


def parse_golden_strict(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, line_no, file, line), rejects: every data row must be file and line."""
    cells = _data_cells(lines).withColumn("line", F.get("parts", F.lit(1)).try_cast("int"))
    rows = cells.filter(F.col("line").isNotNull()).select("path", "line_no", F.get("parts", F.lit(0)).alias("file"), "line")
    bad = cells.filter(F.col("line").isNull()).select("path", "line_no", F.lit("expected file and line").alias("error"))
    return rows, bad


def parse_negative_golden(lines: DataFrame, expect: str | None = None) -> DataFrame:
    """Distinct files that must exist, optionally only those an enrichment covers."""
    cells = _data_cells(lines).select(F.get("parts", F.lit(0)).alias("file"), F.get("parts", F.lit(1)).alias("verify_substring"))
    keep = ~F.coalesce(F.col("verify_substring") == "GONE", F.lit(False))
    if expect is not None:
        keep = keep & extension(F.col("file")).isin(*K.ENRICHABLE_EXTENSIONS[expect])
    return cells.filter(keep).select("file").distinct()


def parse_sha_map(lines: DataFrame, required: Sequence[str] = ("positive", "negative")) -> tuple[DataFrame, DataFrame]:
    """(name, sha), rejects: no '=', a sha that is not 40 long, a missing required name."""
    text = _strip(F.col("value"))
    data = lines.filter((text != "") & ~text.startswith("#")).withColumn("text", text)
    has = F.col("text").contains("=")
    name, sha = _strip(F.substring_index("text", "=", 1)), F.regexp_replace("text", "^[^=]*=", "")
    good = data.filter(has & (F.length(sha) == 40)).groupBy(name.alias("name")).agg(F.max_by(sha, "line_no").alias("sha"))
    bad = data.filter(~(has & (F.length(sha) == 40))).select("path", "line_no", F.when(
        ~has, "expected name=sha").otherwise("sha is not 40 characters").alias("error"))
    found = good.agg(F.collect_set(F.when(F.col("name").isin(*required), F.col("name"))).alias("have"))
    absent = found.select(F.explode(F.array_except(F.array(*[F.lit(r) for r in required]), "have")).alias("name")).select(
        F.lit("").alias("path"), F.lit(None).cast("bigint").alias("line_no"), F.concat(F.lit("missing "), "name").alias("error"))
    return good, bad.withColumn("line_no", F.col("line_no").cast("bigint")).unionByName(absent)


def parse_field_golden(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pr, sha), rejects: arity, digits, sha length, expected must be 0, duplicates, empty."""
    cells = _data_cells(lines).select("path", "line_no", "parts", *[
        _strip(F.get("parts", F.lit(i))).alias(c) for i, c in enumerate(("pr", "sha", "expected"))])
    error = (F.when(F.size("parts") != 3, "expected pr, sha, expected")
             .when(~F.col("pr").rlike("^[0-9]+$") | (F.length("sha") != 40), "bad pr or sha")
             .when(F.col("expected").try_cast("int").isNull(), "expected is not a number")
             .when(F.col("expected").cast("int") != 0, "nonzero expectation"))
    checked = cells.withColumn("error", error)
    good = checked.filter(F.col("error").isNull()).select("path", "line_no", F.col("pr").cast("int").alias("pr"), "sha")
    bad = checked.filter(F.col("error").isNotNull()).select("path", F.col("line_no").cast("bigint").alias("line_no"), "error")
    for key in ("pr", "sha"):
        twice = good.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("path"), F.max("line_no").alias("line_no")).filter("n > 1")
        bad = bad.unionByName(twice.select("path", F.col("line_no").cast("bigint").alias("line_no"), F.lit(f"duplicate {key}").alias("error")))
    none = cells.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit("").alias("path"), F.lit(None).cast("bigint").alias("line_no"), F.lit("no rows").alias("error"))
    return good, bad.unionByName(none)


def parse_adjudications(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed adjudication rows; a verdict outside REAL, FP, DUP is a reject."""
    rows, bad = parse_tsv(lines, K.ADJUDICATION_COLUMNS)
    typed = rows.withColumns({"line_start": F.col("line_start").try_cast("int"), "line_end": F.col("line_end").try_cast("int"),
                              "is_real": F.col("is_real").try_cast("double")})
    ok = F.col("verdict").isin("REAL", "FP", "DUP")
    more = typed.filter(~ok).select("path", "line_no", F.concat(F.lit("bad verdict "), "verdict").alias("error"))
    return typed.filter(ok), bad.unionByName(more)
