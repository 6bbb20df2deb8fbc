"""Corpus files and the spot-check sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions.texts import escape_cell
from judgelake.sources.lines import read_tsv, require_empty


def overlay(public: DataFrame, private: DataFrame) -> DataFrame:
    return public.unionByName(private)


def duplicate_samples(prs: DataFrame) -> DataFrame:
    return prs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def read_corpus(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """prs, issues and dismissed of ``root`` and ``root``/local; absent files are empty.

    Sample ids are counted at once, which reads the one column; all else is checked as it is read.
    """
    tables = {"prs": K.PRS_COLUMNS, "issues": K.ISSUE_COLUMNS, "dismissed": K.DISMISSED_COLUMNS}
    out = {name: overlay(*[read_tsv(spark, f"{d}/{name}.tsv", cols, missing_ok=True) for d in (root, f"{root}/local")])
           for name, cols in tables.items()}
    require_empty(duplicate_samples(out["prs"]), "duplicate sample_id")
    return out


def encode_sheet(rows: DataFrame) -> DataFrame:
    """Pipe table lines of spot-check rows."""
    cells = [escape_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in K.SPOT_CHECK_COLUMNS]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def write_sheet(rows: DataFrame, path: str) -> None:
    head = ["| " + " | ".join(K.SPOT_CHECK_COLUMNS) + " |", "|" + "---|" * len(K.SPOT_CHECK_COLUMNS)]
    spark = rows.sparkSession
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    encode_sheet(rows).write.mode("append").text(path)


def parse_sheet(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): table lines must have eleven cells."""
    rows = (lines.filter(F.col("value").startswith("| ") & ~F.col("value").startswith("| candidate_id"))
            .withColumn("cells", F.split(F.regexp_replace("value", "^\\s+|\\s+$", ""), "(?<!\\\\)\\|", -1))
            .withColumn("cells", F.transform(F.slice("cells", 2, F.size("cells") - 2), lambda c: F.regexp_replace(c, "^\\s+|\\s+$", ""))))
    fits = F.size("cells") == len(K.SPOT_CHECK_COLUMNS)
    good = rows.filter(fits).select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(K.SPOT_CHECK_COLUMNS)])
    bad = rows.filter(~fits).select("value", F.size("cells").alias("n_cells"))
    return good, bad
