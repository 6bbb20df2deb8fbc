"""Measures of reported findings against labelled lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.functions.scores import f1, is_minor_style, sev_level, try_ratio
from judgelake.operators.matching import match_findings


def golden_metrics(runs: DataFrame, reported: DataFrame, golden: DataFrame, matches: DataFrame,
                   run_cols: Sequence[str], sample_cols: Sequence[str]) -> DataFrame:
    """Per run: n_golden, n_reported, tp, precision, recall, f1 (nulls where undefined).

    ``runs`` has one row per run (run and sample columns), also for runs that
    report nothing.
    """
    run, sample = list(run_cols), list(sample_cols)
    n_rep = reported.groupBy(*run).agg(F.count(F.lit(1)).alias("n_reported"))
    n_tp = matches.groupBy(*run).agg(F.count(F.lit(1)).alias("tp"))
    n_gold = golden.groupBy(*sample).agg(F.count(F.lit(1)).alias("n_golden"))
    zero = F.lit(0).cast("bigint")
    out = (runs.select(*dict.fromkeys([*run, *sample])).join(n_rep, run, "left").join(n_tp, run, "left")
           .join(n_gold, sample, "left")
           .select(*dict.fromkeys([*run, *sample]), *[F.coalesce(c, zero).alias(c) for c in ("n_golden", "n_reported", "tp")]))
    return (out.withColumn("precision", try_ratio(F.col("tp"), F.col("n_reported")))
            .withColumn("recall", try_ratio(F.col("tp"), F.col("n_golden")))
            .withColumn("f1", f1(F.col("precision"), F.col("recall"))))


def matched_levels(reported: DataFrame, matches: DataFrame, run_cols: Sequence[str]) -> DataFrame:
    """Severity level of every matched finding."""
    return (matches.select(*run_cols, "ord", "golden_idx").join(reported, [*run_cols, "ord"])
            .select(*run_cols, "ord", "golden_idx", sev_level(F.col("severity")).alias("level")))


def missed_golden(runs: DataFrame, golden: DataFrame, matches: DataFrame, run_cols: Sequence[str],
                  sample_cols: Sequence[str]) -> DataFrame:
    """Labelled lines of each run that no finding matched."""
    both = list(dict.fromkeys([*run_cols, *sample_cols]))
    due = runs.select(*both).join(golden, list(sample_cols))
    return due.join(matches.select(*both, "golden_idx"), [*both, "golden_idx"], "left_anti")


def negative_census(reported: DataFrame, run_cols: Sequence[str]) -> DataFrame:
    """False positives on an all-benign change: findings without a severity are not counted."""
    level, style = sev_level(F.col("severity")), is_minor_style(F.col("severity"), F.col("category"))
    known = F.col("severity").isNotNull()
    return reported.groupBy(*run_cols).agg(
        F.count_if(known & (level >= 2)).alias("blocker_major"),
        F.count_if(known & style).alias("minor_notes"),
        F.count_if(known & (level < 2) & ~style).alias("other_fp"))


def unmatched_positive(reported: DataFrame, matches: DataFrame, run_cols: Sequence[str]) -> DataFrame:
    """Reported, unmatched findings of a positive run other than minor style notes."""
    left = reported.join(matches.select(*run_cols, "ord"), [*run_cols, "ord"], "left_anti")
    return left.filter(~is_minor_style(F.col("severity"), F.col("category")))


def _buckets(lo: Column, hi: Column, width: int) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(F.greatest(lo, hi) / width))


def cover_pairs(points: DataFrame, spans: DataFrame, keys: Sequence[str], width: int = 128) -> DataFrame:
    """Inner interval join: points whose ``line`` lies in a span of the same keys.

    Spans carry ``line_start`` and ``line_end``.  Lines are bucketed so the join is
    an equi join on (keys, bucket): a hot file is split over its buckets.
    """
    p = points.withColumn("_bucket", F.floor(F.col("line") / width))
    s = spans.withColumn("_bucket", F.explode(_buckets(F.col("line_start"), F.col("line_end"), width)))
    return (p.join(s, [*keys, "_bucket"]).filter(F.col("line").between(F.col("line_start"), F.col("line_end")))
            .drop("_bucket"))


def covered(points: DataFrame, spans: DataFrame, keys: Sequence[str], width: int = 128) -> DataFrame:
    """Left semi form of ``cover_pairs``: points inside at least one span."""
    p = points.withColumn("_bucket", F.floor(F.col("line") / width))
    s = (spans.select(*keys, F.col("line_start").alias("_lo"), F.col("line_end").alias("_hi"))
         .withColumn("_bucket", F.explode(_buckets(F.col("_lo"), F.col("_hi"), width))).distinct())
    on = [p[c] == s[c] for c in [*keys, "_bucket"]] + [p["line"] >= s["_lo"], p["line"] <= s["_hi"]]
    return p.join(s, on, "left_semi").drop("_bucket")


def with_span(df: DataFrame) -> DataFrame:
    """The span of a unit, falling back to its line."""
    lo = F.coalesce("line_start", "line")
    return df.withColumn("line_start", lo).withColumn("line_end", F.coalesce("line_end", "line_start"))


__all__ = ["cover_pairs", "covered", "golden_metrics", "match_findings", "matched_levels", "missed_golden",
           "negative_census", "unmatched_positive", "with_span"]
