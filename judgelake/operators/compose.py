"""Gates, holds, ranking and the measurement verdict over judged units.

``judged`` holds one row per (run, unit): run key columns, ``ord`` (arrival
order), file, line, severity, is_real, category, rubric, references_remaining,
reflex_class and optionally parent_declaration and parse_error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions.scores import near, own_threshold, sev_level


def with_grid(df: DataFrame, grid: Sequence[float] = tuple(K.THRESHOLD_GRID), name: str = "t") -> DataFrame:
    """One copy of each row per grid value; a generator, so no join and no shuffle."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(g)) for g in grid])))


def _column(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def gate(judged: DataFrame, t=K.CODE_THRESHOLD, dt=K.DELETION_THRESHOLD,
         hold_classes: Sequence[str] = tuple(K.HELD_CLASSES)) -> DataFrame:
    """Adds ``jitter``, ``passes``, ``held`` and ``reported`` flags.

    ``t`` and ``dt`` may be numbers or columns (a grid).  Jitter is tested before
    the severity and hold rules; rows with a parse error carry no flag.
    """
    own = own_threshold(F.col("rubric"), _column(t), _column(dt))
    judged_ok = ~F.coalesce(F.col("parse_error"), F.lit(False)) if "parse_error" in judged.columns else F.lit(True)
    passes = judged_ok & F.coalesce(
        (F.col("is_real") >= own) & (F.coalesce("severity", F.lit(0.0)) >= 1), F.lit(False))
    held_class = F.coalesce(F.col("reflex_class"), F.lit("code")).isin(*hold_classes) if hold_classes else F.lit(False)
    return (judged.withColumn("jitter", judged_ok & near(F.col("is_real"), own))
            .withColumn("passes", passes)
            .withColumn("held", F.col("passes") & held_class)
            .withColumn("reported", F.col("passes") & ~F.col("held")))


def compose(judged: DataFrame, t=K.CODE_THRESHOLD, dt=K.DELETION_THRESHOLD,
            hold_classes: Sequence[str] = tuple(K.HELD_CLASSES)) -> DataFrame:
    """The reported findings."""
    return gate(judged, t, dt, hold_classes).filter("reported").drop("jitter", "passes", "held", "reported")


def grid_levels(rubric: Column, is_real: Column, grid: Sequence[float], dt: float = K.DELETION_THRESHOLD) -> Column:
    """At how many values of a rising grid a score reaches its own threshold.

    Scores that reach a value reach all before it; deletions have one threshold ``dt``, so
    they reach all or none.
    """
    assert list(grid) == sorted(grid)
    reached = sum((F.when(is_real >= F.lit(float(g)), 1).otherwise(0) for g in grid), F.lit(0))
    return own_threshold(rubric, reached, F.when(is_real >= F.lit(float(dt)), len(grid)).otherwise(0))


def with_levels(judged: DataFrame, grid: Sequence[float] = tuple(K.THRESHOLD_GRID), dt: float = K.DELETION_THRESHOLD,
                hold_classes: Sequence[str] = tuple(K.HELD_CLASSES)) -> DataFrame:
    """Adds ``reported_to`` and ``held_to``: at how many grid values the gate reports or holds
    the row.  One row stands for the whole grid."""
    g = gate(judged, -float("inf"), -float("inf"), hold_classes)
    level = grid_levels(F.col("rubric"), F.col("is_real"), grid, dt)
    return (g.withColumn("reported_to", F.when(F.col("reported"), level).otherwise(0)).withColumn("held_to", F.when(F.col("held"), level).otherwise(0))
            .drop("jitter", "passes", "held", "reported"))


def at_levels(df: DataFrame, level: str) -> DataFrame:
    """A row for each place ``k`` in the grid below ``level``."""
    return df.filter(F.col(level) > 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.col(level) - 1)))


def jitter_rows(judged: DataFrame, t=K.CODE_THRESHOLD, dt=K.DELETION_THRESHOLD) -> DataFrame:
    return gate(judged, t, dt).filter("jitter").drop("jitter", "passes", "held", "reported")


def held_counts(judged: DataFrame, run_cols: Sequence[str], t=K.REFLEX_GATE,
                dt=K.DELETION_THRESHOLD) -> DataFrame:
    """Findings surfaced with and without the hold, and their difference, per run."""
    g = gate(judged, t, dt)
    return g.groupBy(*run_cols).agg(
        F.count_if("passes").alias("n_passing"), F.count_if("reported").alias("n_reported"),
        F.count_if("held").alias("n_held"))


def rank_and_cap(reported: DataFrame, run_cols: Sequence[str], cap: int = K.REPORT_CAP) -> DataFrame:
    """Top findings per run by severity, then is_real, then arrival.

    The rank filter lets Spark keep only ``cap`` rows per run before the shuffle.
    """
    w = Window.partitionBy(*run_cols).orderBy(
        F.coalesce("severity", F.lit(0.0)).desc(), F.coalesce("is_real", F.lit(0.0)).desc(), F.col("ord"))
    return reported.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)


def measurement_verdict(reported: DataFrame, run_cols: Sequence[str],
                        per_declaration: bool = False) -> DataFrame:
    """Blockers, majors and verdict per run with at least one reported finding.

    A deletion finding without references counts only when a reported code
    finding of the run is level 2 or more, or one of the same file has a
    category other than style.  Rows are first summed per (run, file,
    declaration) on the map side; one more shuffle by run then serves both flags
    and the totals, and carries a row per file and declaration only.
    """
    keys = [*run_cols, "file"]
    decl = _declaration(reported) if per_declaration else F.lit("")
    return _verdicts(reported.withColumn("decl", decl).groupBy(*keys, "decl").agg(*_severity_flags()), run_cols, per_declaration)


def _declaration(reported: DataFrame) -> Column:
    own_id = F.concat_ws(":", F.col("file"), F.col("line").cast("string"))
    return F.coalesce(F.col("parent_declaration"), own_id) if "parent_declaration" in reported.columns else own_id


def _severity_flags() -> list[Column]:
    """What the verdict needs of the findings of a file and declaration."""
    level = sev_level(F.col("severity"))
    is_del = F.coalesce(F.col("rubric"), F.lit("code-change")) == "deletion"
    unsure = is_del & ~F.coalesce(F.col("references_remaining"), F.lit(False))
    return [F.max((level >= 2) & ~is_del).alias("run_corroborates"),
            F.max(~is_del & F.coalesce(F.col("category") != "style", F.lit(False))).alias("file_corroborates"),
            F.count_if((level == 3) & ~unsure).alias("blockers"), F.count_if((level == 2) & ~unsure).alias("majors"),
            F.count_if((level == 3) & unsure).alias("del_blockers"), F.count_if((level == 2) & unsure).alias("del_majors")]


def _verdicts(base: DataFrame, run_cols: Sequence[str], per_declaration: bool = False, sums: Sequence[str] = ()) -> DataFrame:
    """Per run from the flags of each file and declaration; ``sums`` are added up on the way."""
    in_run = F.max("run_corroborates").over(Window.partitionBy(*run_cols))
    in_file = F.max("file_corroborates").over(Window.partitionBy(*run_cols, "file"))
    counted = (base.withColumn("in_run", in_run).withColumn("in_file", in_file)
               .withColumn("ok", F.col("in_file") | F.col("in_run"))
               .withColumn("b", F.col("blockers") + F.when(F.col("ok"), F.col("del_blockers")).otherwise(0))
               .withColumn("m", F.col("majors") + F.when(F.col("ok"), F.col("del_majors")).otherwise(0)))
    n_major = F.count_distinct(F.when(F.col("m") > 0, F.col("decl"))) if per_declaration else F.sum("m")
    return counted.groupBy(*run_cols).agg(F.sum("b").alias("n_blockers"), n_major.alias("n_majors"), *[F.sum(c).alias(c) for c in sums]).withColumn(
        "verdict", verdict_of(F.col("n_blockers"), F.col("n_majors")))


def verdict_levels(findings: DataFrame, run_cols: Sequence[str], level: str, counts: dict[str, Column]) -> DataFrame:
    """Per run and place ``k`` in the grid: the verdict as ``measurement_verdict`` has it, and
    ``counts`` (flags of a finding, by name) counted.

    Findings are summed per (run, file, level) on the map side; only those sums are told
    apart by ``k``.
    """
    flags, merge = _severity_flags(), []
    for name in ("run_corroborates", "file_corroborates"):
        merge.append(F.max(name).alias(name))
    sums = ["blockers", "majors", "del_blockers", "del_majors", *counts]
    per = findings.groupBy(*run_cols, "file", level).agg(*flags, *[F.count_if(c).alias(n) for n, c in counts.items()])
    base = at_levels(per, level).groupBy(*run_cols, "k", "file").agg(*merge, *[F.sum(c).alias(c) for c in sums])
    return _verdicts(base, [*run_cols, "k"], sums=list(counts))


def verdict_of(n_blockers: Column, n_majors: Column) -> Column:
    return F.when((n_blockers > 0) | (n_majors >= 2), "Changes requested").otherwise("Approved")


def size_skipped_code(skipped: DataFrame) -> DataFrame:
    """Skips that leave code unjudged: size reasons on anything but a deletion."""
    return skipped.filter(F.col("reason").startswith("hunk>") & ~F.coalesce(
        F.col("change_type"), F.lit("code-change")).isin(*K.DELETION_CHANGE_TYPES))


def skip_rollup(skipped: DataFrame, run_cols: Sequence[str], top: int = 10) -> DataFrame:
    """Counts per (file, reason) in first-seen order, the first ``top`` per run and
    how many entries follow; ceiling skips are not triage and are left out."""
    counts = (skipped.filter(F.col("reason") != "max-hunks>ceiling").groupBy(*run_cols, "file", "reason")
              .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord")))
    w = Window.partitionBy(*run_cols).orderBy("first_ord")
    shown = counts.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= top)
    totals = counts.groupBy(*run_cols).agg(F.greatest(F.count(F.lit(1)) - top, F.lit(0)).alias("n_more"))
    return shown.join(totals, list(run_cols)).drop("first_ord")


def ceiling_skips(skipped: DataFrame, run_cols: Sequence[str]) -> DataFrame:
    return (skipped.filter(F.col("reason") == "max-hunks>ceiling").groupBy(*run_cols, "file")
            .agg(F.count(F.lit(1)).alias("n")))
