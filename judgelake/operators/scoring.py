"""Corpus scoring: one row per run, then totals, repeats, grids and regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions.scores import is_minor_style, own_threshold, sev_level, try_ratio
from judgelake.operators.compose import at_levels, gate, grid_levels, measurement_verdict, verdict_levels, with_levels
from judgelake.operators.evaluation import _buckets, match_findings, with_span


def _bucketed(spans: DataFrame, width: int) -> DataFrame:
    return spans.withColumn("_bucket", F.explode(_buckets(F.col("line_start"), F.col("line_end"), width)))


def _over(points: DataFrame, spans: DataFrame, keys: Sequence[str], flags: Sequence[str],
          width: int = 128) -> DataFrame:
    """Points with, per flag column, its maximum over the spans holding the point.

    Points and spans must be distinct.  Both sides are matched by line bucket.
    """
    s = _bucketed(spans, width).withColumnsRenamed({k: f"_s_{k}" for k in keys})
    p = points.withColumn("_pb", F.floor(F.col("line") / width))
    on = [p[k] == s[f"_s_{k}"] for k in keys] + [p["_pb"] == s["_bucket"],
                                                 p["line"] >= s["line_start"], p["line"] <= s["line_end"]]
    cols = points.columns
    return p.join(s, on, "left").groupBy(*cols).agg(*[F.max(f).alias(f) for f in flags])


def golden_anchors(runs: DataFrame, golden: DataFrame, matches: DataFrame, run_cols: Sequence[str],
                   sample_cols: Sequence[str]) -> DataFrame:
    """Labelled lines due in each run: run and sample columns, file, line, n_gold, n_matched."""
    both = list(dict.fromkeys([*run_cols, *sample_cols]))
    places = golden.groupBy(*sample_cols, "file", "line").agg(F.count(F.lit(1)).alias("n_gold"))
    hit = matches.groupBy(*both, "file", F.col("golden_line").alias("line")).agg(F.count(F.lit(1)).alias("n_matched"))
    return (runs.select(*both).join(places, list(sample_cols)).join(hit, [*both, "file", "line"], "left")
            .withColumn("n_matched", F.coalesce("n_matched", F.lit(0).cast("bigint"))))


def classify_anchors(anchors: DataFrame, gated: DataFrame, skipped: DataFrame, run_cols: Sequence[str],
                     t=K.CODE_THRESHOLD, dt=K.DELETION_THRESHOLD,
                     skip_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """Adds ``in_reported`` (a reported unit holds the line) and, for lines with an
    unmatched label, the miss reason ``bucket``."""
    run = list(run_cols)
    tc = t if isinstance(t, Column) else F.lit(float(t))
    own = own_threshold(F.col("rubric"), tc, dt if isinstance(dt, Column) else F.lit(float(dt)))
    real = F.coalesce("is_real", F.lit(0.0))
    spans = with_span(gated).groupBy(*run, "file", "line_start", "line_end").agg(
        F.max("reported").alias("any_reported"), F.max("held").alias("any_held"),
        F.max(F.struct(real.alias("r"), (-F.col("ord")).alias("o"), (real >= own).alias("over"))).alias("best"))
    a = _over(anchors, spans, [*run, "file"], ["any_reported", "any_held", "best"])

    keys = [*skip_cols, "file"]
    ceiling = F.col("reason") == "max-hunks>ceiling"
    placed = (skipped.filter(F.col("line_start").isNotNull()).groupBy(*keys, "line_start", "line_end")
              .agg(F.max(ceiling).alias("cut"), F.lit(True).alias("skip_here")))
    whole = (skipped.filter(F.col("line_start").isNull()).select(*keys).distinct()
             .withColumn("skip_file", F.lit(True)))
    a = _over(a, placed, keys, ["cut", "skip_here"]).join(whole, keys, "left")
    no = F.lit(False)
    reason = (
        F.when(F.coalesce("any_reported", no), "anchor-offset")
        .when(F.coalesce("any_held", no), "held-test")
        .when(F.col("best").isNotNull(), F.when(F.col("best.over"), "judged-low-severity")
              .otherwise("judged-below-threshold"))
        .when(F.coalesce("cut", no), "truncated")
        .when(F.coalesce("skip_here", no) | F.coalesce("skip_file", no), "skipped-triage")
        .otherwise("not-judged"))
    return (a.withColumn("in_reported", F.coalesce("any_reported", no))
            .withColumn("bucket", F.when(F.col("n_matched") < F.col("n_gold"), reason))
            .drop("any_reported", "any_held", "best", "cut", "skip_here", "skip_file"))


def known_fp_repeats(reported: DataFrame, dismissed: DataFrame, run_cols: Sequence[str],
                     sample_cols: Sequence[str]) -> DataFrame:
    """Dismissed lines per run that a reported unit covers again."""
    both = list(dict.fromkeys([*run_cols, *sample_cols]))
    spans = with_span(reported).select(*both, "file", "line_start", "line_end").distinct()
    places = dismissed.groupBy(*sample_cols, "file", "line").agg(F.count(F.lit(1)).alias("n"))
    width = 128
    s = _bucketed(spans, width)
    p = places.withColumn("_bucket", F.floor(F.col("line") / width))
    hit = (p.join(s, [*sample_cols, "file", "_bucket"])
           .filter(F.col("line").between(F.col("line_start"), F.col("line_end")))
           .groupBy(*both, "file", "line").agg(F.first("n").alias("n")))
    return hit.groupBy(*run_cols).agg(F.sum("n").alias("known_fp_repeats"))


def score_runs(runs: DataFrame, judged: DataFrame, golden: DataFrame, dismissed: DataFrame, skipped: DataFrame,
               run_cols: Sequence[str] = ("run_id",), sample_cols: Sequence[str] = ("sample_id",),
               t: float = K.CODE_THRESHOLD, dt: float = K.DELETION_THRESHOLD,
               hold_classes: Sequence[str] = tuple(K.HELD_CLASSES),
               skip_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """One score row per run: ``score_grid`` with one value."""
    return score_grid(runs, judged, golden, dismissed, skipped, run_cols, sample_cols, [t], dt, hold_classes, skip_cols).drop("t")


def score_grid(runs: DataFrame, judged: DataFrame, golden: DataFrame, dismissed: DataFrame, skipped: DataFrame,
               run_cols: Sequence[str] = ("run_id",), sample_cols: Sequence[str] = ("sample_id",),
               grid: Sequence[float] = tuple(K.THRESHOLD_GRID), dt: float = K.DELETION_THRESHOLD,
               hold_classes: Sequence[str] = tuple(K.HELD_CLASSES), skip_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """One score row per run and value ``t`` of a rising grid, from one pass.

    A judged row carries up to which grid value it is reported or held.  Labels, dismissed
    lines and skips meet spans once; the largest level of what covers a line says at which
    values it is covered.  Only sums, labelled lines and findings near them have a row per
    value, after their joins.
    """
    run, sample, grid = list(run_cols), list(sample_cols), [float(g) for g in grid]
    both = list(dict.fromkeys([*run, *sample]))
    leveled = with_levels(judged, grid, dt, hold_classes)
    reported = leveled.filter("reported_to > 0")
    level, style = sev_level(F.col("severity")), is_minor_style(F.col("severity"), F.col("category"))
    fp = F.col("severity").isNotNull() & ((level >= 2) | ((level < 2) & ~style))
    per_run = verdict_levels(reported, run, "reported_to", {"n_reported": F.lit(True), "fp": fp}).drop("n_blockers", "n_majors")

    real = F.coalesce("is_real", F.lit(0.0))
    over = grid_levels(F.col("rubric"), real, grid, dt)
    spans = with_span(leveled).groupBy(*both, "file", "line_start", "line_end").agg(
        F.max("reported_to").alias("reported_to"), F.max("held_to").alias("held_to"),
        F.max(F.struct(real.alias("r"), (-F.col("ord")).alias("o"), over.alias("over"))).alias("best"))
    places = golden.groupBy(*sample, "file", "line").agg(F.count(F.lit(1)).alias("n_gold"))
    due = _over(runs.select(*both).join(places, sample), spans, [*both, "file"], ["reported_to", "held_to", "best"])
    keys = [*skip_cols, "file"]
    here = (skipped.filter(F.col("line_start").isNotNull()).groupBy(*keys, "line_start", "line_end")
            .agg(F.max(F.col("reason") == "max-hunks>ceiling").alias("cut"), F.lit(True).alias("skip_here")))
    whole = skipped.filter(F.col("line_start").isNull()).select(*keys).distinct().withColumn("skip_file", F.lit(True))
    due = _over(due, here, keys, ["cut", "skip_here"]).join(whole, keys, "left")

    matches = match_findings(reported, golden, run, sample, level="reported_to")
    hit = matches.groupBy(*both, "file", F.col("golden_line").alias("line")).agg(
        F.array(*[F.count_if(F.col("k") == k) for k in range(len(grid))]).alias("hits"))
    no, zero = F.lit(False), F.lit(0).cast("bigint")
    at = (due.join(hit, [*both, "file", "line"], "left").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
          .withColumn("n_matched", F.coalesce(F.get("hits", F.col("k")), zero))
          .withColumn("in_reported", F.coalesce(F.col("reported_to") > F.col("k"), no)))
    reason = (F.when(F.col("in_reported"), "anchor-offset").when(F.coalesce(F.col("held_to") > F.col("k"), no), "held-test")
              .when(F.col("best").isNotNull(), F.when(F.col("best.over") > F.col("k"), "judged-low-severity").otherwise("judged-below-threshold"))
              .when(F.coalesce("cut", no), "truncated").when(F.coalesce("skip_here", no) | F.coalesce("skip_file", no), "skipped-triage").otherwise("not-judged"))
    at = at.withColumn("bucket", F.when(F.col("n_matched") < F.col("n_gold"), reason))
    misses = [miss_column(b) for b in K.MISS_BUCKETS]
    per_golden = at.groupBy(*both, "k").agg(
        F.sum("n_gold").alias("golden"), F.sum("n_matched").alias("tp"), F.sum(F.when(F.col("in_reported"), F.col("n_gold"))).alias("cluster_matched"),
        *[F.sum(F.when(F.col("bucket") == b, F.col("n_gold"))).alias(miss_column(b)) for b in K.MISS_BUCKETS])

    lines = dismissed.groupBy(*sample, "file", "line").agg(F.count(F.lit(1)).alias("n"))
    again = _over(runs.select(*both).join(lines, sample), spans.drop("held_to", "best"), [*both, "file"], ["reported_to"])
    repeats = at_levels(again.groupBy(*run, "reported_to").agg(F.sum("n").alias("n")), "reported_to").groupBy(*run, "k").agg(F.sum("n").alias("known_fp_repeats"))

    serious = golden.groupBy(*sample).agg(F.max(F.col("severity_class").isin("blocker", "major")).alias("serious"))
    key = [*run, "k"]
    counted = ["golden", "tp", "cluster_matched", *misses, "n_reported", "fp", "known_fp_repeats"]
    out = (runs.select("*", F.posexplode(F.array(*map(F.lit, grid))).alias("k", "t")).join(per_golden, [*both, "k"], "left").join(serious, sample, "left")
           .join(per_run, key, "left").join(repeats, key, "left").withColumns({c: F.coalesce(F.col(c), zero) for c in counted})
           .withColumn("verdict", F.coalesce("verdict", F.lit("Approved")))
           .withColumn("clean_fp", F.when(F.col("kind") == "clean", F.col("fp")).otherwise(zero))
           .withColumn("expected_verdict", F.when(F.col("kind") != "positive", "Approved").when(F.col("serious"), "Changes requested")))
    return out.withColumn("verdict_ok", F.col("verdict") == F.col("expected_verdict")).drop("k", "fp", "serious")


def miss_column(bucket: str) -> str:
    return "miss_" + bucket.replace("-", "_")


def aggregate_scores(scores: DataFrame, dismissed: DataFrame, samples: DataFrame,
                     extra: Sequence[str] = (), sample_cols: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Totals per repo and over all repos (repo null), per value of ``extra`` columns.

    Ratios are null when nothing was counted; ``dismissed_total`` is per sample,
    not per repeat.
    """
    extra = list(extra)
    pos, clean = F.col("kind") == "positive", F.col("kind") == "clean"

    def over(cond, c):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0).cast("bigint"))

    grouped = (scores.groupingSets([[*extra, "repo"], extra], *extra, "repo") if extra
               else scores.rollup("repo"))
    agg = grouped.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(pos).alias("positive"), F.count_if(clean).alias("clean"),
        over(pos, "golden").alias("golden_total"), over(pos, "n_reported").alias("_rep_pos"),
        over(pos, "tp").alias("_tp"), over(pos, "cluster_matched").alias("_cluster"),
        over(clean, "clean_fp").alias("_clean_fp"), F.sum("n_reported").alias("_rep"),
        F.count("verdict_ok").alias("_scored"), F.count_if("verdict_ok").alias("_right"),
        F.sum("known_fp_repeats").alias("known_fp_repeats"), F.avg("total_latency_ms").alias("avg_latency_ms"),
        *[over(pos, miss_column(b)).alias(miss_column(b)) for b in K.MISS_BUCKETS])
    ratio = try_ratio
    agg = (agg.withColumn("recall_strict", ratio(F.col("_tp"), F.col("golden_total")))
           .withColumn("recall_cluster", ratio(F.col("_cluster"), F.col("golden_total")))
           .withColumn("precision", ratio(F.col("_tp"), F.col("_rep_pos")))
           .withColumn("f1", F.when((F.col("precision") > 0) & (F.col("recall_strict") > 0),
                                    2.0 * F.col("precision") * F.col("recall_strict")
                                    / (F.col("precision") + F.col("recall_strict"))))
           .withColumn("fp_per_clean", ratio(F.col("_clean_fp"), F.col("clean")))
           .withColumn("findings_per_pr", ratio(F.col("_rep"), F.col("samples")))
           .withColumn("verdict_accuracy", ratio(F.col("_right"), F.col("_scored"))))
    gone = dismissed_totals(dismissed, samples, sample_cols)
    return (agg.join(gone, agg["repo"].eqNullSafe(gone["repo"]), "left").drop(gone["repo"])
            .withColumn("dismissed_total", F.coalesce("dismissed_total", F.lit(0).cast("bigint")))
            .drop("_rep_pos", "_tp", "_cluster", "_clean_fp", "_rep", "_scored", "_right"))


def dismissed_totals(dismissed: DataFrame, samples: DataFrame, sample_cols: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Dismissed rows per repo and in total, each sample counted once."""
    per = dismissed.groupBy(*sample_cols).agg(F.count(F.lit(1)).alias("n"))
    return (samples.select(*sample_cols, "repo").distinct().join(per, list(sample_cols), "left").rollup("repo")
            .agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("dismissed_total")))


def missing_runs(samples: DataFrame, runs: DataFrame, repeats: int | None = None) -> DataFrame:
    """Planned (sample, repeat) without a ledger record.

    Without a plan the repeats a sample has are its plan, and a sample without
    any run misses repeat 1.
    """
    if repeats is None:
        had = runs.select("sample_id").distinct()
        return samples.select("sample_id").join(had, "sample_id", "left_anti").select("sample_id", F.lit(1).alias("repeat"))
    plan = samples.select("sample_id", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    return plan.join(runs.select("sample_id", "repeat"), ["sample_id", "repeat"], "left_anti")


def repeat_variance(runs: DataFrame, judged: DataFrame, verdicts: DataFrame, payload: Sequence[str]) -> DataFrame:
    """One row: identical, verdict_flips, max and mean is_real spread.

    Only samples with two runs or more count.  ``payload`` are the judged columns
    that make two runs identical; runs are compared by an order-aware hash
    of 128 bits computed row by row, so no run is gathered; null is told from every text.
    ``verdicts``: run_id, verdict.
    """
    multi = (runs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("sample_id"))
    mine = runs.join(multi, "sample_id", "left_semi")
    cells = [x for c in payload for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    prints = judged.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), *[
        F.bit_xor(F.xxhash64(F.lit(seed), "pos", *cells)).alias(name) for seed, name in ((1, "h"), (2, "g"))])
    per_sample = (mine.select("run_id", "sample_id").join(prints, "run_id", "left").join(verdicts, "run_id", "left")
                  .groupBy("sample_id").agg(
                      F.count_distinct(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("g", F.lit(0)).alias("g"))).alias("kinds"),
                      F.count_distinct(F.coalesce("verdict", F.lit("Approved"))).alias("verdicts")))
    flips = per_sample.agg(F.coalesce(F.max("kinds"), F.lit(1)).alias("k"), F.count_if(F.col("verdicts") > 1).alias("verdict_flips"))
    real = F.coalesce("is_real", F.lit(0.0))
    spread = (judged.join(mine.select("run_id", "sample_id"), ["run_id", "sample_id"], "left_semi")
              .groupBy("sample_id", "file", "line").agg(F.count(F.lit(1)).alias("n"), (F.max(real) - F.min(real)).alias("s"))
              .filter("n > 1").agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("max_is_real_spread"),
                                   F.coalesce(F.avg("s"), F.lit(0.0)).alias("mean_is_real_spread")))
    both = flips.withColumn("_one", F.lit(1)).join(spread.withColumn("_one", F.lit(1)), "_one")
    return both.select((F.col("k") <= 1).alias("identical"), "verdict_flips", "max_is_real_spread", "mean_is_real_spread")


def regression_keys(baseline: DataFrame, new: DataFrame, band: float, gate_at: float = K.REFLEX_GATE,
                    zone: float = K.JITTER_ZONE, keys: Sequence[str] = ("defect",)) -> DataFrame:
    """Flags per common key: leg a failure, jitter exclusion, surfaced in each arm."""
    b, n = F.col("base_score"), F.col("new_score")
    j = (baseline.select(*keys, F.col("score").alias("base_score"))
         .join(new.select(*keys, F.col("score").alias("new_score")), list(keys)))
    jitter = (F.abs(b - gate_at) <= zone) | (F.abs(n - gate_at) <= zone)
    return (j.withColumn("leg_a_failure", n < b - band).withColumn("jitter_excluded", jitter)
            .withColumn("base_surfaced", ~jitter & (b >= gate_at)).withColumn("new_surfaced", ~jitter & (n >= gate_at))
            .withColumn("surfaced_delta", F.col("base_surfaced") != F.col("new_surfaced")))


def regression_result(flags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both legs pass or fail, per group."""
    out = flags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_common"), F.count_if("leg_a_failure").alias("n_leg_a_failures"),
        F.count_if("jitter_excluded").alias("n_jitter_excluded"), F.count_if("surfaced_delta").alias("n_surfaced_delta"))
    return (out.withColumn("leg_a_pass", F.col("n_leg_a_failures") == 0)
            .withColumn("leg_b_pass", F.col("n_surfaced_delta") == 0)
            .withColumn("overall_pass", F.col("leg_a_pass") & F.col("leg_b_pass")))


def separability(units: DataFrame, golden_counts: DataFrame, bars: Sequence[float],
                 run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per bar: false positives and true-positive instances at or above it, and the
    runs that keep every labelled line.

    ``units``: run columns, is_real, is_tp (matched a label).  ``golden_counts``:
    run columns, n_golden.
    """
    run = list(run_cols)
    grid = F.explode(F.array(*[F.lit(float(b)) for b in bars])).alias("bar")
    kept = F.coalesce(F.col("is_real") >= F.col("bar"), F.lit(False))
    per_run = (units.select("*", grid).groupBy("bar", *run).agg(
        F.count_if(kept & ~F.col("is_tp")).alias("fp"), F.count_if(kept & F.col("is_tp")).alias("tp")))
    all_runs = golden_counts.select(*run, "n_golden", grid)
    zero = F.lit(0).cast("bigint")
    return (all_runs.join(per_run, ["bar", *run], "left").groupBy("bar").agg(
        F.sum(F.coalesce("fp", zero)).alias("fp_kept"), F.sum(F.coalesce("tp", zero)).alias("tp_kept"),
        F.count_if((F.col("n_golden") > 0) & (F.coalesce("tp", zero) == F.col("n_golden"))).alias("full_recall_runs")))


def noise_band(surfaced: DataFrame) -> DataFrame:
    """Per head: counts of the two baseline runs and the new build, band and check.

    ``surfaced``: head, role (baseline-1, baseline-2, new), n.  The band is the
    largest difference between two runs of the unchanged build over all heads.
    """
    wide = surfaced.groupBy("head").pivot("role", ["baseline-1", "baseline-2", "new"]).agg(F.first("n"))
    wide = wide.select("head", *[F.coalesce(F.col(f"`{c}`"), F.lit(0).cast("bigint")).alias(n) for c, n in
                                 (("baseline-1", "base_1"), ("baseline-2", "base_2"), ("new", "new"))])
    band = wide.agg(F.max(F.abs(F.col("base_1") - F.col("base_2")))).scalar()
    return (wide.withColumn("band", band)
            .withColumn("within_band", F.col("new") <= F.greatest("base_1", "base_2") + F.col("band")))


def declaration_flips(reported: DataFrame, run_cols: Sequence[str]) -> DataFrame:
    """Runs whose verdict changes only because majors are counted per declaration."""
    flat = measurement_verdict(reported, run_cols).select(*run_cols, F.col("verdict").alias("flat"))
    per = measurement_verdict(reported, run_cols, per_declaration=True).select(*run_cols, F.col("verdict").alias("per_declaration"))
    return flat.join(per, list(run_cols)).filter(F.col("flat") != F.col("per_declaration"))


def metric_table(aggregate: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Tidy (metric, value) rows of the headline metrics, in place of a rendered table."""
    names = ["samples", "positive", "clean", "golden_total", "recall_strict", "recall_cluster", "precision", "f1",
             "fp_per_clean", "findings_per_pr", "verdict_accuracy", "known_fp_repeats", "avg_latency_ms"]
    wide = aggregate.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(list(keys), names, "metric", "value")
