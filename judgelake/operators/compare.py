"""Two arms of an experiment: validity guards, paired deltas, decisions.

Judged rows carry sample_id, repeat, arm ('on' or 'off'), ord and the unit fields.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions.paths import extension
from judgelake.functions.scores import try_ratio
from judgelake.functions.texts import unit_key
from judgelake.operators.compose import compose
from judgelake.operators.matching import match_findings

CELL = ["sample_id", "repeat"]


def guard_reason(arm: Column, expect: Column) -> Column:
    """Why a run must not be scored, or null; columns fail_open, status, enrichment, wheels."""
    stamp = F.coalesce("enrichment", F.lit("none"))
    status = F.coalesce("status", F.lit("ok"))
    wheels = F.coalesce(F.try_element_at("wheels", F.lit("ts"))["available"], F.lit(False))
    return (F.when(F.coalesce("fail_open", F.lit(False)) | (status == "fail-open"), "fail-open")
            .when(status != "ok", "status")
            .when((arm == "off") & (stamp != "none"), "off-arm-stamped")
            .when((arm != "off") & ~F.array_contains(F.split(stamp, "\\+"), expect), "on-arm-not-stamped")
            .when((arm != "off") & (expect == "ts-ast") & ~wheels, "wheels-unavailable"))


def surfaced(judged: DataFrame, include_test: bool = False) -> DataFrame:
    """Uncapped findings at the reflex gate."""
    return compose(judged, K.REFLEX_GATE, hold_classes=() if include_test else tuple(K.HELD_CLASSES))


def arm_counts(judged: DataFrame, golden: DataFrame, include_test: bool = False) -> DataFrame:
    """Per (sample, repeat, arm): surfaced count and true positives."""
    rep = surfaced(judged, include_test)
    run = [*CELL, "arm"]
    tp = match_findings(rep, golden, run, ["sample_id"]).groupBy(*run).agg(F.count(F.lit(1)).alias("tp"))
    zero = F.lit(0).cast("bigint")
    return (judged.select(*run).distinct().join(rep.groupBy(*run).agg(F.count(F.lit(1)).alias("n_surfaced")), run, "left")
            .join(tp, run, "left").select(*run, F.coalesce("n_surfaced", zero).alias("n_surfaced"), F.coalesce("tp", zero).alias("tp")))


def unreachable_golden(judged: DataFrame, golden: DataFrame, run_cols: Sequence[str] = ("sample_id", "repeat", "arm")) -> DataFrame:
    """Labelled lines of a run with no judged anchor within one line."""
    run = list(run_cols)
    around = golden.withColumn("at", F.explode(F.array(F.col("line") - 1, F.col("line"), F.col("line") + 1)))
    anchors = judged.select(*run, "file", F.col("line").alias("at")).distinct()
    reached = around.join(anchors, ["sample_id", "file", "at"]).select(*run, "golden_idx").distinct()
    due = judged.select(*run).distinct().join(golden, "sample_id")
    return due.join(reached, [*run, "golden_idx"], "left_anti")


def guard_file_set(golden: DataFrame, negative_golden: DataFrame, must_enrich: DataFrame, expect: str, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Files (with their ``by`` columns) that enrichment must reach: golden files, existing
    negative-golden files with a covered extension, and named files."""
    negative = negative_golden.filter(~F.coalesce(F.col("verify_substring") == "GONE", F.lit(False))
                                      & extension(F.col("file")).isin(*K.ENRICHABLE_EXTENSIONS[expect]))
    cols = [*by, "file"]
    return golden.select(*cols).unionByName(negative.select(*cols)).unionByName(must_enrich.select(*cols)).distinct()


def enriched_shares(judged: DataFrame, files: DataFrame, expect: str,
                    run_cols: Sequence[str] = ("sample_id", "repeat"), by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Per run and file due in it: units, enriched share, and why the file fails the guard.

    Counts are summed per (run, file) before the join with the due files, which meet the
    runs of their sample by the ``by`` columns.
    """
    run = list(run_cols)
    counts = judged.groupBy(*run, "file").agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("enrichment") == expect).alias("n_enriched"))
    due = judged.select(*run).distinct().join(files, list(by)).select(*run, "file")
    zero = F.lit(0).cast("bigint")
    out = (due.join(counts, [*run, "file"], "left").withColumn("n_units", F.coalesce("n_units", zero))
           .withColumn("n_enriched", F.coalesce("n_enriched", zero)))
    return (out.withColumn("share", F.coalesce(try_ratio(F.col("n_enriched"), F.col("n_units")), F.lit(0.0)))
            .withColumn("abort", F.when(F.col("n_units") == 0, "not-judged").when(F.col("n_enriched") == 0, "no-enriched-unit")))


def paired_deltas(judged: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """is_real(on) - is_real(off) per unit present in both arms with a score.

    A unit listed twice counts once: the last scored row of the on arm against the
    last row of the off arm.  One aggregation over both arms, no join.
    """
    key = unit_key(F.col("file"), F.col("line"), F.col("line_end"))
    on = (F.col("arm") == "on") & F.col("is_real").isNotNull()
    off = F.col("arm") == "off"
    last_off = F.max_by(F.struct("is_real"), F.when(off, F.col("ord")))
    both = judged.withColumn("unit", key).groupBy(*CELL, *keep, "unit").agg(
        F.max_by("is_real", F.when(on, F.col("ord"))).alias("on"), last_off.alias("off"))
    return (both.withColumn("delta", F.col("on") - F.col("off.is_real")).filter(F.col("delta").isNotNull())
            .select(*CELL, *keep, "unit", "delta"))


def unit_means(deltas: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Mean delta of each unit over its repeats, nine decimals."""
    return deltas.groupBy(*by, "unit").agg(F.round(F.avg("delta"), 9).alias("delta"))


def sign_test_p(positive: Column, negative: Column) -> Column:
    """Exact two-sided sign test over the non-zero pairs, summed in logarithms."""
    n, k = positive + negative, F.least(positive, negative)

    def step(acc, i):
        log_c = acc["c"] + F.ln((n - i + 1).cast("double")) - F.ln(i.cast("double"))
        top = F.greatest(acc["s"], log_c)
        return F.struct(log_c.alias("c"), (top + F.ln(F.exp(acc["s"] - top) + F.exp(log_c - top))).alias("s"))

    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(steps, start, step, lambda acc: acc["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * F.exp(tail - n * F.lit(math.log(2.0)))))


def delta_summary(means: DataFrame, by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Per group: units, mean delta, better, worse, sign test p."""
    out = means.groupBy(*by).agg(F.count(F.lit(1)).alias("n_paired_units"), F.avg("delta").alias("mean_delta"),
                                 F.count_if(F.col("delta") > 0).alias("better"), F.count_if(F.col("delta") < 0).alias("worse"))
    return out.withColumn("sign_test_p", sign_test_p(F.col("better"), F.col("worse")))


def decide(counts: DataFrame, summary: DataFrame, samples: DataFrame) -> DataFrame:
    """Verdict per sample.  ``counts``: arm_counts rows; ``samples``: sample_id, clean.

    Precision is pooled over repeats; recall must gain in every repeat; a significant
    drop of the paired scores or lost precision kills.
    """
    c = counts.join(samples, "sample_id").withColumn(
        "fp", F.col("n_surfaced") - F.when(F.col("clean"), F.lit(0).cast("bigint")).otherwise(F.col("tp")))
    on, off = F.col("arm") == "on", F.col("arm") == "off"
    cell = c.groupBy(*CELL).agg(*[F.coalesce(F.sum(F.when(a, F.col(v))), F.lit(0).cast("bigint")).alias(f"{n}_{v}")
                                  for n, a in (("on", on), ("off", off)) for v in ("fp", "tp")])
    per = cell.groupBy("sample_id").agg(
        (F.sum("on_fp") <= F.sum("off_fp") + K.AB_PRECISION_MARGIN).alias("precision_ok"),
        F.bool_and(F.col("on_tp") >= F.col("off_tp") + K.AB_RECALL_GAIN).alias("recall_signal"))
    zero = F.lit(0).cast("bigint")
    out = per.join(summary, "sample_id", "left").withColumns({
        "mean_delta": F.coalesce("mean_delta", F.lit(0.0)), "sign_test_p": F.coalesce("sign_test_p", F.lit(1.0)),
        **{n: F.coalesce(n, zero) for n in ("n_paired_units", "better", "worse")}})
    softened = (F.col("mean_delta") < 0) & (F.col("worse") > F.col("better")) & (F.col("sign_test_p") < K.AB_SIGNIFICANCE)
    return (out.withColumn("underpowered", F.col("better") + F.col("worse") < K.AB_MIN_NONZERO)
            .withColumn("verdict", F.when(~F.col("precision_ok") | softened, "KILL").when(F.col("recall_signal"), "SIGNAL")
                        .otherwise("NO-DETECTABLE-EFFECT")))


def missing_samples(results: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.select("sample_id").join(results.select("sample_id"), "sample_id", "left_anti")


def combine(results: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """One row: the combined verdict of per-sample results (sample_id, verdict, golden)."""
    v = results.agg(F.coalesce(F.bool_or(F.col("verdict") == "KILL"), F.lit(False)).alias("killed"),
                    F.count_if("golden").alias("n_golden"),
                    F.count_if(F.col("golden") & (F.col("verdict") == "SIGNAL")).alias("n_signal"))
    if expected is None:
        v = v.withColumn("n_missing", F.lit(0).cast("bigint"))
    else:
        v = v.withColumn("n_missing", missing_samples(results, expected).agg(F.count(F.lit(1))).scalar())
    nothing = "NO-DETECTABLE-EFFECT"
    return v.select("n_missing", F.when(F.col("killed"), "KILL").when(F.col("n_missing") > 0, nothing).when(
        (F.col("n_golden") > 0) & (F.col("n_signal") == F.col("n_golden")), "SIGNAL").otherwise(nothing).alias("combined_verdict"))


def probe_arms(probe: DataFrame, variants: Sequence[str] = ("clean", "fact")) -> DataFrame:
    """Mean, min and max is_real per unit and variant, side by side."""
    ok = probe.filter("ok").groupBy("unit").pivot("variant", list(variants))
    return ok.agg(F.avg("is_real").alias("mean"), F.min("is_real").alias("min"), F.max("is_real").alias("max"))


def probe_control(probe: DataFrame, bound: float = K.CODE_THRESHOLD) -> DataFrame:
    """The fact variant on control units must stay below the gate."""
    ctl = probe.filter(F.col("ok") & F.col("unit").startswith("CONTROL") & (F.col("variant") == "fact"))
    return ctl.agg(F.max("is_real").alias("max_is_real")).withColumn("passes", F.coalesce(F.col("max_is_real") < bound, F.lit(False)))


def batching_metrics(judged: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Per rubric over identical units of both arms: pairs, gate flips, flip rate, mean
    signed delta and sign test."""
    t = thresholds or {"code-change": K.CODE_THRESHOLD, "deletion": K.DELETION_THRESHOLD}
    key = unit_key(F.col("file"), F.col("line"), F.col("line_end"))
    pair = judged.withColumn("unit", key).groupBy(*CELL, "rubric", "unit").agg(
        *[F.max_by("is_real", F.when((F.col("arm") == a) & F.col("is_real").isNotNull(), F.col("ord"))).alias(a) for a in ("on", "off")])
    gate = F.lit(t["code-change"])
    gate = F.when(F.col("rubric") == "deletion", t["deletion"]).otherwise(gate)
    d = pair.filter(F.col("on").isNotNull() & F.col("off").isNotNull()).withColumn("delta", F.col("on") - F.col("off"))
    out = d.groupBy("rubric").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if((F.col("on") >= gate) != (F.col("off") >= gate)).alias("n_flips"),
        F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("better"), F.count_if(F.col("delta") < 0).alias("worse"))
    return (out.withColumn("flip_rate", try_ratio(F.col("n_flips"), F.col("n_pairs")))
            .withColumn("sign_test_p", sign_test_p(F.col("better"), F.col("worse"))))


def findings_jaccard(reported: DataFrame) -> DataFrame:
    """Per sample: mean over repeats of the Jaccard index of the arms' findings by place.

    Counted per place, so no findings set is gathered.  Two empty arms agree (1.0)."""
    place = reported.groupBy(*CELL, "file", "line").agg(F.max(F.col("arm") == "on").alias("on"), F.max(F.col("arm") == "off").alias("off"))
    cell = place.groupBy(*CELL).agg(F.count_if(F.col("on") & F.col("off")).alias("both"), F.count(F.lit(1)).alias("either"))
    return cell.groupBy("sample_id").agg(F.avg(F.col("both") / F.col("either")).alias("jaccard"), F.count(F.lit(1)).alias("n_repeats"))
