"""Run gates, threshold replay curves, candidate choice, field sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions.paths import path_triage_reason
from judgelake.functions.scores import is_minor_style
from judgelake.operators.compose import at_levels, compose, with_grid, with_levels
from judgelake.operators.evaluation import match_findings, negative_census
from judgelake.session import cut_lineage


def gate_reason(packaging_version: str = K.DEFAULT_PACKAGING_VERSION, expected: Column | None = None) -> Column:
    """The first reason a ledger record must stay out of a sweep, or null.

    Counts are read as strings, so that booleans, fractions and negatives are told
    from counts.  ``judged_size`` is null for records without a judged array.
    """
    counts = ["n_dropped", "n_unjudged", "n_size_skipped_code"]

    def any_of(test):
        out = F.lit(False)
        for c in counts:
            out = out | test(F.col(c))
        return out

    structured = F.col("base_verdict").isNotNull()
    missing = any_of(lambda c: c.isNull())
    malformed = any_of(lambda c: ~c.rlike("^[0-9]+$"))
    incomplete = (F.col("n_dropped").rlike("[1-9]")) | (F.col("n_unjudged").rlike("[1-9]"))
    head = F.coalesce("fixture_head", F.lit(""))
    vocabulary = K.WIRE_FORMATS_BY_VERSION.get(packaging_version)
    in_vocabulary = (F.coalesce(F.col("wire_format").isin(*vocabulary), F.lit(False))
                     if vocabulary else F.lit(True))
    out = (
        F.when(F.col("judged_size").isNull(), "no-judged-array")
        .when(F.coalesce("fail_open", F.lit(False)), "fail-open")
        .when(F.col("judged_size") != F.col("n_analyzed"), "judged-count-differs")
        .when(structured & missing, "missing-counts")
        .when(structured & malformed, "malformed-counts")
        .when(structured & incomplete, "incomplete-review")
        .when(~structured & F.coalesce("verdict", F.lit("")).contains("(incomplete"), "incomplete-verdict")
        .when(~F.col("packaging_version").eqNullSafe(F.lit(packaging_version)), "packaging-version")
        .when(~in_vocabulary, "wire-format")
        .when(head == "", "no-head"))
    return out if expected is None else out.when(head != F.coalesce(expected, F.lit("")), "head-differs")


def gate_runs(runs: DataFrame, expected_heads: DataFrame | None = None,
              packaging_version: str = K.DEFAULT_PACKAGING_VERSION) -> DataFrame:
    """Adds ``reject_reason``; ``expected_heads``: fixture, expected_head."""
    if expected_heads is None:
        return runs.withColumn("reject_reason", gate_reason(packaging_version))
    return (runs.join(expected_heads, "fixture", "left")
            .withColumn("reject_reason", gate_reason(packaging_version, F.col("expected_head"))))


def select_runs(runs: DataFrame, expected_heads: DataFrame, label_prefix: str,
                packaging_version: str = K.DEFAULT_PACKAGING_VERSION) -> DataFrame:
    """Gated runs of the label prefix on the positive or negative fixture."""
    gated = gate_runs(runs.filter(F.col("label").startswith(label_prefix)), expected_heads, packaging_version)
    return gated.filter(F.col("reject_reason").isNull() & F.col("fixture").isin("positive", "negative"))


def selection_errors(selected: DataFrame, min_runs: int = K.MIN_RUNS_PER_FIXTURE) -> DataFrame:
    """Why a selection cannot be swept: too few runs of a fixture, more than one
    provider and model, more than one enrichment.  Empty for a good selection."""
    none = F.lit("\u0000")
    totals = selected.agg(
        F.count_if(F.col("fixture") == "positive").alias("n_positive"),
        F.count_if(F.col("fixture") == "negative").alias("n_negative"),
        F.count_distinct(F.struct(F.coalesce("provider", none).alias("p"), F.coalesce("model", none).alias("m"))).alias("n_groups"),
        F.count_distinct(F.coalesce("enrichment", F.lit("none"))).alias("n_enrichments"))
    checks = F.filter(F.array(
        F.when(F.col("n_positive") < min_runs, "too-few-positive"), F.when(F.col("n_negative") < min_runs, "too-few-negative"),
        F.when(F.col("n_groups") > 1, "mixed-providers"), F.when(F.col("n_enrichments") > 1, "mixed-enrichment")),
        lambda c: c.isNotNull())
    return totals.select(F.explode(checks).alias("error"), "n_positive", "n_negative", "n_groups", "n_enrichments")


def provider_groups(runs: DataFrame) -> DataFrame:
    """The (provider, model, enrichment) groups of a selection; a sweep needs one."""
    return runs.groupBy("provider", "model", F.coalesce("enrichment", F.lit("none")).alias("enrichment")).agg(
        F.count(F.lit(1)).alias("n_runs"))


def rewrap(judged: DataFrame, version: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with era defaults, rows of rubric-era runs that lack a rubric)."""
    v = F.col("packaging_version") if version is None else version
    broken = F.coalesce(v.isin(*K.RUBRIC_VERSIONS), F.lit(False)) & F.col("rubric").isNull()
    good = (judged.filter(~broken).withColumn("rubric", F.coalesce("rubric", F.lit("code-change")))
            .withColumn("reflex_class", F.coalesce("reflex_class", F.lit("code"))))
    return good, judged.filter(broken)


def replay(judged: DataFrame, grid: Sequence[float] = tuple(K.THRESHOLD_GRID), dt=K.DELETION_THRESHOLD,
           include_test: bool = False) -> DataFrame:
    """Reported findings of every run at every grid value, in column ``t``."""
    return compose(with_grid(judged, grid), F.col("t"), dt, () if include_test else tuple(K.HELD_CLASSES))


def run_grid(runs: DataFrame, grid: Sequence[float] = tuple(K.THRESHOLD_GRID)) -> DataFrame:
    return with_grid(runs, grid)


def negative_fp(reported: DataFrame, run_cols: Sequence[str]) -> DataFrame:
    return negative_census(reported, run_cols).select(*run_cols, (F.col("blocker_major") + F.col("other_fp")).alias("fp_neg"))


def triage_leaks(reported: DataFrame, negative_golden: DataFrame) -> DataFrame:
    """Reported findings on files of the negative golden that triage must skip."""
    skip = negative_golden.filter(path_triage_reason(F.col("file")) == "docs/generated/lockfile").select("file").distinct()
    return reported.join(skip, "file", "left_semi")


def sweep_runs(runs: DataFrame, judged: DataFrame, golden: DataFrame,
               grid: Sequence[float] = tuple(K.THRESHOLD_GRID), include_test: bool = False) -> DataFrame:
    """Per (t, run): fixture, tp, golden count, fp_pos (positive runs), fp_neg (negative).

    ``runs``: run_id, sample_id, fixture.  A finding is one row that knows up to which
    grid value it is reported.  Findings without a label nearby only count; they are
    summed by run and level on the map side and never join.
    """
    grid, zero = [float(g) for g in grid], F.lit(0).cast("bigint")
    rep = with_levels(judged.join(runs.select("run_id", "fixture"), "run_id"), grid, hold_classes=() if include_test else tuple(K.HELD_CLASSES)).filter("reported_to > 0")
    minor = is_minor_style(F.col("severity"), F.col("category"))
    totals = at_levels(rep.groupBy("run_id", "reported_to").agg(F.count_if(~minor).alias("serious"), F.count_if(~minor & F.col("severity").isNotNull()).alias("fp_neg")), "reported_to")
    totals = totals.groupBy("run_id", "k").agg(F.sum("serious").alias("serious"), F.sum("fp_neg").alias("fp_neg"))
    positive = rep.filter(F.col("fixture") == "positive")
    matches = match_findings(positive, golden, ["run_id"], ["sample_id"], level="reported_to")
    hits = (matches.select("run_id", "k", "ord").join(positive.select("run_id", "ord", minor.alias("minor")), ["run_id", "ord"])
            .groupBy("run_id", "k").agg(F.count(F.lit(1)).alias("tp"), F.count_if(~F.col("minor")).alias("serious_tp")))
    n_gold = golden.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_golden"))
    every = runs.select("run_id", "sample_id", "fixture", F.posexplode(F.array(*map(F.lit, grid))).alias("k", "t"))
    out = every.join(totals, ["run_id", "k"], "left").join(hits, ["run_id", "k"], "left").join(n_gold, "sample_id", "left")
    return out.select("t", "run_id", "fixture", F.coalesce("n_golden", zero).alias("n_golden"), F.coalesce("tp", zero).alias("tp"),
                      (F.coalesce("serious", zero) - F.coalesce("serious_tp", zero)).alias("fp_pos"),
                      F.coalesce("fp_neg", zero).alias("fp_neg"))


def sweep_curve(per_run: DataFrame, shipped: float = K.CODE_THRESHOLD) -> DataFrame:
    """One row per t: true-positive and false-positive ranges, F1 range, change of
    the mean negative count against the shipped threshold."""
    neg = per_run.filter(F.col("fixture") == "negative").groupBy("t").agg(F.avg("fp_neg").alias("fp_neg_mean"))
    pos = f1_per_run(per_run)
    rows = pos.groupBy("t").agg(
        F.min("tp").alias("tp_lo"), F.max("tp").alias("tp_hi"), F.min("fp_pos").alias("fp_pos_lo"),
        F.max("fp_pos").alias("fp_pos_hi"), F.min("f1").alias("min_f1"), F.max("f1").alias("max_f1")).join(neg, "t")
    base = neg.filter(F.col("t") == shipped).select("fp_neg_mean").scalar()
    return rows.withColumn("d_fp_neg", F.col("fp_neg_mean") - base)


def f1_per_run(per_run: DataFrame) -> DataFrame:
    """F1 of each positive run, negatives' mean false positives in the denominator."""
    neg = per_run.filter(F.col("fixture") == "negative").groupBy("t").agg(F.avg("fp_neg").alias("fp_neg_mean"))
    recall = F.when(F.col("n_golden") > 0, F.col("tp") / F.col("n_golden")).otherwise(0.0)
    den = F.col("tp") + F.col("fp_pos") + F.col("fp_neg_mean")
    precision = F.when(den > 0, F.col("tp") / den).otherwise(F.when(F.col("recall") == 1.0, 1.0).otherwise(0.0))
    return (per_run.filter(F.col("fixture") == "positive").join(neg, "t").withColumn("recall", recall)
            .withColumn("precision", precision)
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2.0 * F.col("precision") * F.col("recall")
                                     / (F.col("precision") + F.col("recall"))).otherwise(0.0)))


def candidate(curve: DataFrame) -> DataFrame:
    """The grid value with the best minimum F1; of ties the middle, of an even
    number of ties the lower middle.  ``curve`` has one row per grid value."""
    best = curve.agg(F.max_by(F.struct("min_f1"), "min_f1").alias("b"), F.collect_list(F.struct("t", "min_f1")).alias("rows"))
    tied = F.sort_array(F.transform(F.filter("rows", lambda r: r["min_f1"] == F.col("b.min_f1")), lambda r: r["t"]))
    return best.select(tied.alias("tied")).select(
        F.element_at("tied", F.floor((F.size("tied") - 1) / 2).cast("int") + 1).alias("candidate"),
        F.size("tied").alias("n_tied"))


def change_rules(per_run: DataFrame, chosen: DataFrame, shipped: float = K.CODE_THRESHOLD,
                 margin: float = K.MARGIN_FLOOR) -> DataFrame:
    """One row: candidate, margin rule in every positive run, no negative run worse, change."""
    f = f1_per_run(per_run).select("t", "run_id", "f1")
    base = f.filter(F.col("t") == shipped).select("run_id", F.col("f1").alias("base_f1"))
    cand = f.join(chosen, f["t"] == chosen["candidate"]).select("run_id", "f1", "candidate")
    rule1 = cand.join(base, "run_id").groupBy("candidate").agg(
        F.bool_and(F.col("f1") - F.col("base_f1") >= margin).alias("every_run"))
    neg = per_run.filter(F.col("fixture") == "negative").select("t", "run_id", "fp_neg")
    neg_base = neg.filter(F.col("t") == shipped).select("run_id", F.col("fp_neg").alias("base_fp"))
    rule2 = (neg.join(chosen, neg["t"] == chosen["candidate"]).join(neg_base, "run_id").groupBy("candidate")
             .agg(F.bool_and(F.col("fp_neg") <= F.col("base_fp")).alias("rule_neg_fp_ok")))
    return (rule1.join(rule2, "candidate")
            .withColumn("rule_margin_ok", F.col("every_run") & (F.col("candidate") != shipped))
            .withColumn("change", F.col("rule_margin_ok") & F.col("rule_neg_fp_ok")).drop("every_run"))


def sweep_decision(runs: DataFrame, judged: DataFrame, golden: DataFrame,
                   grid: Sequence[float] = tuple(K.THRESHOLD_GRID)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(curve, candidate, change rules).  The per-run counts, a few rows a run, are written
    once to the shared checkpoint folder and serve all three."""
    per_run = cut_lineage(sweep_runs(runs, judged, golden, grid))
    curve = sweep_curve(per_run)
    chosen = candidate(curve)
    return curve, chosen, change_rules(per_run, chosen)


def select_field_runs(runs: DataFrame, field_golden: DataFrame,
                      packaging_version: str = K.DEFAULT_PACKAGING_VERSION) -> tuple[DataFrame, DataFrame]:
    """(one run per pull request, errors).  Errors: gate rejects, unknown heads, pull
    requests without exactly one run."""
    gated = runs.withColumn("reject_reason", gate_reason(packaging_version))
    heads = field_golden.select("pr", F.col("sha").alias("fixture_head"))
    rejected = gated.filter(F.col("reject_reason").isNotNull()).select("label", F.col("reject_reason").alias("error"))
    good = gated.filter(F.col("reject_reason").isNull())
    unknown = good.join(heads, "fixture_head", "left_anti").select("label", F.lit("unknown-head").alias("error"))
    counts = heads.join(good.groupBy("fixture_head").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("one")),
                        "fixture_head", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    wrong = counts.filter("n <> 1").select(F.concat(F.lit("pr "), F.col("pr").cast("string")).alias("label"),
                                           F.concat(F.lit("runs:"), F.col("n").cast("string")).alias("error"))
    chosen = counts.filter("n = 1").select("pr", F.col("one").alias("label")).join(good, "label")
    return chosen, rejected.unionByName(unknown).unionByName(wrong)


def field_sweep(judged: DataFrame, field_runs: DataFrame, grid: Sequence[float] = tuple(K.THRESHOLD_GRID),
                t: float = K.CODE_THRESHOLD, include_test: bool = False) -> DataFrame:
    """False positives per (dt, pr) split by rubric, with the code gate pinned."""
    hold = () if include_test else tuple(K.HELD_CLASSES)
    rep = compose(with_grid(judged.join(field_runs.select("run_id", "pr"), "run_id"), grid, "dt"), t, F.col("dt"), hold)
    minor = is_minor_style(F.col("severity"), F.col("category"))
    deletion = F.coalesce("rubric", F.lit("code-change")) == "deletion"
    counts = rep.filter(F.col("severity").isNotNull()).groupBy("dt", "pr").agg(
        F.count_if(deletion & ~minor).alias("deletion_fp"), F.count_if(~deletion & ~minor).alias("code_fp"))
    zero = F.lit(0).cast("bigint")
    return (with_grid(field_runs.select("pr").distinct(), grid, "dt").join(counts, ["dt", "pr"], "left")
            .select("dt", "pr", F.coalesce("deletion_fp", zero).alias("deletion_fp"), F.coalesce("code_fp", zero).alias("code_fp")))


def field_decision(rows: DataFrame, shipped: float = K.DELETION_THRESHOLD) -> DataFrame:
    """Totals per dt and the decision read at the shipped deletion threshold."""
    totals = rows.groupBy("dt").agg(F.sum("deletion_fp").alias("deletion_total"), F.sum("code_fp").alias("code_total"))
    base = totals.filter(F.col("dt") == shipped).select(F.when(F.col("deletion_total") == 0, "KEEP").otherwise("RAISE_ABOVE_GRID")).scalar()
    return totals.withColumn("decision", base)
