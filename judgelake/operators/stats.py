"""Ledger statistics: sustained rates, ship and retire rules, screens, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions.paths import reflex_class
from judgelake.functions.scores import try_ratio
from judgelake.session import checkpoint_dir


def sustained_rates(firings: DataFrame, by: Sequence[str] = ("class",)) -> DataFrame:
    """Firings, adjudicated, sustained, rate and cost per sustained finding.

    ``firings``: class columns, sustained (null while not adjudicated), cost.
    """
    out = firings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_firings"), F.count("sustained").alias("n_adjudicated"),
        F.count_if("sustained").alias("n_sustained"), F.sum("cost").alias("cost"))
    return (out.withColumn("sustained_rate", try_ratio(F.col("n_sustained"), F.col("n_adjudicated")))
            .withColumn("cost_per_sustained", try_ratio(F.col("cost"), F.col("n_sustained"))))


def class_status(outcomes: DataFrame, window: int = K.RETIRE_WINDOW) -> DataFrame:
    """ship / hold / retire per class from adjudicated outcomes (class, ts, id, sustained).

    The last ``window`` outcomes are found by a rank filter that Spark cuts before
    the shuffle, so a hot class costs ``window`` rows per task.
    """
    w = Window.partitionBy("class").orderBy(F.col("ts").desc(), F.col("id").desc())
    last = (outcomes.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= window).groupBy("class")
            .agg(F.count(F.lit(1)).alias("n_last"), F.count_if("sustained").alias("s_last")))
    total = outcomes.groupBy("class").agg(F.count(F.lit(1)).alias("n_adjudicated"), F.count_if("sustained").alias("n_sustained"))
    rate, recent = F.col("n_sustained") / F.col("n_adjudicated"), F.col("s_last") / F.col("n_last")
    return (total.join(last, "class").withColumn("rate", rate).withColumn("recent_rate", recent)
            .withColumn("status", F.when((F.col("n_last") >= window) & (F.col("recent_rate") < K.RETIRE_RATE), "retire")
                        .when((F.col("n_adjudicated") >= K.SHIP_MIN) & (F.col("rate") >= K.SHIP_RATE), "ship").otherwise("hold"))
            .drop("s_last"))


def with_position(rows: DataFrame, key: str, order: list[str], parts: int | None = None) -> DataFrame:
    """Adds ``pos``, the 0-based place of a row in its ``key`` by ``order``.

    Rows are ranged by key and order, so a key with most of the rows, even at one time,
    is spread over many tasks; a part knows its rows by their number in it, and the counts
    of the parts before, one row a part and key, shift them.  The ranged rows are
    written once, as both the counts and the rows must come from the same parts.  Their
    number follows from the size of the rows unless ``parts`` is given.
    """
    checkpoint_dir(rows.sparkSession)
    ranged = rows.repartitionByRange(*([parts] if parts else []), key, *order)
    placed = (ranged.sortWithinPartitions(key, *order)
             .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).checkpoint(eager=False))
    sizes = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (placed.join(shift, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
            .withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_key", "_p", "_shift"))


def rolling_rate(outcomes: DataFrame, window: int = K.RETIRE_WINDOW, chunk: int = 100_000) -> DataFrame:
    """Sustained rate over each outcome and the ``window - 1`` before it in its class.

    Outcomes get a position in their class, then are cut into chunks of ``chunk``
    positions, each with the ``window - 1`` rows before it, so that a class with most of
    the rows, on one day or at one time, is spread over many tasks.  Outcomes of equal
    time and id are ordered by their verdict.
    """
    if chunk < window:
        raise ValueError("a chunk must hold a window")
    placed = with_position(outcomes, "class", ["ts", "id", "sustained"])
    home = F.floor(F.col("pos") / chunk)
    copies = placed.withColumn("_home", home).withColumn("_chunk", F.explode(F.array_distinct(F.array(
        home, F.floor((F.col("pos") + window - 1) / chunk)))))
    w = Window.partitionBy("class", "_chunk").orderBy("pos").rowsBetween(-(window - 1), 0)
    return (copies.withColumn("n_window", F.count(F.lit(1)).over(w))
            .withColumn("rate", F.sum(F.when(F.col("sustained"), 1).otherwise(0)).over(w) / F.col("n_window"))
            .filter(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home"))


def arm_rates(adjudications: DataFrame, stop: int = K.ARM_STOP_FINDINGS) -> DataFrame:
    """Per arm: REAL and FP among its first ``stop`` adjudicated findings (DUP left out),
    the sustained rate, and whether the stop is reached.

    ``adjudications``: arm, ord, verdict.  The running count is a rank filter.
    """
    w = Window.partitionBy("arm").orderBy("ord")
    first = (adjudications.filter(F.col("verdict").isin("REAL", "FP")).withColumn("k", F.row_number().over(w))
             .filter(F.col("k") <= stop))
    out = first.groupBy("arm").agg(F.count_if(F.col("verdict") == "REAL").alias("n_real"), F.count_if(F.col("verdict") == "FP").alias("n_fp"))
    return (out.withColumn("sustained_rate", try_ratio(F.col("n_real"), F.col("n_real") + F.col("n_fp")))
            .withColumn("stopped", F.col("n_real") + F.col("n_fp") >= stop))


def arm_decision(rates: DataFrame, n_prs: DataFrame | None = None, max_prs: int = K.ARM_STOP_PRS) -> DataFrame:
    """One row: both rates and whether the default stays, may flip, or is still open."""
    on, off = F.col("arm") == "on", F.col("arm") == "off"
    one = rates.agg(F.max(F.when(on, F.col("sustained_rate"))).alias("on_rate"), F.max(F.when(off, F.col("sustained_rate"))).alias("off_rate"),
                    F.count_if("stopped").alias("n_stopped"))
    if n_prs is None:
        one = one.withColumn("n_prs", F.lit(0).cast("bigint"))
    else:
        one = one.withColumn("n_prs", n_prs.agg(F.count_distinct("pr")).scalar())
    done = (F.col("n_stopped") == 2) | (F.col("n_prs") >= max_prs)
    return one.withColumn("decision", F.when(~done, "open").when(F.col("on_rate").isNull() | F.col("off_rate").isNull(), "keep")
                          .when(F.col("on_rate") >= F.col("off_rate"), "keep").otherwise("flip"))


def detector_screen(fires: DataFrame) -> DataFrame:
    """Detectors that fire on clean heads at least as often as on positive ones are dropped.

    ``fires``: detector, kind ('clean' or 'positive'), fired.
    """
    rate = fires.groupBy("detector").pivot("kind", ["clean", "positive"]).agg(F.avg(F.col("fired").cast("int")))
    return rate.select("detector", F.coalesce("clean", F.lit(0.0)).alias("clean_rate"), F.coalesce("positive", F.lit(0.0)).alias("positive_rate")).withColumn(
        "dropped", F.col("clean_rate") >= F.col("positive_rate"))


def routing_audit(files: DataFrame) -> DataFrame:
    """Curated label (production or test) against the routed class, with counts."""
    return files.withColumn("routed", reflex_class(F.col("path"))).groupBy("label", "routed").agg(F.count(F.lit(1)).alias("n"))


def routing_gate(audit: DataFrame) -> DataFrame:
    """Passes when no production file is routed to the test variant."""
    bad = F.coalesce(F.sum(F.when((F.col("label") == "production") & (F.col("routed") == "test"), F.col("n"))), F.lit(0).cast("bigint"))
    return audit.agg(bad.alias("production_as_test")).withColumn("passes", F.col("production_as_test") == 0)


def change_classes(changes: DataFrame, by: Sequence[str] = ("range_id",)) -> DataFrame:
    """Negative class flags of a range from its files (path, old_path, before, after):
    docs-only, lockfile, generated, rename-only, whitespace-only, test-only."""
    p = F.col("path")

    def bare(c):
        return F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", "")

    same = F.col("before").eqNullSafe(F.col("after"))
    flags = {
        "docs_only": p.rlike(K.DOC_PATTERN), "lockfile": p.rlike(K.LOCK_NAMES_PATTERN), "generated": p.rlike(K.SKIP_DIRS_PATTERN),
        "rename_only": same & F.coalesce(F.col("old_path") != p, F.lit(False)),
        "whitespace_only": F.col("before").isNotNull() & F.col("after").isNotNull() & ~same & (bare(F.col("before")) == bare(F.col("after"))),
        "test_only": reflex_class(p) == "test"}
    return changes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), *[F.bool_and(v).alias(k) for k, v in flags.items()])


CLASS_FLAGS = ["docs_only", "lockfile", "generated", "rename_only", "whitespace_only", "test_only"]


def class_yield(classes: DataFrame, sustained: DataFrame, by: Sequence[str] = ("range_id",)) -> DataFrame:
    """Ranges and sustained findings per negative class (one finding per row in ``sustained``)."""
    counts = sustained.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sustained"))
    rows = classes.unpivot(list(by), CLASS_FLAGS, "class", "member").filter("member").join(counts, list(by), "left")
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("n_ranges"), F.coalesce(F.sum("n_sustained"), F.lit(0).cast("bigint")).alias("n_sustained"))


def score_distribution(judged: DataFrame, value: str, by: Sequence[str], bins: int = 10, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Histogram rows per group; values at the top edge fall in the last bin."""
    width = F.least(F.lit(bins), F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).cast("int"))
    return judged.filter(F.col(value).isNotNull()).withColumn("bin", width).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(rows: DataFrame, value: str, by: Sequence[str], shares: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """by, n, q: the exact quantiles of ``value`` per group, between two values in proportion.

    A sketch of bounded size brackets each quantile; what lies below a bracket is counted,
    and only the distinct values within it are put in order, about ``8 / accuracy`` of a
    group, or all of a group of up to ``accuracy`` rows.  Nulls and NaN are left out.
    """
    v, places = F.col(value).cast("double"), range(len(shares))
    rows = rows.select(*by, v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = [float(min(1.0, max(0.0, q + d))) for q in shares for d in (-4 / accuracy, 4 / accuracy)]
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", ends, accuracy).alias("ends"), F.min("v").alias("low"), F.max("v").alias("high"))
    wide = F.col("n") > accuracy  # else the sketch's ranks are closer than its error

    def end(k, edge):
        return F.when(wide & F.lit(0.0 < ends[k] < 1.0), F.get("ends", F.lit(k))).otherwise(F.col(edge))

    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("share"), end(2 * i, "low").alias("lo"), end(2 * i + 1, "high").alias("hi")) for i, q in enumerate(shares)])
    sketch = sketch.select(*[F.col(c).alias(f"_{c}") for c in by], "n", around.alias("around"))
    met = rows.join(sketch, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).drop(*[f"_{c}" for c in by])
    # per quantile one counter for all below, and the values inside
    inside = F.filter(F.transform("around", lambda a: F.struct(a["i"], a["share"], F.when(F.col("v") >= a["lo"], F.col("v")).alias("at"), (F.col("v") <= a["hi"]).alias("in_reach"))), lambda a: a["in_reach"])
    counts = met.select(*by, "n", "v", F.inline(inside)).groupBy(*by, "n", "i", "share", "at").agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "i").orderBy(F.col("at").asc_nulls_first())))
    place = (F.col("n") - 1) * F.col("share")
    pair = upto.filter(F.col("at").isNotNull()).groupBy(*by, "n", "i", "share").agg(
        F.min(F.when(F.col("upto") > F.floor(place), F.col("at"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil(place), F.col("at"))).alias("b"))
    between = F.when(F.floor(place) == F.ceil(place), F.col("a")).otherwise((F.ceil(place) - place) * F.col("a") + (place - F.floor(place)) * F.col("b"))
    return pair.groupBy(*by, "n").agg(F.array(*[F.max(F.when(F.col("i") == i, between)) for i in places]).alias("q"))


def score_quantiles(judged: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count and exact quartiles per group."""
    return exact_quantiles(judged, value, by, (0.25, 0.5, 0.75)).select(
        *by, "n", *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(("q25", "median", "q75"))])
