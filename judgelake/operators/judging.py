"""Judgment in batch: routing, scoring, answer parsing, run outcome.

The scorer is a user function over a pandas frame of serialised states; it runs in
``mapInArrow``, so batches stream through Arrow and no group is formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions.scores import finite, sev_name

Scorer = Callable[[pd.DataFrame], pd.DataFrame]

#: States that are Python strings at one time.
SCORED_ROWS = 256

ANSWER_SCHEMA = (
    "answers struct<severity:struct<score:string,probabilities:map<string,double>,confidence:double>,"
    "is_real_issue:struct<noul:string>,category:struct<choice:string,probabilities:map<string,double>>>,"
    "usage struct<input_tokens:double>")


def rubric(change_type: Column) -> Column:
    return F.when(change_type.isin(*K.DELETION_CHANGE_TYPES), "deletion").otherwise("code-change")


def route(units: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds the rubric and its questions (``questions``: rubric, questions)."""
    return units.withColumn("rubric", rubric(F.col("change_type"))).join(questions, "rubric", "left")


def score_units(units: DataFrame, scorer: Scorer, keys: Sequence[str] = ("unit_id",)) -> DataFrame:
    """Keys, payload (JSON text or null) and latency_ms of every unit.

    ``scorer`` gets columns state and questions and returns payload and latency_ms in
    the same order.  It is called for ``SCORED_ROWS`` rows at a time: states as Python
    strings take several times their room in a batch.
    """
    cols = [*keys, "state", "questions"]
    schema = ", ".join([f"{k} {units.schema[k].dataType.simpleString()}" for k in keys] + ["payload string", "latency_ms double"])
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                rows = batch.slice(at, SCORED_ROWS)
                answers = scorer(rows.select(["state", "questions"]).to_pandas())
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(name) for name in names), pa.array(answers["payload"], pa.string(), from_pandas=True),
                     pa.array(answers["latency_ms"], pa.float64(), from_pandas=True)], names=[*names, "payload", "latency_ms"])

    return units.select(*cols).mapInArrow(run, schema)


def parse_answers(calls: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds severity, is_real, category, confidence, input_tokens and ``outcome``:
    ok, shape (answers missing, not finite or of the wrong type) or transport (no
    payload).  An absent score is 0.  A score and is_real must be JSON numbers or booleans;
    null is neither.
    """
    def kind(path):
        return F.schema_of_variant(F.try_variant_get("_v", path, "variant"))

    out = calls.withColumns({"_a": F.from_json(payload, ANSWER_SCHEMA), "_v": F.try_parse_json(payload)})
    out = out.withColumns({"_t": kind("$.answers.is_real_issue.noul"), "_s": kind("$.answers.severity.score")}).drop("_v")
    a = F.col("_a.answers")
    noul = a["is_real_issue"]["noul"]

    def number(name, text):
        return F.when(F.col(name) == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).when(
            F.col(name).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), text.try_cast("double"))

    real = number("_t", noul)
    score = F.when(F.col("_s").isNull(), F.lit(0.0)).otherwise(number("_s", a["severity"]["score"]))
    whole = a["severity"].isNotNull() & a["is_real_issue"].isNotNull() & a["category"].isNotNull()
    ok = F.coalesce(whole & finite(score) & finite(real), F.lit(False))
    outcome = F.when(F.col(payload).isNull(), "transport").when(ok, "ok").otherwise("shape")
    out = out.withColumn("outcome", outcome)
    good = F.col("outcome") == "ok"
    return out.withColumns({
        "severity": F.when(good, score), "is_real": F.when(good, real), "category": F.when(good, a["category"]["choice"]),
        "confidence": F.when(good, a["severity"]["confidence"]), "input_tokens": F.col("_a.usage.input_tokens")}).drop("_a", "_t", "_s")


def fail_open(calls: DataFrame, run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per run: whether it fails open, and its call counts.

    A run fails open when a transport failure follows a transport or shape failure,
    or a shape failure follows a shape failure, with no success between; or when
    nothing parsed and no unit was set aside for its budget.  ``calls``: run columns,
    ord, outcome (ok, transport, shape, leaf); leaves never reach the provider.
    """
    w = Window.partitionBy(*run_cols).orderBy("ord")
    sent = calls.filter(F.col("outcome") != "leaf").withColumn("prev", F.lag("outcome").over(w))
    pair = ((F.col("outcome") == "transport") & F.col("prev").isin("transport", "shape")) | (
        (F.col("outcome") == "shape") & (F.col("prev") == "shape"))
    pairs = sent.groupBy(*run_cols).agg(F.max(F.coalesce(pair, F.lit(False))).alias("pair"))
    counts = calls.groupBy(*run_cols).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("outcome") == "ok").alias("n_ok"), F.count_if(F.col("outcome") == "leaf").alias("n_leaf"))
    return counts.join(pairs, list(run_cols), "left").withColumn(
        "fail_open", F.coalesce("pair", F.lit(False)) | ((F.col("n_ok") == 0) & (F.col("n_leaf") == 0))).drop("pair")


def call_stats(calls: DataFrame, run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """Total and mean latency (one decimal) and mean input tokens where reported."""
    return calls.groupBy(*run_cols).agg(
        F.round(F.sum("latency_ms"), 1).alias("total_latency_ms"), F.round(F.avg("latency_ms"), 1).alias("avg_call_ms"),
        F.avg("input_tokens").alias("avg_input_tokens"))


def coverage(runs: DataFrame) -> DataFrame:
    """Adds n_units_total, n_judged and ``status`` to per-run counts (n_units_pre,
    added_units, n_unjudged, n_dropped, n_size_skipped_code, fail_open)."""
    total = F.col("n_units_pre") + F.col("added_units")
    short = (F.col("n_unjudged") > 0) | (F.col("n_dropped") > 0) | (F.col("n_size_skipped_code") > 0)
    return (runs.withColumn("n_units_total", total).withColumn("n_judged", total - F.col("n_unjudged"))
            .withColumn("status", F.when(F.col("fail_open"), "fail-open").when(short, "incomplete review").otherwise("ok")))


def digest_label(reason: str = "skip_reason") -> Column:
    """One digest line of a finding: judged, skipped for a reason, or a failed call."""
    at = F.concat(F.lit("- "), "file", F.lit(":"), F.col("line").cast("string"))
    bad = F.coalesce("parse_error", F.lit(False))
    category = F.coalesce("category", F.lit("None"))
    return (F.when(bad & F.col(reason).isNotNull(), F.concat(at, F.lit(" unjudged (skipped: "), reason, F.lit(")")))
            .when(bad, F.concat(at, F.lit(" unjudged (provider call failed)")))
            .otherwise(F.concat(at, F.lit(" severity="), sev_name(F.col("severity")), F.lit(" category="), category)))


def run_digest(findings: DataFrame, size_skips: DataFrame, runs: DataFrame, run_cols: Sequence[str] = ("run_id",)) -> DataFrame:
    """(run, digest): finding lines in order, then the code left out for its size.

    A digest is the text of one model call, so its lines are those of one run record.
    """
    skip = size_skips.select(*run_cols, F.lit(1).alias("z"), "ord", F.concat(
        F.lit("- "), "file", F.lit(":"), F.coalesce(F.col("line_start").cast("string"), F.lit("?")), F.lit(" unjudged (skipped: "), "reason", F.lit(")")).alias("text"))
    lines = findings.select(*run_cols, F.lit(0).alias("z"), "ord", digest_label().alias("text")).unionByName(skip)
    text = lines.groupBy(*run_cols).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("z", "ord", "text"))), lambda x: x["text"]), "\n").alias("digest"))
    return runs.select(*run_cols).join(text, list(run_cols), "left").withColumn("digest", F.coalesce("digest", F.lit("no per-hunk findings")))
