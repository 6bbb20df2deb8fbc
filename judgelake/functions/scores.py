"""Severity, score and gate expressions over single rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from judgelake import constants as K


def sev_level(v: Column) -> Column:
    """Nearest integer level in 0..3, halves up; a missing severity is level 0."""
    rounded = F.floor(F.coalesce(v.cast("double"), F.lit(0.0)) + F.lit(0.5))
    return F.least(F.lit(3), F.greatest(F.lit(0), rounded)).cast("int")


def sev_name(v: Column) -> Column:
    level = sev_level(v)
    out = F.lit(K.SEVERITY_NAMES[0])
    for i, name in enumerate(K.SEVERITY_NAMES[1:], 1):
        out = F.when(level == i, name).otherwise(out)
    return out


def near(v: Column, t, zone: float = K.JITTER_ZONE) -> Column:
    """Inclusive distance test on doubles; a missing value is never near."""
    return F.coalesce(F.abs(v - t) <= F.lit(zone), F.lit(False))


def own_threshold(rubric: Column, t, dt) -> Column:
    """Each rubric is gated by its own threshold; no rubric means code-change."""
    return F.when(F.coalesce(rubric, F.lit("code-change")) == "deletion", dt).otherwise(t)


def is_minor_style(severity: Column, category: Column) -> Column:
    return (sev_level(severity) == 1) & F.coalesce(category == "style", F.lit(False))


def finite(v: Column) -> Column:
    """True for a real finite number (missing, NaN and infinities are false)."""
    d = v.try_cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def is_disagreement(disposition: Column, label: Column) -> Column:
    """Thread outcome and adjudicated label point in opposite directions."""
    return ((disposition == "fixed") & (label == "false-positive")) | (
        disposition.isin("not-applied", "unaddressed") & (label == "real-bug"))


def try_ratio(num: Column, den: Column) -> Column:
    """num/den as double, null when the denominator is zero or missing."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2.0 * precision * recall / (precision + recall))
