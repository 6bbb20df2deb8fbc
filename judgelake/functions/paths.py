"""Path expressions: triage, test routing, helpers, validity checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from judgelake import constants as K

DOC_REASON = "docs/generated/lockfile"
DATA_REASON = "data/snapshot"
# Characters that end a line somewhere or are control characters.
CONTROL_CHARS = "[\\x00-\\x1f\\x7f\\x{85}\\x{2028}\\x{2029}]"


def path_triage_reason(path: Column) -> Column:
    """Why a path is never judged, or null."""
    p = F.coalesce(path, F.lit(""))
    skip = p.rlike(K.SKIP_NAMES_PATTERN) | p.rlike(K.SKIP_DIRS_PATTERN) | p.rlike(
        K.SKIP_ROOT_PATTERN) | p.rlike(K.DOC_PATTERN)
    return F.when(skip, DOC_REASON).when(p.rlike(K.DATA_PATTERN), DATA_REASON)


def segments(path: Column) -> Column:
    clean = F.lower(F.translate(F.coalesce(path, F.lit("")), "\\", "/"))
    return F.filter(F.split(clean, "/"), lambda s: s != "")


def reflex_class(path: Column) -> Column:
    """'test' from a test directory or a test file name, else 'code'."""
    parts = segments(path)
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    in_dir = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in K.TEST_DIRS]))
    by_name = ((name == "conftest.py") | name.contains(".test.") | name.contains(".spec.")
               | (name.startswith("test_") & name.contains(".")) | name.contains("_test."))
    return F.when(in_dir | by_name, "test").otherwise("code")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """Lower-case extension of the file name without the dot, '' when there is none."""
    return F.lower(F.regexp_extract(basename(path), "^\\.*[^.].*?\\.([^.]*)$|^$", 1))


def path_error(path: Column, nullable: bool = False) -> Column:
    """The first reason a document path is rejected, or null."""
    reason = (
        F.when(path == "", "must not be empty")
        .when(F.length(path) > K.INPUT_MAX_PATH_CHARS,
              f"longer than {K.INPUT_MAX_PATH_CHARS} characters")
        .when(path.rlike(CONTROL_CHARS), "path contains a control character")
        .when(F.translate(path, "\\", "/") == "/dev/null", "path must not be /dev/null"))
    return reason if nullable else F.when(path.isNull(), "missing").otherwise(reason)


def label_error(label: Column, required: bool = True) -> Column:
    """The first reason a head or repo label is rejected, or null."""
    reason = (
        F.when(F.length(label) > K.INPUT_MAX_LABEL_CHARS,
               f"longer than {K.INPUT_MAX_LABEL_CHARS} characters")
        .when(label.rlike(CONTROL_CHARS), "contains a control character"))
    if not required:
        return reason
    return F.when(label.isNull(), "missing").when(label == "", "must not be empty").otherwise(reason)


def head_is_sha(head: Column) -> Column:
    return F.coalesce(head.rlike(K.SHA40_PATTERN), F.lit(False))


def triple_dot(rng: Column) -> Column:
    """A..B becomes A...B, an open side becomes HEAD, anything else is unchanged."""
    two = (F.size(F.split(rng, "\\.\\.")) == 2) & ~rng.contains("...")
    left = F.substring_index(rng, "..", 1)
    right = F.substring_index(rng, "..", -1)

    def fill(c):
        return F.when(c == "", "HEAD").otherwise(c)

    return F.when(two, F.concat(fill(left), F.lit("..."), fill(right))).otherwise(rng)


def enrichment_stamp(path: Column, has_context: Column) -> Column:
    ts = extension(path).isin(K.ENRICHABLE_EXTENSIONS["ts-ast"])
    return F.when(~F.coalesce(has_context, F.lit(False)), "none").when(ts, "ts-ast").otherwise("ast")
