"""Unified diffs to changed-line clusters, by windows over exploded lines.

A diff text is one cell.  Texts are hash partitioned by change once, before they
are exploded; every window and aggregate below is keyed by the change (or finer),
so no further shuffle is needed and a task never holds more than whole diffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions.paths import path_triage_reason
from judgelake.functions.texts import references_remaining


def header_path(text: Column, prefix: str) -> Column:
    raw = F.substring_index(F.substr(text, F.lit(5)), "\t", 1)
    return F.when(raw.startswith(prefix), F.substr(raw, F.lit(3))).otherwise(raw)


def parse_diff(diffs: DataFrame) -> DataFrame:
    """Entries of every diff: change_id, file, file_deleted, hunk_no, pos, kind, new_line,
    old_line, head_line, text, old_at, hunk_start.

    ``diffs``: change_id, diff_text; or hunks of large diffs as ``changes.read_diff_hunks``
    gives them, which are parsed one by one, so a diff is spread over many tasks.  Lines
    end at '\\n' only.  Inside a hunk every
    line is content until the counts of its header are used up; only then does a
    file header line open the next file.  A deletion's ``head_line`` is the position
    in the new file, clamped to the hunk.
    """
    by_hunk = "hunk_no" in diffs.columns
    c, first = (["change_id", "hunk_no"], ["first_pos"]) if by_hunk else (["change_id"], [])
    lines = F.split("diff_text", "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    raw = (diffs.select(*c, *first, "diff_text").repartition(*c)
           .select(*c, *first, F.posexplode(lines).alias("pos", "raw"))
           .select(*c, (F.col("pos") + (F.col("first_pos") if by_hunk else F.lit(0))).alias("pos"), F.regexp_replace("raw", r"\r+\z", "").alias("line")))
    seen = Window.partitionBy(*c).orderBy("pos")
    # a segment never falls as the position rises, so this is the same order, and the rows lie in it once they lie by segment
    along = Window.partitionBy(*c).orderBy("seg", "pos")
    line = F.col("line")
    is_git, is_hunk = line.startswith("diff --git "), line.startswith("@@")
    old_head, new_head = line.startswith("--- "), line.startswith("+++ ")

    def num(i: int, missing: int) -> Column:
        g = F.regexp_extract(line, K.HUNK_HEADER_PATTERN, i)
        return F.when(is_hunk, F.when(~line.rlike(K.HUNK_HEADER_PATTERN), missing).otherwise(F.coalesce(g.try_cast("int"), F.lit(1))))

    marked = (raw.withColumn("seg", F.sum(F.when(is_git | is_hunk, 1).otherwise(0)).over(seen))
              .withColumns({"old_start": num(1, 1), "old_count": num(2, 0), "new_start": num(3, 1), "new_count": num(4, 0)}))
    seg = Window.partitionBy(*c, "seg").orderBy("pos")
    before = seg.rowsBetween(Window.unboundedPreceding, -1)
    in_hunk = F.coalesce(F.first("old_start", ignorenulls=True).over(seg).isNotNull() & ~is_hunk & ~is_git, F.lit(False))
    kind = F.when(line.startswith("+"), "+").when(line.startswith("-"), "-").when(line.startswith("\\"), "\\").otherwise(" ")
    whole = {n: F.first(n, ignorenulls=True).over(seg) for n in ("old_start", "old_count", "new_start", "new_count")}
    marked = marked.withColumn("in_hunk", in_hunk).withColumns(whole).withColumn("kind", F.when(F.col("in_hunk"), kind))
    takes_old, takes_new = F.col("kind").isin("-", " "), F.col("kind").isin("+", " ")

    def used(takes, w):
        return F.coalesce(F.sum(F.when(takes, 1).otherwise(0)).over(w), F.lit(0))

    marked = marked.withColumn("spent", F.col("in_hunk") & (used(takes_old, before) >= F.col("old_count"))
                               & (used(takes_new, before) >= F.col("new_count")))
    opens = F.col("spent") & (old_head | new_head)
    marked = marked.withColumn("past", F.coalesce(F.max(opens).over(seg), F.lit(False)))
    content = F.col("in_hunk") & ~F.col("past") & (F.col("kind") != "\\") & ~(F.col("spent") & line.startswith("diff "))
    first_past = F.col("past") & ~F.coalesce(F.lag("past").over(seg), F.lit(False))
    marked = marked.withColumn("content", content).withColumns(
        {"at_new": F.col("new_start") + used(F.col("content") & takes_new, before), "at_old": F.col("old_start") + used(F.col("content") & takes_old, before)})
    marked = marked.withColumn("section", F.sum(F.when(is_git | first_past, 1).otherwise(0)).over(along))
    in_head = ~F.col("content") & ~F.col("in_hunk") | F.col("past")
    section = Window.partitionBy(*c, "section")
    old_path, new_path = header_path(line, "a/"), header_path(line, "b/")
    marked = (marked.withColumn("old_path", F.when(in_head & old_head & (old_path != "/dev/null"), old_path))
              .withColumn("new_path", F.when(in_head & new_head & (new_path != "/dev/null"), new_path))
              .withColumn("gone", in_head & new_head & (new_path == "/dev/null"))
              .withColumn("file", F.coalesce(
                  F.max_by("new_path", F.when(F.col("new_path").isNotNull(), F.col("pos"))).over(section),
                  F.min_by("old_path", F.when(F.col("old_path").isNotNull(), F.col("pos"))).over(section)))
              .withColumn("file_deleted", F.max("gone").over(section)))
    body = marked.filter(F.col("content") & F.col("file").isNotNull())
    hunk_end = F.greatest(F.lit(1), F.when(F.col("new_count") == 0, F.col("new_start")).otherwise(F.col("new_start") + F.col("new_count") - 1))
    return body.select(
        "change_id", "file", "file_deleted", F.col("hunk_no" if by_hunk else "seg").cast("int").alias("hunk_no"), "pos", "kind",
        F.when(F.col("kind") != "-", F.col("at_new")).cast("int").alias("new_line"),
        F.when(F.col("kind") != "+", F.col("at_old")).cast("int").alias("old_line"),
        F.when(F.col("kind") == "-", F.greatest(F.lit(1), F.least(F.col("at_new"), hunk_end))).otherwise(F.col("at_new")).cast("int").alias("head_line"),
        F.substring(line, 2, 2_000_000_000).alias("text"),
        F.col("at_old").cast("int").alias("old_at"), F.col("new_start").cast("int").alias("hunk_start"))


def cluster_members(entries: DataFrame, context: int = K.CONTEXT_LINES) -> DataFrame:
    """Entries with the cluster they belong to: runs of changed lines inside one hunk
    and up to ``context`` lines around them.

    ``run`` numbers the clusters of a hunk.  A context line between two clusters may
    belong to both; a changed line belongs to its own cluster only (``own``).
    """
    hunk = ["change_id", "hunk_no"]
    w = Window.partitionBy(*hunk).orderBy("pos")
    changed = F.col("kind") != " "
    idx = entries.withColumn("idx", F.row_number().over(w))
    starts = changed & F.coalesce(F.lag("kind").over(w) == " ", F.lit(True))
    idx = idx.withColumn("n_before", F.sum(F.when(starts, 1).otherwise(0)).over(w)).withColumn(
        "last_end", F.last(F.when(changed, F.col("idx")), ignorenulls=True).over(w)).withColumn(
        "next_start", F.first(F.when(changed, F.col("idx")), ignorenulls=True).over(
            w.rowsBetween(0, Window.unboundedFollowing)))
    near_last = ~changed & (F.col("idx") - F.col("last_end") <= context)
    near_next = ~changed & (F.col("next_start") - F.col("idx") <= context)
    runs = F.filter(F.array(
        F.when(changed | F.coalesce(near_last, F.lit(False)), F.struct(F.col("n_before").alias("run"), changed.alias("own"))),
        F.when(F.coalesce(near_next, F.lit(False)), F.struct((F.col("n_before") + 1).alias("run"), F.lit(False).alias("own")))),
        lambda m: m.isNotNull())
    return idx.select(*entries.columns, F.inline(runs)).withColumn("run", F.col("run").cast("int"))


def clusters(members: DataFrame, max_lines: int = K.MAX_UNIT_LINES, with_entries: bool = False) -> DataFrame:
    """One row per cluster: anchor, span, header, counts and change type.

    ``with_entries`` keeps the window's lines as an array, which ``unit_states`` reads;
    a window is at most a run of changes and eight lines around it.
    """
    key = ["change_id", "file", "hunk_no", "run"]
    own, plus, minus = F.col("own"), F.col("kind") == "+", F.col("kind") == "-"
    out = members.groupBy(*key).agg(
        F.first("hunk_start").alias("hunk_start"), F.first("file_deleted").alias("file_deleted"),
        F.min("pos").alias("ord"),
        F.coalesce(F.min_by("new_line", F.when(own & plus, F.col("pos"))),
                   F.min_by("head_line", F.when(own & minus, F.col("pos"))), F.first("hunk_start")).alias("line"),
        F.min("head_line").alias("line_start"), F.max("head_line").alias("line_end"),
        F.count_if(own).cast("int").alias("n_changed"), F.count(F.lit(1)).cast("int").alias("size"),
        F.max(own & plus).alias("adds"),
        *([F.sort_array(F.collect_list(F.struct("pos", "kind", "text"))).alias("entries")] if with_entries else []))
    kind = F.when(F.col("adds"), "code-change").when(F.col("file_deleted"), "whole-file-deleted").otherwise("deletion-only")
    return (out.withColumn("change_type", kind).withColumn("too_large", F.col("size") > max_lines)
            .withColumn("header", F.format_string("@@ %s around line %d (%d changed lines) @@", "file", "line", "n_changed"))
            .drop("adds", "file_deleted"))


def package_diffs(diffs: DataFrame) -> DataFrame:
    """Diff texts to clusters."""
    return clusters(cluster_members(parse_diff(diffs)))


def triage(units: DataFrame, can_split: bool = True, max_lines: int = K.MAX_UNIT_LINES) -> DataFrame:
    """Adds ``reason``: why a unit is skipped, or null when it is judged.

    A provider whose large units can be split skips only large deleted files; one
    that takes whole clusters skips everything over ``max_lines``.
    """
    large = F.col("size") > max_lines
    by_size = (F.when(large & (F.col("change_type") == "whole-file-deleted"), "whole-file-deleted>cap") if can_split
               else F.when(large, f"hunk>{max_lines} lines"))
    return units.withColumn("reason", F.coalesce(path_triage_reason(F.col("file")), by_size))


def kept(triaged: DataFrame) -> DataFrame:
    return triaged.filter(F.col("reason").isNull()).drop("reason")


def skipped(triaged: DataFrame) -> DataFrame:
    by_path = F.col("reason").isin("docs/generated/lockfile", "data/snapshot")
    return triaged.filter(F.col("reason").isNotNull()).select(
        "change_id", "ord", "file", "reason", F.when(~by_path, F.col("change_type")).alias("change_type"), "line_start", "line_end")


def ceiling(units: DataFrame, n: int, run_cols=("change_id",)) -> DataFrame:
    """Adds ``judged``: the first ``n`` units of a run in arrival order."""
    w = Window.partitionBy(*run_cols).orderBy("ord")
    return units.withColumn("judged", F.row_number().over(w) <= n)


def wire_format(units: DataFrame, run_cols=("run_id",)) -> DataFrame:
    """The highest-precedence cut among a run's units."""
    order = F.array(*[F.lit(f) for f in K.WIRE_FORMATS])
    cut = F.when(F.array_contains(order, F.col("cut")), F.col("cut")).otherwise("hunk")
    return units.groupBy(*run_cols).agg(F.max_by(cut, F.array_position(order, cut)).alias("wire_format"))


def stamp_conflicts(units: DataFrame, runs: DataFrame, run_cols=("run_id",)) -> DataFrame:
    """Runs whose stamped wire format is not the one their units imply."""
    seen = wire_format(units, run_cols).withColumnRenamed("wire_format", "implied")
    return runs.select(*run_cols, "wire_format").join(seen, list(run_cols), "left").filter(
        ~F.coalesce("implied", F.lit("hunk")).eqNullSafe(F.col("wire_format")))


def undistinguished_arms(runs: DataFrame) -> DataFrame:
    """Ranges whose two arms carry the same wire format; rows: range, arm, wire_format."""
    return runs.groupBy("range").agg(
        F.count_distinct("arm").alias("n_arms"), F.count_distinct("wire_format").alias("n_formats")).filter(
        (F.col("n_arms") > 1) & (F.col("n_formats") < 2))


def run_enrichment(units: DataFrame, run_cols=("run_id",)) -> DataFrame:
    """Sorted distinct enrichment stamps of a run joined by '+', or 'none'."""
    stamps = F.sort_array(F.collect_set(F.when(F.col("enrichment") != "none", F.col("enrichment"))))
    return units.groupBy(*run_cols).agg(stamps.alias("s")).select(
        *run_cols, F.when(F.size("s") > 0, F.array_join("s", "+")).otherwise("none").alias("enrichment"))


def unit_states(units: DataFrame) -> DataFrame:
    """Model input of each cluster (with entries): before and after lines in order, change
    type, for deletions whether a removed name still stands in view, and, where the units
    have a column ``ast_context`` (see ``units.contexts``) that is not null, that context."""

    def side(*kinds):
        return F.transform(F.filter("entries", lambda x: x["kind"].isin(*kinds)), lambda x: x["text"])

    built = (units.withColumn("before", side("-", " ")).withColumn("after", side("+", " "))
             .withColumn("references_remaining", references_remaining(F.col("change_type"), side("-"), F.col("after"))))
    context = ["ast_context"] if "ast_context" in units.columns else []
    state = F.struct("file", F.concat(F.lit("around line "), F.col("line").cast("string")).alias("location"), "change_type",
                     F.col("before").alias("code_before_change"), F.col("after").alias("code_after_change"), "references_remaining", *context)
    return built.withColumn("state", F.to_json(state)).drop("entries", "before", "after", *context)
