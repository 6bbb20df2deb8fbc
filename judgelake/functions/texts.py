"""Text expressions: line splitting, size caps, names, labels, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from judgelake import constants as K


def split_lines(text: Column) -> Column:
    """Lines split on newline only, without terminators and without a last empty line.

    Null and '' give an empty array; see ``lacks_final_newline`` for the flag of
    a last line that has no terminator.
    """
    parts = F.split(text, "\n", -1)
    body = F.when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(body)


def lacks_final_newline(text: Column) -> Column:
    return F.coalesce((text != "") & ~text.endswith("\n"), F.lit(False))


def is_binary(text: Column) -> Column:
    return F.coalesce(text.contains("\x00"), F.lit(False))


def is_oversize(text: Column, max_chars: int | None = None, max_lines: int | None = None, max_line_chars: int | None = None) -> Column:
    """Whether a text passes one of the limits; without limits none does."""
    over = F.lit(False)
    if max_chars is not None:
        over = over | (F.length(text) > max_chars)
    if max_lines is not None:
        over = over | (F.size(split_lines(text)) > max_lines)
    if max_line_chars is not None:
        over = over | F.exists(split_lines(text), lambda ln: F.length(ln) > max_line_chars)
    return F.coalesce(over, F.lit(False))


def is_damaged(text: Column) -> Column:
    """Spark strings are UTF-8: an undecodable surrogate shows as U+FFFD."""
    return F.coalesce(text.contains("�"), F.lit(False))


def input_status(before: Column, after: Column, path: Column, old_path: Column) -> Column:
    """added / deleted / renamed / modified, or null when nothing changed."""
    renamed = old_path.isNotNull() & (old_path != path) & before.isNotNull() & after.isNotNull()
    return (F.when(before.isNull() & after.isNull(), None).when(before.isNull(), "added")
            .when(after.isNull(), "deleted").when(renamed, "renamed")
            .when(before != after, "modified"))


def over_budget_body(body: Column) -> Column:
    return F.coalesce(F.lower(body).contains("max_tokens_exceeded"), F.lit(False))


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def shorten(text: Column, n: int = K.PATH_REPR_MAX) -> Column:
    """At most n characters, an ellipsis marking the cut."""
    return F.when(F.length(text) <= n, text).otherwise(
        F.concat(F.substring(text, 1, n - 3), F.lit("...")))


def escape_cell(text: Column) -> Column:
    return F.replace(F.translate(text, "\n\t", "  "), F.lit("|"), F.lit("\\|"))


def estimate_tokens(state_json: Column, longest_question_chars) -> Column:
    """Serialised state plus the longest question, three characters a token."""
    return (F.length(state_json) + longest_question_chars) / F.lit(K.CHARS_PER_TOKEN)


def over_hard_cap(state_json: Column, all_question_chars) -> Column:
    return (F.length(state_json) + all_question_chars) / F.lit(K.CHARS_PER_TOKEN) > K.HARD_CAP_TOKENS


def sample_id(repo: Column, pr: Column, phase) -> Column:
    return F.concat(repo, F.lit("#"), pr.cast("string"), F.lit("@"),
                    phase if isinstance(phase, Column) else F.lit(phase))


def parse_sample_id(sid: Column) -> Column:
    """struct(repo, pr, phase), null when the id is malformed."""
    p = K.SAMPLE_ID_PATTERN
    return F.when(sid.rlike(p), F.struct(
        F.regexp_extract(sid, p, 1).alias("repo"),
        F.regexp_extract(sid, p, 2).try_cast("int").alias("pr"),
        F.regexp_extract(sid, p, 3).alias("phase")))


def split_for(repo: Column, pr: Column) -> Column:
    """Hash split of a pull request: the sha256 of 'repo#pr' modulo ten.

    Powers of sixteen are 6 modulo 10, so chunks of digits can be reduced alone.
    """
    digest = F.sha2(F.concat(repo, F.lit("#"), pr.cast("string")), 256)

    def chunk(start: int, size: int) -> Column:
        return F.conv(F.substring(digest, start, size), 16, 10).cast("bigint") % K.HOLDOUT_MOD

    upper = chunk(1, 15) + chunk(16, 15) + chunk(31, 15) + chunk(46, 15)
    rest = (upper * 6 + chunk(61, 4)) % K.HOLDOUT_MOD
    return F.when(rest < K.HOLDOUT_BELOW, "holdout").when(rest.isNotNull(), "train")


def unit_key(file: Column, line: Column, line_end: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"),
                       F.coalesce(line_end.cast("string"), F.lit("None")))


def corpus_label(config: Column, sample: Column, k: Column) -> Column:
    return F.concat(F.lit("corpus:"), config, F.lit(":"), sample, F.lit(":r"), k.cast("string"))


def arm_label(arm: Column, sample: Column, k: Column) -> Column:
    return F.concat(F.lit("exp:enrich:"), arm, F.lit(":"), sample, F.lit(":r"), k.cast("string"))


def parse_label(label: Column) -> Column:
    """struct(kind, group, sample, repeat) of a run label, null fields when foreign."""
    p = "^(corpus|exp:enrich):([^:]*):(.*):r(\\d+)$"
    hit = label.rlike(p)
    return F.struct(
        F.when(hit, F.regexp_extract(label, p, 1)).alias("kind"),
        F.when(hit, F.regexp_extract(label, p, 2)).alias("group"),
        F.when(hit, F.regexp_extract(label, p, 3)).alias("sample"),
        F.when(hit, F.regexp_extract(label, p, 4).try_cast("int")).alias("repeat"))


def follow_up_bullets(body: Column) -> Column:
    """array<struct(status, bullet)> of a follow-up comment, empty for other comments."""
    bullets = F.filter(F.split(body, "\r\n|\n|\r"),
                       lambda ln: ln.startswith("- **") & ln.rlike(K.STATUS_PATTERN))
    parsed = F.transform(bullets, lambda ln: F.struct(
        F.when(F.regexp_extract(ln, K.STATUS_PATTERN, 1) == "Fixed", "fixed")
        .otherwise("not-applied").alias("status"), ln.alias("bullet")))
    head = F.coalesce(F.regexp_replace(body, "^\\s+", "").startswith(K.FOLLOW_UP_HEADER), F.lit(False))
    return F.when(head, parsed).otherwise(F.array().cast("array<struct<status:string,bullet:string>>"))


def old_side_touches(diff: Column, line: Column, slack: int = 2) -> Column:
    """Some hunk's old range, widened by ``slack``, holds the line."""
    p = K.ZERO_CONTEXT_HUNK_PATTERN
    starts = F.regexp_extract_all(diff, F.lit(p), F.lit(1))
    counts = F.regexp_extract_all(diff, F.lit(p), F.lit(2))
    ranges = F.arrays_zip(starts.alias("s"), counts.alias("c"))

    def holds(r):
        start = r["s"].cast("int")
        count = F.when(r["c"] == "", 1).otherwise(r["c"].try_cast("int"))
        end = start + F.greatest(count, F.lit(1)) - 1
        return line.between(start - slack, end + slack)

    return F.coalesce(F.exists(ranges, holds), F.lit(False))


def declared_names(lines: Column) -> Column:
    """Names declared or imported by an array of lines (see the fixed patterns)."""
    decl = F.filter(
        F.flatten(F.transform(lines, lambda ln: F.regexp_extract_all(
            ln, F.lit("(?U)" + K.DECLARED_NAME_PATTERN), F.lit(1)))),
        lambda n: F.length(n) >= 3)
    p = "(?U)" + K.IMPORT_PATTERN
    imports = F.filter(lines, lambda ln: ln.rlike(p))

    def group(ln, i):
        return F.regexp_extract(ln, p, i)

    targets = F.transform(F.flatten(F.transform(imports, lambda ln: F.split(
        F.when(group(ln, 2) != "", group(ln, 2)).otherwise(group(ln, 3)), ","))),
        lambda part: F.trim(F.substring_index(F.regexp_replace(part, "^\\s+|\\s+$", ""), " as ", 1)))
    names = F.filter(targets, lambda n: n.rlike("(?U)^[A-Za-z_]\\w*$"))
    mods = F.transform(imports, lambda ln: F.regexp_replace(
        F.when(group(ln, 1) != "", group(ln, 1)).otherwise(group(ln, 3)), "^\\s+|\\s+$", ""))
    mods = F.transform(mods, lambda m: F.regexp_replace(m, "^\\.+", ""))
    roots = F.transform(F.filter(mods, lambda m: m.rlike("(?U)^[\\w.]+$")),
                        lambda m: F.substring_index(m, ".", 1))
    return F.array_distinct(F.filter(F.concat(decl, names, roots), lambda n: n != ""))


def references_remaining(change_type: Column, removed: Column, surviving: Column) -> Column:
    """A removed name still stands as a whole word in the surviving lines.

    Null unless the unit is a deletion; false when nothing survives.
    """
    corpus = F.array_join(surviving, "\n")
    names = declared_names(removed)
    hit = F.exists(names, lambda n: F.regexp_like(corpus, F.concat(F.lit("(?U)\\b"), n, F.lit("\\b"))))
    return F.when(change_type.isin(*K.DELETION_CHANGE_TYPES),
                  F.coalesce((corpus != "") & hit, F.lit(False)))


# --- packed commits ----------------------------------------------------------------


def pack_sha(sha: Column) -> Column:
    """A commit as 20 bytes, for shuffles; text that is no commit follows 21 zero bytes."""
    return F.when(sha.rlike(r"\A[0-9a-f]{40}\z"), F.unhex(sha)).otherwise(F.concat(F.lit(bytes(21)), F.encode(sha, "UTF-8")))


def unpack_sha(packed: Column) -> Column:
    """The text that ``pack_sha`` packed."""
    return F.when(F.length(packed) == 20, F.lower(F.hex(packed))).otherwise(F.decode(F.substring(packed, 22, 1 << 30), "UTF-8"))
