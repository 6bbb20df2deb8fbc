"""Cutting units further: line windows, symbol spans, sites, halves; symbol context.

Entries: unit_id, file, pos, kind, new_line, old_line, head_line, text.  Symbols are
an input table: file, side ('before' or 'after'), name, start, end, depth.  ``file``
names one file image (put the change into it), so a window by file holds the lines of
one image only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions.scores import try_ratio

UNIT = ["unit_id"]
# A line of white space in the sense of Unicode, to its very end.
BLANK = r"^[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*\z"


def own_line(kind: Column) -> Column:
    """The line an entry counts by: old file for deletions, new file otherwise."""
    return F.when(kind == "-", F.col("old_line")).otherwise(F.col("new_line"))


def line_windows(entries: DataFrame, n: int = K.FALLBACK_WINDOW_LINES) -> DataFrame:
    """(unit_id, pos, win): windows of at most ``n`` lines, cut after the last blank line
    where there is one.  Windows without a change join the one before.  Units that
    fit in one window are left out.
    """
    item = F.struct("pos", F.col("kind"), own_line(F.col("kind")).alias("line"), F.col("text").rlike(BLANK).alias("blank"))
    e = entries.groupBy(*UNIT).agg(F.sort_array(F.collect_list(item)).alias("e"))
    e = e.select(*UNIT, "e", *[F.col(f"e.{f}").alias(f"{f}s") for f in ("kind", "line", "blank")])

    def step(acc, i):
        line = F.get("lines", i)
        start = F.coalesce(acc["start"], line)
        full = (i > acc["from"]) & (line - start + 1 > n)

        def over(j):
            return F.get("lines", j) - start + 1 > n

        marks = F.filter(F.sequence(acc["from"], i - 1), lambda j: (j > acc["from"]) & (F.get("blanks", j) | over(j)))
        last = F.array_max(marks)
        cut = F.when(last.isNotNull() & ~over(last), last + 1).otherwise(i)
        return F.when(full, F.struct(
            F.array_append(acc["cuts"], cut).alias("cuts"), cut.alias("from"),
            F.when(cut < i, F.get("lines", cut)).alias("start"))).otherwise(
            F.struct(acc["cuts"].alias("cuts"), acc["from"].alias("from"), start.alias("start")))

    zero = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("from"), F.lit(None).cast("int").alias("start"))
    e = e.withColumn("cuts", F.aggregate(F.sequence(F.lit(0), F.size("e") - 1), zero, step, lambda acc: acc["cuts"]))
    ends = F.concat(F.slice("cuts", 2, F.size("cuts")), F.array(F.size("e")))
    e = e.withColumn("spans", F.arrays_zip(F.col("cuts").alias("lo"), ends.alias("hi")))
    heads = F.filter("spans", lambda s: (s["lo"] == 0) | F.exists(F.slice("kinds", s["lo"] + 1, s["hi"] - s["lo"]), lambda k: k != " "))
    e = e.withColumn("heads", F.transform(heads, lambda s: s["lo"])).filter(
        (F.size("heads") > 1) & F.exists("kinds", lambda k: k != " "))
    return e.select(*UNIT, "heads", F.posexplode("e").alias("idx", "x")).select(
        *UNIT, "x.pos", F.size(F.filter("heads", lambda h: h <= F.col("idx"))).alias("win"))


def size_routes(units: DataFrame, soft_cap: int = K.SOFT_CAP_TOKENS, band: int = K.MAX_UNIT_LINES) -> DataFrame:
    """Adds ``oversize`` (estimated tokens) and ``band`` (span in lines), oversize first."""
    over = F.col("tokens") > soft_cap
    lo = F.coalesce("line_start", "line")
    span = F.coalesce("line_end", "line_start", "line") - lo + 1
    return units.withColumn("oversize", over).withColumn("band", ~over & (span > band))


def sub_units(entries: DataFrame, part: str) -> DataFrame:
    """Anchor, span and counts of the parts of a unit; a part is a unit of its own."""
    plus, minus = F.col("kind") == "+", F.col("kind") == "-"
    return entries.groupBy(*UNIT, part).agg(
        F.coalesce(F.min_by("new_line", F.when(plus, F.col("pos"))), F.min_by("head_line", F.when(minus, F.col("pos"))),
                   F.min("hunk_start")).alias("line"),
        F.min("head_line").alias("line_start"), F.max("head_line").alias("line_end"),
        F.count_if(F.col("kind") != " ").cast("int").alias("n_changed"), F.count(F.lit(1)).cast("int").alias("size"))


def _spans_at(points: DataFrame, spans: DataFrame, keys: Sequence[str], width: int = 128) -> DataFrame:
    """Inner interval join of points (``at``) with spans (start, end), by line bucket."""
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    p = points.withColumn("_b", F.floor(F.col("at") / width))
    return p.join(s, [*keys, "_b"]).filter(F.col("at").between(F.col("start"), F.col("end"))).drop("_b")


def _nearest(points: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points (``at``) with the spans around them: ``inside`` (name and start of the span
    that holds the point) and ``nearest`` (start).  Spans of one key do not overlap, so
    both come from the span before and the span after in line order."""
    s = spans.select(*keys, F.col("start").alias("_l"), F.lit(0).alias("_z"), F.struct("start", "end", "name").alias("_s"))
    p = points.withColumn("_l", F.col("at")).withColumn("_z", F.lit(1))
    both = s.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_l", "_z")
    prev = F.last("_s", ignorenulls=True).over(w)
    nxt = F.first("_s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumn("_p", prev).withColumn("_n", nxt).filter("_z = 1")
    inside = F.when(F.col("_p.end") >= F.col("at"), F.col("_p"))
    closer = F.when(F.col("_n").isNull() | (F.col("at") - F.col("_p.end") <= F.col("_n.start") - F.col("at")), F.col("_p.start")).otherwise(F.col("_n.start"))
    nearest = F.coalesce(inside["start"], closer, F.col("_n.start"))
    return out.select(*points.columns, inside.alias("inside"), nearest.alias("nearest"))


def symbol_cut(entries: DataFrame, symbols: DataFrame, glue: int = K.CONTEXT_LINES) -> DataFrame:
    """(unit_id, pos, part): units cut at the top-level symbols of their file.

    Added lines go to the symbol that holds them, strays to the nearest.  Removed
    lines go to the symbol of the same name in the new file, else to their old
    symbol, else to runs of neighbouring removed lines.  Context is glued to parts
    within ``glue`` lines, but not between a part's own lines.  A cut that changes
    nothing is dropped.
    """
    top = symbols.filter("depth = 0").select("file", "side", "name", "start", "end")
    post, pre = top.filter("side = 'after'").drop("side"), top.filter("side = 'before'").drop("side")
    has_post = post.select("file").distinct()
    e = entries.join(has_post, "file", "left_semi").withColumn("at", own_line(F.col("kind")))
    plus = _nearest(e.filter("kind = '+'"), post, ["file"]).select(
        *UNIT, "file", "pos", "at", "kind", F.concat(F.lit("post:"), F.col("nearest").cast("string")).alias("part"))
    minus = _nearest(e.filter("kind = '-'"), pre, ["file"])
    home = post.groupBy("file", "name").agg(F.max("start").alias("home"))
    minus = minus.withColumn("name", F.col("inside.name")).join(home, ["file", "name"], "left")
    loose_w = Window.partitionBy(*UNIT).orderBy("pos")
    loose = minus.filter(F.col("inside").isNull())
    gap = F.col("at") - F.lag("at").over(loose_w)
    loose = loose.withColumn("run", F.sum(F.when(gap.between(1, 2), 0).otherwise(1)).over(loose_w)).select(
        *UNIT, "file", "pos", "at", "kind", F.concat(F.lit("loose:"), F.col("run").cast("string")).alias("part"))
    placed = minus.filter(F.col("inside").isNotNull()).select(*UNIT, "file", "pos", "at", "kind", F.when(
        F.col("home").isNotNull(), F.concat(F.lit("post:"), F.col("home").cast("string"))).otherwise(
        F.concat(F.lit("pre:"), F.col("inside.start").cast("string"))).alias("part"))
    changed = plus.unionByName(placed).unionByName(loose)
    n_parts = changed.groupBy(*UNIT).agg(F.count_distinct("part").alias("n"))
    changed = changed.join(n_parts.filter("n > 1").select(*UNIT), UNIT, "left_semi")
    groups = (changed.filter(F.col("part").startswith("post:")).groupBy(*UNIT, "file", "part").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
              .withColumn("s", F.substring_index("part", ":", -1).cast("int"))
              .join(post.select("file", F.col("start").alias("s"), F.col("end").alias("post_end")), ["file", "s"])
              .select(*UNIT, "part", "lo", "hi", (F.col("s") - glue).alias("start"), (F.col("post_end") + glue).alias("end")))
    context = _spans_at(e.filter("kind = ' '").select(*UNIT, "pos", "at"), groups, UNIT).filter(
        ~((F.col("at") > F.col("lo")) & (F.col("at") < F.col("hi"))))
    return changed.select(*UNIT, "pos", "part").unionByName(context.select(*UNIT, "pos", "part"))


def leafmost_sites(entries: DataFrame, sites: DataFrame) -> DataFrame:
    """(unit_id, at, site_id): each changed line's deepest site; ties go to the smaller
    span, then the lower start.  ``sites``: file, site_id, start, end, depth."""
    lines = entries.filter("kind <> ' '").select(*UNIT, "file", own_line(F.col("kind")).alias("at")).distinct()
    hits = _spans_at(lines, sites, ["file"])
    rank = F.struct((-F.col("depth")).alias("d"), (F.col("end") - F.col("start")).alias("n"), F.col("start").alias("s"), "site_id")
    return hits.groupBy(*UNIT, "at").agg(F.min_by("site_id", rank).alias("site_id"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _settled(parts: Column, floor: Column) -> Column:
    """Groups (lo, hi, name, members) of a unit after all under the floor have joined others.

    In a round every small group points to the nearest other one (ties to the first by
    place); of two that point at each other the first stays.  What points, over any steps,
    to a group that stays becomes one group with it, and is measured anew.  A round at
    least halves the small groups, so the rounds below reach the end: no group under the
    floor, or one group.
    """
    def small(p):
        return p["hi"] - p["lo"] + 1 < floor

    def doublings(ps):
        return F.sequence(F.lit(0), F.ceil(F.log2(F.size(ps))).cast("int"))

    def one_round(ps):
        places = F.sequence(F.lit(0), F.size(ps) - 1)

        def nearest(p, i):
            away = F.transform(F.filter(places, lambda j: j != i), lambda j: F.struct(
                F.least(F.abs(F.get(ps, j)["lo"] - p["lo"]), F.abs(F.get(ps, j)["hi"] - p["hi"])).alias("off"), j.alias("j")))
            return F.when(small(p), F.array_min(away)["j"]).otherwise(i)

        def merged(root):
            def group(r):
                return _let(F.filter(ps, lambda p, i: F.get(root, i) == r), lambda mine: F.struct(
                    F.array_min(F.transform(mine, lambda p: p["lo"])).alias("lo"), F.array_max(F.transform(mine, lambda p: p["hi"])).alias("hi"),
                    F.get(ps, r)["name"].alias("name"), F.flatten(F.transform(mine, lambda p: p["members"])).alias("members")))

            return F.array_sort(F.transform(F.filter(places, lambda i: F.get(root, i) == i), group))

        def rooted(to):
            stays = F.transform(to, lambda j, i: F.when((F.get(to, j) == i) & (i < j), i).otherwise(j))
            return _let(F.aggregate(doublings(ps), stays, lambda t, _: F.transform(t, lambda j: F.get(t, j))), merged)

        return _let(F.transform(ps, nearest), rooted)

    return F.aggregate(doublings(parts), parts, lambda ps, _: F.when((F.size(ps) > 1) & F.exists(ps, small), one_round(ps)).otherwise(ps))


def _site_owners(entries: DataFrame, sites: DataFrame) -> DataFrame:
    """(unit_id, pos, at, head_line, site_id) of the units that sites cut: code changes whose
    changed lines fall into two sites at least.  Entries without a site go to the site of
    their unit whose span is nearest."""
    lead = leafmost_sites(entries, sites)
    adds = entries.filter("kind = '+'").select(*UNIT, F.lit(True).alias("adds")).distinct()
    cut = lead.groupBy(*UNIT).agg(F.count_distinct("site_id").alias("n")).filter("n > 1").join(adds, UNIT, "left_semi").select(*UNIT)
    e = entries.withColumn("at", own_line(F.col("kind"))).select(*UNIT, "file", "pos", "at", "head_line").join(cut, UNIT, "left_semi")
    own = e.join(lead, [*UNIT, "at"], "left")
    held = own.filter("site_id is not null").select(*UNIT, "file", "site_id").distinct().join(sites.select("file", "site_id", "start", "end"), ["file", "site_id"])
    loose = own.filter("site_id is null").drop("site_id", "file").join(held.drop("file"), UNIT)
    off = F.least(F.abs(F.col("start") - F.col("at")), F.abs(F.col("end") - F.col("at")))
    glued = loose.groupBy(*UNIT, "pos").agg(F.min_by("site_id", F.struct(off.alias("off"), "start", "site_id")).alias("glued"))
    return own.join(glued, [*UNIT, "pos"], "left").select(*UNIT, "pos", "at", "head_line", F.coalesce("site_id", "glued").alias("site_id"))


def _hosts(reach: DataFrame, floors: Sequence[int]) -> DataFrame:
    """(unit_id, size_floor, site_id, part): the group each site ends in, of the units that
    keep two groups; ``reach`` has unit_id, site_id, lo and hi."""
    each = F.struct("lo", "hi", F.col("site_id").alias("name"), F.array("site_id").alias("members"))
    units = reach.groupBy(*UNIT).agg(F.sort_array(F.collect_list(each)).alias("parts")).withColumn("size_floor", F.explode(F.lit(list(floors))))
    units = units.withColumn("parts", _settled(F.col("parts"), F.col("size_floor"))).filter(F.size("parts") > 1)
    return units.select(*UNIT, "size_floor", F.explode("parts").alias("p")).select(*UNIT, "size_floor", F.explode("p.members").alias("site_id"), F.col("p.name").alias("part"))


def site_parts(entries: DataFrame, sites: DataFrame, floor: int = K.SITE_SIZE_FLOOR) -> DataFrame:
    """(unit_id, pos, part): the site each entry of a unit ends in; null for units that are
    not cut: deletions, and those left with fewer than two sites.

    Sites whose entries reach over fewer than ``floor`` lines join the nearest, round by
    round, until none is left or all are one.  A unit's sites, of which there are at most
    as many as changed lines, meet in one row; nothing else does.
    """
    owned = _site_owners(entries, sites)
    hosts = _hosts(owned.groupBy(*UNIT, "site_id").agg(F.min("at").alias("lo"), F.max("at").alias("hi")), [floor]).drop("size_floor")
    parts = owned.join(hosts, [*UNIT, "site_id"]).select(*UNIT, "pos", "part")
    return entries.select(*UNIT, "pos").join(parts, [*UNIT, "pos"], "left")


def site_census(entries: DataFrame, sites: DataFrame, floors: Sequence[int] = tuple(K.SITE_FLOORS)) -> DataFrame:
    """Per size floor: clusters, sites, expansion, upper-median site span, and whether the
    stop rules end the tightening there; ``chosen`` marks the first stop.

    ``entries`` are those of the kept clusters, ``unit_id`` naming the cluster; a cluster
    that is not cut counts as one site.  Sites are found once for all floors.
    """
    whole = entries.groupBy(*UNIT).agg(F.min("head_line").alias("top"), F.max("head_line").alias("bottom"))
    reach = _site_owners(entries, sites).groupBy(*UNIT, "site_id").agg(
        F.min("at").alias("lo"), F.max("at").alias("hi"), F.min("head_line").alias("top"), F.max("head_line").alias("bottom"))
    cut = reach.join(_hosts(reach, floors), [*UNIT, "site_id"]).groupBy("size_floor", *UNIT, "part").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    rest = whole.withColumn("size_floor", F.explode(F.lit(list(floors)))).join(cut.select("size_floor", *UNIT).distinct(), ["size_floor", *UNIT], "left_anti")
    spans = cut.select("size_floor", "top", "bottom").unionByName(rest.select("size_floor", "top", "bottom")).withColumn("span", F.col("bottom") - F.col("top") + 1)
    # upper median: the value at position n/2 of the sorted spans, from value counts
    counts = spans.groupBy("size_floor", "span").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("size_floor")
    med = (counts.withColumn("upto", F.sum("c").over(w.orderBy("span").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n_sites", F.sum("c").over(w))
           .filter(F.col("upto") > F.floor(F.col("n_sites") / 2)).groupBy("size_floor", "n_sites").agg(F.min("span").alias("median_span")))
    out = med.withColumn("n_clusters", whole.agg(F.count(F.lit(1))).scalar())
    out = out.withColumn("expansion", try_ratio(F.col("n_sites"), F.col("n_clusters")))
    passed = F.col("expansion") <= K.SITE_EXPANSION_ENVELOPE
    out = out.withColumn("outcome", F.when(passed, "pass").when(F.col("median_span") > K.SITE_MEDIAN_FORBIDDEN_LINES, "fail")
                         .when(F.col("size_floor") == max(floors), "fail"))
    stop = F.min(F.when(F.col("outcome").isNotNull(), F.col("size_floor"))).over(Window.partitionBy("n_clusters"))
    return out.withColumn("chosen", F.col("size_floor") == stop)


def halves(entries: DataFrame) -> DataFrame:
    """(unit_id, pos, half): units cut before their median changed entry.  A half without
    a change is not a unit; units that cannot be cut are left out."""
    w = Window.partitionBy(*UNIT).orderBy("pos")
    every = Window.partitionBy(*UNIT)
    changed = F.col("kind") != " "
    e = (entries.withColumn("k", F.sum(F.when(changed, 1).otherwise(0)).over(w)).withColumn("n", F.count_if(changed).over(every))
         .withColumn("mid", F.min(F.when(changed & (F.col("k") == F.floor(F.col("n") / 2) + 1), F.col("pos"))).over(every))
         .withColumn("first", F.min("pos").over(every)).filter((F.col("n") > 0) & (F.col("first") < F.col("mid"))))
    half = F.when(F.col("pos") < F.col("mid"), 1).otherwise(2)
    return e.withColumn("half", half).filter((F.col("n") > 1) | (F.col("half") == 2)).select(*UNIT, "pos", "half")


# --- symbol context ----------------------------------------------------------------

POINT = ["point_id"]


def lookup_points(units: DataFrame, first_deleted: DataFrame) -> DataFrame:
    """(point_id, file, side, at): deletions look at their first removed line in the old
    file, other units at their anchor in the new one; deleted files have no point."""
    d = F.col("change_type") == "deletion-only"
    j = units.filter(F.col("change_type") != "whole-file-deleted").join(first_deleted, "point_id", "left")
    return j.select("point_id", "file", F.when(d, "before").otherwise("after").alias("side"),
                    F.when(d, F.coalesce("first_old_line", "line")).otherwise(F.col("line")).alias("at"))


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per point inside a symbol: the dotted chain of the symbols around it and the
    narrowest one (ties: larger start).  Spans nest, so a point meets few of them."""
    hit = _spans_at(points, symbols, ["file", "side"])
    narrow = F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s"))
    return hit.groupBy(*POINT, "file", "side", "at").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "start", "name"))), lambda x: x["name"]), ".").alias("symbol"),
        F.min_by(F.struct("name", "start", "end"), narrow).alias("narrowest"))


def locate(units: DataFrame, first_deleted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(point_id, symbol, line) of every unit; symbol null when none resolves."""
    found = enclosing(lookup_points(units, first_deleted), symbols).select(*POINT, "symbol")
    return units.select(*POINT, "line").join(found, POINT, "left")


def context_windows(points: DataFrame, symbols: DataFrame, file_lines: DataFrame, n: int = K.CONTEXT_WINDOW_LINES, width: int = 128) -> DataFrame:
    """(point_id, symbol, context): the first ``n`` lines of the narrowest symbol."""
    e = enclosing(points, symbols).select(*POINT, "file", "side", "symbol", F.col("narrowest.start").alias("start"),
                                          F.least("narrowest.end", F.col("narrowest.start") + n - 1).alias("end"))
    windows = e.select("file", "side", "start", "end").distinct()
    lines = _spans_at(file_lines.withColumn("at", F.col("line")), windows, ["file", "side"], width)
    text = lines.groupBy("file", "side", "start", "end").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: F.rtrim(x["text"])).alias("context"))
    return e.join(text, ["file", "side", "start", "end"], "left").select(*POINT, "symbol", F.coalesce("context", F.array().cast("array<string>")).alias("context"))


def symbol_tables(symbols: DataFrame, n: int = K.SYMBOL_TABLE_MAX) -> DataFrame:
    """(file, side, symbols): the first ``n`` top-level names in source order."""
    w = Window.partitionBy("file", "side").orderBy("start", "name")
    top = symbols.filter("depth = 0").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    return top.groupBy("file", "side").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("symbols"))


def contexts(units: DataFrame, first_deleted: DataFrame, symbols: DataFrame, file_lines: DataFrame) -> DataFrame:
    """(point_id, ast_context): symbol table, enclosing chain and window; null when the
    file has no symbols."""
    points = lookup_points(units, first_deleted)
    win = context_windows(points, symbols, file_lines)
    table = symbol_tables(symbols)
    j = points.join(table, ["file", "side"], "left").join(win, POINT, "left")
    empty = F.array().cast("array<string>")
    ctx = F.when(F.col("symbols").isNotNull() | F.col("symbol").isNotNull(), F.struct(
        F.coalesce("symbols", empty).alias("symbols"), F.col("symbol").alias("enclosing"), F.coalesce("context", empty).alias("context")))
    return units.select(*POINT).join(j.select(*POINT, ctx.alias("ast_context")), POINT, "left")


def enclosing_declaration(points: DataFrame, declarations: DataFrame) -> DataFrame:
    """(point_id, declaration): the narrowest declaration, or '<path>:<module>'."""
    hit = _spans_at(points, declarations, ["file", "side"]).groupBy(*POINT).agg(
        F.min_by("name", F.struct((F.col("end") - F.col("start")).alias("n"), "start")).alias("name"))
    return points.join(hit, POINT, "left").select(*POINT, F.coalesce("name", F.concat("file", F.lit(":<module>"))).alias("declaration"))


def context_census(golden: DataFrame, files: DataFrame, symbols: DataFrame, file_lines: DataFrame) -> DataFrame:
    """One row over labelled lines (point_id, file, line): rows, missing, enriched, covered,
    added tokens, exact median window."""
    points = golden.select(*POINT, "file", F.lit("after").alias("side"), F.col("line").alias("at"))
    win = context_windows(points, symbols, file_lines)
    table = symbol_tables(symbols).filter("side = 'after'").drop("side")
    narrow = enclosing(points, symbols).select(*POINT, F.col("narrowest.start").alias("start"))
    known = files.select("file").distinct().withColumn("known", F.lit(True))
    j = points.join(known, "file", "left").join(table, "file", "left").join(win, POINT, "left").join(narrow, POINT, "left")
    empty = F.array().cast("array<string>")
    enriched = F.col("known").isNotNull() & (F.col("symbols").isNotNull() | F.col("symbol").isNotNull())
    size = F.size(F.coalesce("context", empty))
    chars = F.length(F.to_json(F.struct(F.coalesce("symbols", empty).alias("symbols"), F.col("symbol").alias("enclosing"), F.coalesce("context", empty).alias("context"))))
    covered = F.coalesce(F.col("start").isNotNull() & (F.col("at") < F.col("start") + size), F.lit(False))
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("known").isNull()).alias("missing"), F.count_if(enriched).alias("enriched"),
                 F.count_if(enriched & covered).alias("covered"),
                 (F.coalesce(F.sum(F.when(enriched, chars)), F.lit(0)) / F.lit(K.CHARS_PER_TOKEN)).alias("added_tokens"),
                 F.coalesce(F.median(F.when(enriched, size)), F.lit(0.0)).alias("median_window"))
