"""One-to-one matching of reported findings to labelled lines.

Rule: same file, at most one line apart; pairs are taken nearest first, ties by
lower labelled line, then earlier finding, then earlier label; each side is used
once.

The greedy order splits into two exact steps, so no list of all pairs is built:

* distance 0: on one line the k-th finding goes with the k-th label, a rank join;
* distance 1: only the rows left over by step one compete, and a line can serve
  at most as many of them as its neighbours hold.  A labelled line takes the
  first findings, in finding order, of the line before and the line after.  What
  one labelled line takes only matters to the next one two lines on, and all that
  matters is a number: how many of the findings between them are gone.  Chains of
  such lines are cut into pieces of ``1 << PIECE_BITS`` lines; a piece is a table
  from the number that comes in to the one that goes out, so a chain as long as a
  file is spread over all tasks and only the tables meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a piece of a chain, as a power of two: a file of 32-bit line numbers has at
#: most 2 ** 19 pieces, one of a million lines 123.
PIECE_BITS = 13


def match_findings(reported: DataFrame, golden: DataFrame, run_cols: Sequence[str],
                   sample_cols: Sequence[str], level: str | None = None) -> DataFrame:
    """Chosen pairs: run and sample columns, file, ord, line, golden_idx, golden_line,
    distance.

    ``reported``: run_cols, sample_cols, file, line, ord (unique within a run).
    ``golden``: sample_cols, file, line, golden_idx (unique within a sample).
    ``level`` names a column of ``reported`` that says at how many of a row of rising
    thresholds a finding is there; the pairs then have ``k``, the threshold's place from
    0.  Findings meet the labels once, and only those near one are told apart by ``k``.
    """
    sample, run = list(sample_cols), [c for c in run_cols if c not in sample_cols]
    rkey, skey = [*sample, *run, "file"], [*sample, "file"]
    levels = [level] if level else []

    labels = golden.select(*skey, F.col("line").alias("golden_line"), "golden_idx").withColumn(
        "gk", F.row_number().over(Window.partitionBy(*skey, "golden_line").orderBy("golden_idx")))
    # labels on, before and after each line that can match at all
    around = (labels.withColumn("line", F.explode(F.array(*[F.col("golden_line") + d for d in (-1, 0, 1)])))
              .groupBy(*skey, "line").agg(
                  F.count_if(F.col("golden_line") == F.col("line")).alias("here"),
                  F.count_if(F.col("golden_line") != F.col("line")).alias("beside")))
    cand = reported.select(*rkey, "line", "ord", *levels).join(around, [*skey, "line"])
    if level:
        cand = cand.filter(F.col(level) > 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.col(level) - 1))).drop(level)
        rkey = [*rkey, "k"]
    cand = (cand.withColumn("rk", F.row_number().over(Window.partitionBy(*rkey, "line").orderBy("ord"))))

    exact = (cand.filter(F.col("rk") <= F.col("here"))
             .join(labels, [cand[c] == labels[c] for c in skey]
                   + [cand["line"] == labels["golden_line"], cand["rk"] == labels["gk"]])
             .select(*[cand[c] for c in rkey], "ord", "line", "golden_idx", "golden_line",
                     F.lit(0).alias("distance")))

    left = F.when((F.col("rk") > F.col("here")) & (F.col("rk") <= F.col("here") + F.col("beside")), F.col("ord"))
    lines = cand.groupBy(*rkey, "line").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(left)).alias("free"))
    empty = F.lit(None).cast("array<bigint>")
    free = F.when(F.size("free") > 0, F.col("free").cast("array<bigint>"))
    seen = lines.select(*rkey, F.inline(F.array(
        F.struct(F.col("line").alias("golden_line"), F.col("n"), empty.alias("lo"), empty.alias("hi")),
        F.struct((F.col("line") + 1).alias("golden_line"), F.lit(0).cast("bigint").alias("n"), free.alias("lo"), empty.alias("hi")),
        F.struct((F.col("line") - 1).alias("golden_line"), F.lit(0).cast("bigint").alias("n"), empty.alias("lo"), free.alias("hi")))))
    none = F.array().cast("array<bigint>")
    spots = (seen.groupBy(*rkey, "golden_line").agg(
        F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
        .filter(F.col("lo").isNotNull() | F.col("hi").isNotNull())
        .withColumn("lo", F.coalesce("lo", none)).withColumn("hi", F.coalesce("hi", none)))
    nodes = (spots.join(labels, [*skey, "golden_line"])
             .filter((F.col("gk") > F.col("n"))
                     & (F.col("gk") <= F.col("n") + F.size("lo") + F.size("hi")))
             .groupBy(*rkey, "golden_line")
             .agg(F.sort_array(F.collect_list(F.col("golden_idx").cast("bigint"))).alias("gs"),
                  F.first("lo").alias("lo"), F.first("hi").alias("hi")))
    # one sorted list of both neighbours' findings per labelled line, and where in it those of the line after stand
    def tagged(column, side):
        return F.transform(column, lambda x, i: F.struct(x.alias("ord"), F.lit(side).alias("side"), i.alias("nth")))

    by_side = F.array_sort(F.concat(tagged("lo", 0), tagged("hi", 1)))
    after = F.filter(F.transform("both", lambda x, i: F.when(x["side"] == 1, i)), lambda i: i.isNotNull())
    pieces = (nodes.withColumn("both", by_side).groupBy(*rkey, F.col("golden_line").bitwiseAND(F.lit(1)).alias("parity"), F.shiftright("golden_line", PIECE_BITS).cast("long").alias("piece"))
              .agg(F.sort_array(F.collect_list(F.struct("golden_line", "gs", "both", F.size("lo").alias("n_lo"), after.alias("after")))).alias("spots")))
    key = [*rkey, "parity"]
    carried = pieces.join(_carries(pieces, key), [*key, "piece"], "left")
    begins = F.element_at("spots", 1)["golden_line"] == _first_line()
    spots = F.arrays_zip("spots", _walk("spots", F.when(begins & F.col("k0").isNotNull(), F.col("k0")).otherwise(F.lit(0))).alias("taken"))

    def chosen(s, k):
        """The first findings for the labels of a line whose line before has lost its first ``k``."""
        free = F.slice(F.filter(s["both"], lambda x: (x["side"] == 1) | (x["nth"] >= k)), 1, F.size(s["gs"]))
        return F.zip_with(free, F.slice(s["gs"], 1, F.size(free)), lambda x, j: F.struct(
            x["ord"].alias("ord"), (s["golden_line"] + 2 * x["side"] - 1).alias("line"), j.alias("golden_idx"), s["golden_line"].alias("golden_line")))

    beside = (carried.select(*rkey, F.inline(F.flatten(F.transform(spots, lambda z: chosen(z["spots"], z["taken"])))))
              .select(*rkey, "ord", "line", "golden_idx", "golden_line", F.lit(1).alias("distance")))
    return exact.unionByName(beside)


def _first_line():
    """The first line that a piece of its parity may hold."""
    return F.col("piece") * (1 << PIECE_BITS) + F.col("parity")


def _taken(spot, k):
    """How many findings of the line after a labelled line takes, if ``k`` are gone before it.

    It takes the first of a sorted list without the first ``k`` of the line before; what it
    takes of the line after are its first ones, so one number says all.
    """
    n = F.size(spot["gs"])
    return F.least(n, F.size(F.filter(spot["after"], lambda i: i < n + k)))


def _walk(spots: str, k0):
    """For each spot how many findings of the line before are gone."""
    start = F.struct(F.lit(None).cast("long").alias("line"), k0.cast("int").alias("next"), F.array().cast("array<int>").alias("ks"))

    def step(acc, s):
        line = s["golden_line"].cast("long")
        k = F.when(acc["line"].isNull() | (acc["line"] + 2 == line), acc["next"]).otherwise(F.lit(0))
        return F.struct(line.alias("line"), _taken(s, k).alias("next"), F.concat(acc["ks"], F.array(k)).alias("ks"))

    return F.aggregate(spots, start, step, lambda acc: acc["ks"])


def _applied(ks, k):
    """The carry out of a unit; one that does not depend on its carry in has one entry."""
    return F.get(ks, F.least(k, F.size(ks) - 1))


def _carries(pieces: DataFrame, key: list[str]) -> DataFrame:
    """key, piece, k0: the carry into each piece that follows another one without a gap.

    A segmented scan: a piece of a chain is a table from its carry in to its carry out, made
    where the piece is. Only the tables of pieces whose chain crosses their edge meet, one
    per ``1 << PIECE_BITS`` lines, and are looked up one after the other.
    """
    first, last = _first_line(), _first_line() + (1 << PIECE_BITS) - 2
    head, tail = F.element_at("spots", 1), F.element_at("spots", -1)
    joins, ends = head["golden_line"] == first, tail["golden_line"] == last
    spans = joins & (F.size("spots") == 1 << (PIECE_BITS - 1))
    whole = F.aggregate("spots", F.sequence(F.lit(0), head["n_lo"]), lambda ks, s: F.transform(ks, lambda k: _taken(s, k)))
    alone = F.array(F.aggregate("spots", F.struct(F.lit(None).cast("long").alias("line"), F.lit(0).alias("k")), lambda acc, s: F.struct(
        s["golden_line"].cast("long").alias("line"), _taken(s, F.when(acc["line"] + 2 == s["golden_line"], acc["k"]).otherwise(F.lit(0))).alias("k")), lambda acc: acc["k"]))
    # a table of one entry does not depend on the carry in
    units = pieces.filter((ends & (F.size(tail["after"]) > 0)) | (joins & (head["n_lo"] > 0))).select(
        *key, "piece", F.when(~ends, F.array(F.lit(0))).when(spans, whole).otherwise(alone).alias("ks"))
    begin = F.struct(F.lit(None).cast("long").alias("at"), F.lit(0).alias("k"), F.array().cast("array<struct<piece: bigint, k0: int>>").alias("out"))

    def go(acc, u):
        k = F.when(acc["at"] + 1 == u["piece"], acc["k"]).otherwise(F.lit(0))
        return F.struct(u["piece"].alias("at"), F.get(u["ks"], F.least(k, F.size(u["ks"]) - 1)).alias("k"),
                        F.when(k > 0, F.concat(acc["out"], F.array(F.struct(u["piece"], k.alias("k0"))))).otherwise(acc["out"]).alias("out"))

    files = units.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("piece", "ks"))).alias("units"))
    return files.select(*key, F.inline(F.aggregate("units", begin, go, lambda acc: acc["out"])))
