"""Benchmark decontamination by a positional inverted index.

The index holds a posting (document, position, term) for every document word that some
item also has. It is dealt by document, as each scan task writes the postings of its own
documents, so no frequent term is ever gathered in one place. Matching starts from the
rarest term of each window, meets it with the second rarest, and checks the others only
where both stand at the right distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import lower_ascii, small, stored

#: Words are runs of anything but these ASCII characters, after A-Z is lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rows of a side that may be broadcast; larger sides are joined by a shuffle.
BROADCAST_ROWS = 200_000
DOC = ["did", "part"]


def words(text: Column | str) -> Column:
    """The words of a text in order; none for null."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), SEPARATORS), ""), F.array().cast("array<string>"))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """did, part, doc_id, words: ``part`` tells texts of one id apart; equal rows share a key."""
    return docs.select(F.coalesce(F.col(doc_id), F.lit(-(1 << 62))).alias("did"), F.coalesce(F.hash(F.col(text)), F.lit(0)).alias("part"),
                       F.col(doc_id).alias("doc_id"), words(text).alias("words"))


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """item, start, n, off, term: the terms of every window of every item.

    A window is ``window`` words in a row; an item of fewer words is one window. Items
    without an id or without words have none; equal windows of an item count once.
    """
    w = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), words(text).alias("w")).filter("size(w) > 0").distinct()
    at = w.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))).alias("start"))
    cut = at.select("item", F.slice("w", F.col("start"), F.lit(window)).alias("w")).distinct()
    return cut.select("item", F.sha2(F.to_json("w"), 256).alias("win"), F.size("w").alias("n"), F.posexplode("w").alias("off", "term"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings did, part, pos, tid of all words of ``keyed`` documents that ``terms`` has.

    The vocabulary is broadcast if it is small and joined by a shuffle if not.
    """
    vocabulary = terms.select("term").distinct().select("term", F.xxhash64("term").alias("tid"))
    spread = docs.select("did", "part", F.posexplode("words").alias("pos", "term"))
    return stored(spread.join(small(vocabulary, BROADCAST_ROWS), "term").select("did", "part", "pos", "tid"), "postings")


def matches(index: DataFrame, terms: DataFrame, slop: int = 0) -> DataFrame:
    """did, part, item, start, n: every place where all terms of a window occur.

    With ``slop`` 0 these are exact phrases; otherwise every other term may stand up to
    ``slop`` words off its place as seen from the rarest term (proximity matches). Windows
    have at most 63 words. Repeated documents count once.
    """
    df = index.groupBy("tid").agg(F.count("*").alias("df"))
    ranked = (terms.withColumn("tid", F.xxhash64("term")).join(df, "tid", "left").na.fill(0, ["df"])
              .groupBy("item", "win", "n").agg(F.array_sort(F.collect_list(F.struct("df", "off", "tid"))).alias("lists")))
    ranked = stored(ranked.filter(F.col("lists")[0]["df"] > 0), "windows")
    n_windows = ranked.count()
    first = ranked.select("item", "win", "n", F.col("lists")[0]["tid"].alias("tid"), F.col("lists")[0]["off"].alias("off"))
    pick = lambda rows: small(rows, BROADCAST_ROWS, n_windows)
    spot = (index.join(pick(first), "tid").select(*DOC, "item", "win", "n", (F.col("pos") - F.col("off")).alias("start"), F.col("off").alias("off0"))
            .filter("start >= 0").distinct())
    # the second rarest list, moved by its offset
    near = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
    second = ranked.filter("n > 1").select("item", "win", F.col("lists")[1]["tid"].alias("tid"), F.col("lists")[1]["off"].alias("off"))
    asked = spot.join(pick(second), ["item", "win"]).withColumn("by", near).withColumn("pos", F.col("start") + F.col("off") + F.col("by"))
    held = index.join(pick(second.select("tid").distinct()), "tid", "left_semi")
    both = (held.join(asked.select(*DOC, "item", "win", "n", "start", "off0", "pos", "tid").hint("shuffle_hash"), [*DOC, "pos", "tid"])
            .select(*DOC, "item", "win", "n", "start", "off0").distinct())
    both = stored(both, "candidates")
    # all others, only in documents that hold a candidate
    rest = ranked.filter("n > 2").select("item", "win", F.explode(F.slice("lists", 3, 64)).alias("l")).select("item", "win", F.col("l.tid").alias("tid"), F.col("l.off").alias("off"))
    wanted = (both.filter("n > 2").join(small(rest, BROADCAST_ROWS), ["item", "win"]).withColumn("by", near)
              .select(*DOC, "item", "win", "n", "start", "off", "tid", (F.col("start") + F.col("off") + F.col("by")).alias("pos")))
    inside = index.join(small(both.filter("n > 2").select(*DOC).distinct(), BROADCAST_ROWS), DOC, "left_semi")
    full = (inside.join(wanted.hint("shuffle_hash"), [*DOC, "pos", "tid"])
            .groupBy(*DOC, "item", "win", "n", "start").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("seen"))
            .filter("bit_count(seen) = n - 2").drop("seen"))
    whole = full.select(*DOC, "item", "start", "n").union(both.filter("n = 2").select(*DOC, "item", "start", "n"))
    return whole.union(spot.filter("n = 1").select(*DOC, "item", "start", "n")).distinct()


def covered(found: DataFrame) -> DataFrame:
    """did, part, n_hit, items: words inside any match, and the sorted distinct items.

    Starts are taken in order; each adds the words past the farthest end before it. A
    repeated document is one key, so what is ordered together is one text's matches.
    """
    from pyspark.sql import Window

    ends = found.groupBy(*DOC, "start").agg(F.max(F.col("start") + F.col("n")).alias("end"), F.collect_set("item").alias("items"))
    before = Window.partitionBy(*DOC).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = ends.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))))
    return fresh.groupBy(*DOC).agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def scan(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids as text), one row per input row.

    Null and empty texts have no words; so have empty items, which match nothing. Repeated
    rows each get their row. Only ``doc_id`` and ``text`` are read. Empty tables give no
    rows (documents) or no hits (items). Texts are read whole, at any length.
    """
    rows = keyed(docs, doc_id, text)
    terms = item_terms(items, window=window)
    hits = covered(matches(build_index(rows, terms), terms, slop))
    counted = rows.select(*DOC, F.col("doc_id").alias(doc_id), F.size("words").cast("long").alias("n_words"))
    return counted.join(hits, DOC, "left").select(
        doc_id, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item's window occurs in.

    The keys of contaminated rows are broadcast if they are few and joined by a shuffle if not.
    """
    key = [F.coalesce(F.col(doc_id), F.lit(-(1 << 62))), F.coalesce(F.hash(F.col(text)), F.lit(0))]
    terms = item_terms(items)
    hit = stored(matches(build_index(keyed(docs, doc_id, text), terms), terms).select(*DOC).distinct(), "contaminated")
    return docs.withColumns(dict(zip(("_did", "_part"), key))).join(
        small(hit.toDF("_did", "_part"), BROADCAST_ROWS), ["_did", "_part"], "left_anti").drop("_did", "_part")
