"""License scans: TF-IDF cosine of lines and licence files to templates, then inheritance
from the nearest directory above that holds a licence file."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import lower_ascii, small, stored

THRESHOLD = 0.6
#: Names of licence files, in lower case and without an ending.
FILE_NAMES = ("license", "licence", "copying", "unlicense")
BROADCAST_ROWS = 200_000
_SPLIT = "[^a-z0-9]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), _SPLIT), "")


def idf(n: int, df):
    """ln((1 + n) / (1 + files with the word)) + 1, of a number or of a column."""
    return (F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) if isinstance(df, Column) else math.log((1 + n) / (1 + df))) + 1


def weights(templates: dict[str, str], df: dict[str, int], n: int) -> dict[str, dict[str, float]]:
    """Unit TF-IDF vectors of the templates, idf by word over all ``n`` files."""
    out = {}
    for k, t in templates.items():
        raw = {w: tf * idf(n, df.get(w, 0)) for w, tf in Counter(w for w in re.split(_SPLIT, t.lower()) if w).items()}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        out[k] = {w: x / norm for w, x in raw.items()}
    return out


def frequencies(files: DataFrame) -> DataFrame:
    """w, c: in how many files each word of the column ``text`` is."""
    return files.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))


def counted(words: DataFrame, counts: DataFrame, frequent: int | None = None) -> DataFrame:
    """``words`` (w and others) with the stored count ``c`` of their word.

    Counts of at most ``frequent`` of the most frequent words are broadcast, so that none of
    them is a join key; only rarer words are joined by shuffle.
    """
    levels, kept, least = counts.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).toPandas(), 0, None
    for c, k in zip(levels["c"], levels["k"]):
        kept += k
        if kept > (BROADCAST_ROWS if frequent is None else frequent):
            break
        least = int(c)
    if kept == levels["k"].sum() and least is not None and least == levels["c"].min():
        return words.join(F.broadcast(counts), "w")
    least = 1 << 62 if least is None else least
    held = words.join(F.broadcast(counts.filter(F.col("c") >= least)), "w", "left")
    # words that have their count look for another under keys of their own, spread over tasks
    held = held.withColumn("rare", F.when(F.col("c").isNull(), F.col("w")).otherwise(F.concat(F.lit("-"), F.xxhash64(*[x for x in words.columns]).cast("string"))))
    rest = counts.filter(F.col("c") < least).select(F.col("w").alias("rare"), F.col("c").alias("more"))
    return held.join(rest, "rare", "left").select(*words.columns, F.coalesce("c", "more").alias("c"))


def telling(vectors: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Words of which a text must have one to reach the threshold with any template: those
    left when each template's lightest words, too light together to reach it, are put aside."""
    need = set()
    for v in vectors.values():
        light = 0.0
        for w, x in sorted(v.items(), key=lambda p: (p[1], p[0])):
            light += x * x
            if light >= threshold * threshold * (1 - 1e-9):
                need.add(w)
    return sorted(need)


def declared(files: DataFrame, templates: dict[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """path, part, declared, score, line: the best template of any line of a file, or of the
    whole text of a licence file (line null), at ``threshold`` or above. Ties go to the
    first template in order, then to the first line. ``files`` has path, part, text, is_file.
    Equal rows are one file: they count its words in the same proportions.
    """
    spark, vocabulary = files.sparkSession, sorted({w for t in templates.values() for w in re.split(_SPLIT, t.lower()) if w})
    n, need = files.count(), []
    if vocabulary:
        counts = stored(frequencies(files), "licence-words")
        vectors = weights(templates, {r.w: r.c for r in counts.filter(F.col("w").isin(vocabulary)).collect()}, n)
        need = telling(vectors, threshold)
    if not need:
        return files.select("path", "part", F.lit("").alias("declared"), F.lit(0.0).alias("score"), F.lit(0).alias("line")).limit(0)
    pattern = "(?i)(?<![a-z0-9])(" + "|".join(map(re.escape, need)) + ")(?![a-z0-9])"
    hit = files.filter(F.col("text").rlike(pattern))
    lines = hit.select("path", "part", F.posexplode(F.split("text", "\r\n|[\n\r]")).alias("line", "unit")).filter(F.col("unit").rlike(pattern))
    units = lines.unionByName(hit.filter("is_file").select("path", "part", F.lit(None).cast("int").alias("line"), F.col("text").alias("unit")))
    words = units.select("path", "part", "line", F.explode(_words(F.col("unit"))).alias("w")).groupBy("path", "part", "line", "w").agg(F.count("*").alias("tf"))
    model = spark.createDataFrame([(w, k, x) for k, v in vectors.items() for w, x in v.items()], "w string, template string, x double")
    weighed = counted(words, counts).withColumn("y", F.col("tf") * idf(n, F.col("c")))
    unit = ["path", "part", F.coalesce("line", F.lit(-1)).alias("at")]
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
    dots = (weighed.join(small(model, BROADCAST_ROWS, sum(map(len, vectors.values()))), "w").groupBy(*unit, "template").agg(F.sum(F.col("x") * F.col("y")).alias("dot")))
    scored = dots.join(norms, ["path", "part", "at"]).withColumn("score", F.least(F.lit(1.0), F.round(F.col("dot") / F.col("norm"), 9))).filter(F.col("score") >= threshold)
    best = scored.groupBy("path", "part").agg(F.min(F.struct((-F.col("score")).alias("s"), "template", "at")).alias("b"))
    return best.select("path", "part", F.col("b.template").alias("declared"), (-F.col("b.s")).alias("score"), F.when(F.col("b.at") >= 0, F.col("b.at")).alias("line"))


def inherited(dirs: DataFrame, licensed: DataFrame) -> DataFrame:
    """dir, licence, origin for each of ``dirs`` (dir) from the nearest of itself and the
    directories above it that ``licensed`` (dir, licence, one row each) has.

    A directory meets the licences at the paths above it; the root is the empty path.
    """
    pieces = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(pieces))), lambda i: F.array_join(F.slice(pieces, 1, i), "/"))
    met = dirs.select("dir", F.explode(above).alias("up")).join(licensed.select(F.col("dir").alias("up"), "licence"), "up")
    return met.groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "licence", "up")).alias("m")).select("dir", F.col("m.licence").alias("licence"), F.col("m.up").alias("origin"))


def scan(files: DataFrame, templates: dict[str, str], path: str = "path", text: str = "text", keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """``keep``, path, declared, score, line, licence, origin, one row per input row.

    ``licence`` is what the file declares in a line of its own, else the licence of the
    nearest directory above with a licence file that declares one (``origin``: that
    directory; null if own or none). Several licence files of a directory: the closest
    match, then the first template. Null text declares nothing; a null path gives and
    inherits nothing. Repeated rows each get their row. Only the named columns are read.
    Lines are compared whole, at any length, and every line of a text is.
    """
    p = F.col(path)
    rows = files.select(*[F.col(k) for k in keep], p.alias("_path"), F.coalesce(p, F.lit("")).alias("path"), F.hash(F.col(text)).alias("part"), F.col(text).alias("text"))
    name = lower_ascii(F.regexp_extract("path", "[^/]*$", 0))
    base = F.regexp_extract(name, r"^[^.]*", 0).isin(*FILE_NAMES) & F.col("_path").isNotNull()
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    own = declared(rows.select("path", "part", "text", base.alias("is_file")), templates, threshold)
    own_name = F.regexp_extract(lower_ascii(F.regexp_extract("path", "[^/]*$", 0)), r"^[^.]*", 0)
    licensed = (own.filter(own_name.isin(*FILE_NAMES) & (F.col("path") != "")).groupBy(parent.alias("dir"))
                .agg(F.min(F.struct((-F.col("score")).alias("s"), "declared")).alias("b")).select("dir", F.col("b.declared").alias("licence")))
    dirs = rows.filter("_path is not null").select(parent.alias("dir")).distinct()
    found = inherited(dirs, licensed)
    joined = (rows.drop("text").withColumn("part", F.coalesce("part", F.lit(0))).withColumn("dir", F.when(F.col("_path").isNotNull(), parent))
              .join(own.withColumnRenamed("path", "path"), ["path", "part"], "left").join(found, "dir", "left"))
    return joined.select(*keep, F.col("_path").alias("path"), "declared", "score", "line", F.coalesce("declared", "licence").alias("licence"),
                         F.when(F.col("declared").isNull(), F.col("origin")).alias("origin"))
