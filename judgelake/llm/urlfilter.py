"""URL verdicts: host and path rules, then exact list membership by a Bloom filter cascade."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import cut, lower_ascii

#: Bits and hash functions a key; about 2 false positives in 100 keys at each level.
BITS_A_KEY, HASHES = 8, 5
#: Largest filter that is sent to the executors, over all levels. Beyond it membership
#: is a semi join, with the same result.
MAX_BYTES = 32 << 20


def url_parts(url: Column | str) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without ``://``."""
    u = F.col(url) if isinstance(url, str) else url
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return lower_ascii(host), path


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none fits.

    A rule is (verdict, host + path). It fits its host and all its subdomains if the path
    starts with the rule's path. Rules are a small configured list.
    """
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    n = F.lit(bits).cast("long")
    first, step = F.pmod(F.xxhash64(key, F.lit(level)), n), F.pmod(F.xxhash64(key, F.lit(~level)), n)
    return [(first + step * i + i * i) % n for i in range(HASHES)]


def _has(key: Column, level: int, bits: int, data: bytes) -> Column:
    """Whether all bits of ``key`` are set in ``data``."""
    found = F.lit(True)
    for p in _positions(key, level, bits):
        byte = F.conv(F.hex(F.substring(F.lit(bytearray(data)), (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = found & (F.pmod(F.floor(byte / F.pow(F.lit(2), p % 8)), F.lit(2)) == 1)
    return found


@dataclass
class Cascade:
    """Filters of alternating sides; odd levels hold listed keys, even ones the others."""

    levels: list[tuple[int, bytes]]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe the cascade was built over; null is not listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            bits, data = self.levels[level]
            answer = F.when(_has(key, level, bits, data), answer).otherwise(F.lit(level % 2 == 1))
        return F.coalesce(answer & key.isNotNull(), F.lit(False))


def build(universe: DataFrame, key: str = "key", listed: str = "listed", max_bytes: int = MAX_BYTES) -> Cascade | None:
    """The cascade over all distinct keys of ``universe``; None if it would pass ``max_bytes``.

    Level 1 holds the listed keys, level 2 the unlisted ones that pass level 1, level 3
    the listed ones that pass level 2, and so on until nothing passes. Every level is one
    aggregation: bits are joined by ``bit_or`` on the map side, so what is shuffled and
    fetched is the filter, never the keys. A key listed in any of its rows is listed; a
    null flag is not listed; null keys are left out. Without listed keys there is no level.
    """
    keys = cut(universe.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.coalesce(F.col(listed), F.lit(False))).alias("listed")))
    side, other = keys.filter("listed").select("key"), keys.filter("not listed").select("key")
    levels, total = [], 0
    n = side.count()
    while n:
        bits = 64 * max(1, -(-n * BITS_A_KEY // 64))
        total += bits // 8
        if total > max_bytes:
            return None
        at = F.explode(F.array(*_positions(F.col("key"), len(levels), bits)))
        words = dict(side.select(at.alias("p")).select(F.floor(F.col("p") / 64).alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
                     .groupBy("w").agg(F.bit_or("b").alias("b")).collect())
        data = b"".join(struct.pack("<q", words.get(w, 0)) for w in range(bits // 64))
        passed = cut(other.filter(_has(F.col("key"), len(levels), bits, data)))
        levels.append((bits, data))
        side, other, n = passed, side, passed.count()
    return Cascade(levels)


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: Column, url: str = "url", keep: tuple[str, ...] = ("page_id",),
          max_bytes: int = MAX_BYTES) -> DataFrame:
    """``keep``, host, path, rule, verdict (allow or block), one row per input row.

    A fitting rule decides; else a host on the list is blocked and any other allowed.
    ``listed`` says over the column ``host`` which keys the list holds; the universe is
    every distinct host of ``pages``. Null urls have empty host and path, so no rule fits.
    Other columns are not read; an empty table gives no rows.
    """
    host, path = url_parts(F.col(url))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    rule, says = rule_columns(F.col("host"), F.col("path"), rules)
    universe = rows.select("host").distinct().select(F.col("host").alias("key"), listed.alias("listed"))
    cascade = build(universe, max_bytes=max_bytes)
    if cascade is None:
        on = universe.filter("listed").select(F.col("key").alias("host"), F.lit(True).alias("on_list"))
        rows, member = rows.join(on, "host", "left"), F.col("on_list").isNotNull()
    else:
        member = cascade.contains(F.col("host"))
    return rows.select(*keep, "host", "path", rule.alias("rule"),
                       F.coalesce(says, F.when(member, "block").otherwise("allow")).alias("verdict"))
