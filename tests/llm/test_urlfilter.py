from pyspark.sql import functions as F

from judgelake.llm import urlfilter as U
from judgelake.llm.queries_urlfilter import RULES


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    for rows in (keys, keys.withColumn("listed", ~F.col("listed"))):
        c = U.build(rows.union(rows.limit(10)))
        assert len(c.levels) > 2
        assert rows.filter(c.contains(F.col("key")) != F.col("listed")).count() == 0


def test_empty_list_nulls_and_bound(spark):
    none = spark.createDataFrame([("a", False), ("b", None), (None, True)], "key string, listed boolean")
    c = U.build(none)
    assert c.levels == [] and none.filter(c.contains(F.col("key"))).count() == 0
    some = spark.createDataFrame([("a", True), ("b", False), ("a", False)], "key string, listed boolean")
    assert U.build(some, max_bytes=4) is None
    assert [r.key for r in some.distinct().filter(U.build(some).contains(F.col("key"))).select("key").distinct().collect()] == ["a"]


def test_rules_and_verdicts(spark):
    rows = [(1, "https://WWW.Example.org/en/17?x#y"), (2, "http://org"), (3, None), (4, "no scheme"), (5, "x://a.com/de/1"), (6, "x://spam.net/a://b"),
            (7, "x://acom/de/"), (8, "x://example.org/es/"), (9, "x://b.org/#"), (9, "x://b.org/#"), (10, "x://ok.net?q=://z/"), (11, "")]
    df = spark.createDataFrame([(a, b, "h", "v") for a, b in rows], "page_id long, url string, host string, verdict string")
    want = {(1, "www.example.org", "/en/17", "example.org/en/1", "block"), (2, "org", "", None, "allow"), (3, "", "", None, "allow"),
            (4, "", "", None, "allow"), (5, "a.com", "/de/1", "com/de/", "block"), (6, "spam.net", "/a://b", None, "block"), (7, "acom", "/de/", None, "allow"),
            (8, "example.org", "/es/", "example.org/es/", "block"), (9, "b.org", "/", "org/", "allow"), (10, "ok.net", "", None, "allow"), (11, "", "", None, "allow")}
    for bound in (U.MAX_BYTES, 1):
        out = U.judge(df, RULES, F.col("host").startswith("spam"), max_bytes=bound).collect()
        assert len(out) == 12 and {tuple(r) for r in out} == want
    assert U.judge(df.limit(0), RULES, F.lit(True)).count() == 0
