"""Diff parsing and clusters: shapes, forged headers, malformed headers."""

import random

import pytest
from pyspark.sql import functions as F

from judgelake.operators import packaging as P
from judgelake.sources.changes import read_diff_hunks


def parse(spark, text):
    rows = P.parse_diff(spark.createDataFrame([("c", text)], "change_id string, diff_text string")).orderBy("pos").collect()
    return [(r.file, r.kind, r.new_line, r.old_line, r.head_line, r.text) for r in rows]


def clusters(spark, text):
    d = spark.createDataFrame([("c", text)], "change_id string, diff_text string")
    return sorted([(r.file, r.line, r.line_start, r.line_end, r.n_changed, r.change_type) for r in P.package_diffs(d).collect()])


def test_replacement_clusters_anchor_on_added_lines(spark):
    text = ("diff --git a/s.py b/s.py\nindex 1..2 100644\n--- a/s.py\n+++ b/s.py\n@@ -8,12 +8,12 @@ def f\n a\n b\n c\n-x\n+y\n \n d\n-x2\n+y2\n \n-z\n+w\n e\n f\n g\n")
    assert [(c[1], c[4]) for c in clusters(spark, text)] == [(11, 2), (14, 2), (16, 2)]


def test_headers_inside_a_hunk_are_content(spark):
    text = ("--- a/q.sql\n+++ b/q.sql\n@@ -1,3 +1,3 @@\n--- old note\n+++ new note\n select 1 diff --git a/x b/x\n \n--- a/r.sql\n+++ b/r.sql\n@@ -5 +5 @@\n-a\n+b\n")
    got = parse(spark, text)
    assert [g[:2] for g in got] == [("q.sql", "-"), ("q.sql", "+"), ("q.sql", " "), ("q.sql", " "), ("r.sql", "-"), ("r.sql", "+")]
    assert got[0][5] == "-- old note" and got[2][5].startswith("select 1 diff")
    assert (got[4][3], got[5][2]) == (5, 5)


def test_whole_file_deletion_and_trailing_deletion(spark):
    gone = "diff --git a/old.py b/old.py\ndeleted file mode 100644\n--- a/old.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n\\ No newline at end of file\n"
    assert clusters(spark, gone) == [("old.py", 1, 1, 1, 2, "whole-file-deleted")]
    tail = "--- a/t.py\n+++ b/t.py\n@@ -9,3 +9,1 @@\n k\n-a\n-b\n"
    assert clusters(spark, tail) == [("t.py", 9, 9, 9, 2, "deletion-only")]


def test_rename_malformed_header_and_crlf(spark):
    text = ("diff --git a/a.py b/b.py\nsimilarity index 90%\nrename from a.py\nrename to b.py\n--- a/a.py\n+++ b/b.py\n@@ broken @@\n+one\r\n@@ -4,0 +5,2 @@\n+two\n+three\n")
    assert [(g[0], g[2], g[5]) for g in parse(spark, text)] == [("b.py", 1, "one"), ("b.py", 5, "two"), ("b.py", 6, "three")]


def test_context_stops_at_the_neighbour(spark):
    body = "".join(f" l{i}\n" for i in range(3))
    text = f"--- a/n.py\n+++ b/n.py\n@@ -1,10 +1,12 @@\n{body}+p\n m\n n\n+q\n{body}"
    d = spark.createDataFrame([("c", text)], "change_id string, diff_text string")
    m = P.cluster_members(P.parse_diff(d)).collect()
    for run, foreign in ((1, "q"), (2, "p")):
        assert foreign not in [r.text for r in m if r.run == run]
        assert sum(r.text in ("m", "n") for r in m if r.run == run) == 2


def test_triage_by_provider(spark):
    rows = [("c", 1, "a.py", 5, 200, "code-change", 1, 9), ("c", 2, "a.md", 5, 2, "code-change", 1, 9), ("c", 3, "b.py", 5, 200, "whole-file-deleted", 1, 9)]
    u = spark.createDataFrame(rows, "change_id string, ord int, file string, line int, size int, change_type string, line_start int, line_end int")
    assert [r.reason for r in P.triage(u).orderBy("ord").collect()] == [None, "docs/generated/lockfile", "whole-file-deleted>cap"]
    assert [r.reason for r in P.triage(u, can_split=False).orderBy("ord").collect()] == ["hunk>120 lines", "docs/generated/lockfile", "hunk>120 lines"]


def many_files(rng, n, git):
    """A diff of ``n`` files with lines that look like headers, and blank lines."""
    out = []
    for k in range(n):
        if git:
            out.append(f"diff --git a/f{k}.py b/f{k}.py")
            out += rng.choice([[], ["index 1..2 100644"], ["similarity index 90%", f"rename from f{k}"]])
            if rng.random() < 0.2:  # nothing but a head
                continue
        gone = rng.random() < 0.15
        out += [f"--- a/f{k}.py" + rng.choice(["", "\t2026"]), "+++ /dev/null" if gone else f"+++ b/f{k}.py\r"]
        for h in range(rng.randrange(1, 4)):
            lines = [rng.choice(["-", "+", " ", "--- x", "+++ y", "-- @@ z", "+diff --git a b", " ", "\\ No newline"]) + rng.choice(["", "a", "@@"]) for _ in range(rng.randrange(1, 9))]
            old = sum(x[0] in "- " for x in lines)
            new = sum(x[0] in "+ " for x in lines)
            out += [rng.choice([f"@@ -{h * 50 + 1},{old} +{h * 50 + 1},{new} @@ def", f"@@ -{h * 50 + 1},{old} +{h * 50 + 1},{new} @@"])] + lines
            if rng.random() < 0.1:
                out += ["@@ broken @@", "+one", ""]
    return "\n".join(out) + rng.choice(["", "\n"])


@pytest.mark.parametrize("size", [300, 10_000_000])
def test_files_read_in_splits_give_the_same_rows(spark, tmp_path, size):
    rng = random.Random(size)
    texts = {f"d{k}": many_files(rng, 25, k % 2 == 0) for k in range(4)} | {"one": "@@ -1 +1 @@\n-a\n+b\n", "none": "", "head": "--- a/x\n+++ b/x\n", "blank": "--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n a\n\n\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    d = spark.createDataFrame(list(texts.items()), "change_id string, diff_text string")
    columns = ["file", "file_deleted", "pos", "kind", "new_line", "old_line", "head_line", "text", "old_at", "hunk_start"]
    want = sorted((tuple(r) for r in P.parse_diff(d).select("change_id", *columns).collect()), key=repr)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.minPartitionNum", 1)
        hunks = read_diff_hunks(spark, str(tmp_path))
        got = P.parse_diff(hunks)
        assert sorted((tuple(r) for r in got.select(F.substring_index("change_id", "/", -1), *columns).collect()), key=repr) == want and len(want) > 200
        if size == 300:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
        want = sorted(tuple(r) for r in P.package_diffs(d).select("change_id", "file", "ord", "line", "line_start", "line_end", "n_changed", "change_type").collect())
        got = P.clusters(P.cluster_members(P.parse_diff(hunks)))
        assert sorted(tuple(r) for r in got.select(F.substring_index("change_id", "/", -1), "file", "ord", "line", "line_start", "line_end", "n_changed", "change_type").collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_lines_are_sorted_three_times(spark):
    """Windows that follow the position use the order of the segments; numbers count content lines only."""
    text = "--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n a\n-b\n+c\ndiff x\n d\n\\ no newline\n e\n@@ -9 +9 @@\n-z\n+y\n"
    assert parse(spark, text) == [
        ("f", " ", 1, 1, 1, "a"), ("f", "-", None, 2, 2, "b"), ("f", "+", 2, None, 2, "c"), ("f", " ", 3, 3, 3, "d"), ("f", " ", 4, 4, 4, "e"), ("f", "-", None, 9, 9, "z"), ("f", "+", 9, None, 9, "y")]
    entries = P.parse_diff(spark.createDataFrame([("c", text)], "change_id string, diff_text string"))
    assert entries._jdf.queryExecution().executedPlan().toString().count("Sort [") == 3
