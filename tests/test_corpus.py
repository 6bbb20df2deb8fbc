"""Second sampling pass against a plain loop; corpus files round trip."""

import datetime
import hashlib
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake import session as S
from judgelake.functions import texts as X
from judgelake.operators import corpus as B
from judgelake.plans import queries_corpus as QC
from judgelake.sources import corpus as CO
from judgelake.sources import lines as LN


def test_second_pass_draws_even_rounds_of_whole_pull_requests(spark):
    rng = random.Random(11)
    for target in (7, 40, 90):
        sizes = [(f"r{r}", pr, rng.choice([1, 1, 2, 3, 8, 30]), f"{rng.random():.9f}") for r in range(5) for pr in range(rng.randrange(1, 30))]
        n = {(s[0], s[1]): s[2] for s in sizes}
        first = {(s[0], s[1]) for s in sizes if s[3] < "0.05"}
        df = spark.createDataFrame(sizes, "repo string, pr int, n bigint, key string")
        got = {(r.repo, r.pr) for r in B.sample_second_pass(df, df.filter("key < '0.05'"), target).collect()}
        left = target - sum(n[x] for x in first)
        assert not got & first and sum(n[x] for x in got) <= max(0, left)
        queue = {r: [s[:2] for s in sorted(sizes, key=lambda s: (s[3], s[1])) if s[0] == r and s[:2] not in first and s[2] <= left] for r in {s[0] for s in sizes}}
        order = [x for k in range(30) for r in sorted(queue) for x in queue[r][k:k + 1]]
        assert got == set(order[:len(got)])  # no draw skips another
        assert len(got) == len(order) or left <= 0 or sum(n[x] for x in order[:len(got) + 1]) > left


def test_corpus_round_trip_and_duplicates(spark, tmp_path):
    prs = spark.createDataFrame([("o/r#1@pre", "o/r", "a" * 40, "b" * 40, "clean", "train", "fix-pr")], K.PRS_COLUMNS)
    LN.write_tsv(prs, f"{tmp_path}/c/prs.tsv", K.PRS_COLUMNS, "do not edit")
    back = CO.read_corpus(spark, f"{tmp_path}/c")
    assert back["prs"].collect() == prs.collect() and back["issues"].count() == 0
    LN.write_tsv(prs, f"{tmp_path}/c/local/prs.tsv", K.PRS_COLUMNS)
    with pytest.raises(LN.RejectedRows):
        CO.read_corpus(spark, f"{tmp_path}/c")


def test_tsv_rejects_name_the_line(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("# c\na\tb\n1\t2\n\n1\n")
    rows, bad = LN.parse_tsv(LN.number_lines(LN.read_lines(spark, str(tmp_path / "x.tsv"))), ["a", "b"])
    assert [(r.line_no, r.a) for r in rows.collect()] == [(3, "1")]
    assert [(r.line_no, r.error) for r in bad.collect()] == [(5, "expected 2 columns, got 1")]
    with pytest.raises(LN.RejectedRows):
        LN.write_tsv(spark.createDataFrame([("a\tb",)], "a string"), f"{tmp_path}/bad", ["a"])


def _scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("Exchange")


def test_readers_are_strict_in_one_scan(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("# c\na\tb\n1\t2\n\n3\t\"4\n")
    rows = LN.read_tsv(spark, str(tmp_path / "x.tsv"), ["a", "b"])
    assert _scans(rows) == (1, 0) and [tuple(r) for r in rows.collect()] == [("1", "2"), ("3", '"4')]
    (tmp_path / "y.tsv").write_text("1\t2\n" * 9 + "only\n")
    bad = LN.read_tsv(spark, str(tmp_path / "y.tsv"), ["a", "b"])
    for act in (bad.count, bad.select("b").collect, bad.filter("a = 'x'").collect, lambda: bad.agg({"b": "max"}).collect()):
        with pytest.raises(Exception, match="y.tsv: expected 2 columns, got 1: only"):
            act()
    assert [(r.line_no, r.error) for r in LN.tsv_rejects(spark, str(tmp_path / "y.tsv"), ["a", "b"]).collect()] == [(10, "expected 2 columns, got 1")]
    (tmp_path / "z.jsonl").write_text('# {"m": 1}\n\n{"a": 1}\n{bad\n')
    rows = LN.read_jsonl(spark, str(tmp_path / "z.jsonl"), "a int")
    assert _scans(rows) == (1, 0)
    for act in (rows.count, rows.collect):
        with pytest.raises(Exception, match="z.jsonl: no record of the schema: .bad"):
            act()
    assert [(r.line_no, r.value) for r in LN.jsonl_rejects(spark, str(tmp_path / "z.jsonl"), "a int").collect()] == [(4, "{bad")]


def test_a_failed_tsv_write_names_rows_and_leaves_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), "x\ty" if k > 3 else None) for k in range(20)], "a string, b string")
    with pytest.raises(LN.RejectedRows) as e:
        LN.write_tsv(rows, f"{tmp_path}/w", ["a", "b"], "note")
    assert str(e.value).count("x\\ty") == 5
    assert not [p for p in (tmp_path / "w").glob("part-*")] if (tmp_path / "w").exists() else True
    LN.write_tsv(rows.filter("a < '3'").limit(3), f"{tmp_path}/w", ["a", "b"], "note")
    assert LN.read_tsv(spark, f"{tmp_path}/w", ["a", "b"]).count() == 3


def test_missing_jsonl_is_empty_and_meta_is_read(spark, tmp_path):
    assert LN.read_jsonl(spark, f"{tmp_path}/none.jsonl", "a int").count() == 0
    LN.write_jsonl(spark.createDataFrame([(2, None)], "b int, a string"), f"{tmp_path}/j", '{"seed": 1}')
    assert LN.read_jsonl(spark, f"{tmp_path}/j", "a string, b int").collect()[0].asDict() == {"a": None, "b": 2}
    assert {"seed": "1"} in [r.meta for r in LN.read_meta(spark, f"{tmp_path}/j").collect()]


def test_promotions_give_issues_or_warnings(spark):
    pre = spark.createDataFrame([("o/r", 1, "b", "h1", "s", "src", True), ("o/r", 2, "b", "h2", "s", "src", True), ("o/r", 3, "b", "h3", "s", "src", True), ("o/r", 4, "b", "h4", "s", "src", False)],
                                "repo string, pr int, base_sha string, final_head string, split string, source string, all_fixed boolean")
    promos = spark.createDataFrame([("o/r#1@final", "a.py", 1, "one", None, "x|y"), ("o/r#1@final", "a.py", 2, "zwei", "major", ""), ("o/r#2@final", "a.py", 9, "one", None, ""), ("o/r#4@final", "a.py", 1, "one", None, "")],
                                   "sample_id string, file string, line int, verify_substring string, severity_class string, evidence string")
    lines = spark.createDataFrame([("o/r", h, "a.py", k + 1, t) for h in ("h1", "h2", "h3", "h4") for k, t in enumerate(("one", "two"))], "repo string, sha string, file string, line int, text string")
    samples, issues, warnings = B.final_samples(pre, promos, lines)
    assert sorted((r.sample_id, r.kind, r.source) for r in samples.collect()) == [("o/r#1@final", "positive", "promoted"), ("o/r#3@final", "clean", "src")]
    assert [tuple(r) for r in issues.select(*K.ISSUE_COLUMNS).collect()] == [("o/r#1@final", "a.py", "1", "one", "minor", "", "x\\|y", "", "claude", "n")]
    assert sorted((r.sample_id, r.line, r.problem) for r in warnings.collect()) == [("o/r#1@final", 2, "lacks substring"), ("o/r#2@final", 9, "out of range")]


def test_packed_commits_unpack_to_their_text(spark):
    texts = ["0123456789abcdef" * 2 + "01234567", "A" * 40, "a" * 39, "a" * 40 + "\n", "", "é", "v1.0", None]
    rows = spark.createDataFrame([(x,) for x in texts], "sha string").withColumn("packed", X.pack_sha(F.col("sha")))
    got = rows.select("sha", X.unpack_sha(F.col("packed")).alias("back"), F.length("packed").alias("n")).collect()
    assert [r.back for r in got] == texts and [r.n for r in got][:2] == [20, 61]


def test_pre_heads_ties_by_text_and_takes_only_the_columns_there_are(spark):
    rows = spark.createDataFrame([
        ("o/r", 1, "zz", "real-bug", 3, None), ("o/r", 1, "a" * 40, "real-bug", 2, "fix-pr"), ("o/r", 1, None, "style", 1, None),
        ("o/r", 2, "b" * 40, "style", 2, None), ("o/r", 2, "main", "style", 1, None)],
        "repo string, pr int, original_commit string, label string, ord bigint, disposition_source string")
    got = {r.pr: (r.pre_head, r.source) for r in B.pre_heads(rows).collect()}
    assert got == {1: ("a" * 40, "fix-pr"), 2: ("main", "thread-fix")}
    whole = rows.withColumns({"base_ref_oid": F.concat(F.lit("base"), "ord"), "head_ref_oid": F.lit("c" * 40)})
    assert {(r.pr, r.base_sha, r.final_head) for r in B.pre_heads(whole).collect()} == {(1, "base1", "c" * 40), (2, "base1", "c" * 40)}


def test_corpus_queries_write_only_what_they_read(spark, monkeypatch):
    lines = [(k // 3, k % 4 + 1, k * 5 % 30, k % 3, 4.0, datetime.date(2024, 1, 2)) for k in range(60)]
    li = spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_shipdate date")
    monkeypatch.setattr(QC.V, "table", lambda spark, sf, name: li)
    seen = {}
    monkeypatch.setattr(QC, "written", lambda df, name: seen.setdefault(name, df))
    assert QC.i14(spark, "").count() > 0
    assert set(seen["verified"].columns) == set(QC.ANCHORED) and not {"base_ref_oid", "evidence"} & set(seen["resolved"].columns)
    assert seen["resolved"].count() and not {"base_sha", "final_head"} & set(seen["heads"].columns)


def test_spot_checks_draw_by_ids_alone(spark, monkeypatch):
    outcomes, labels = ["fixed", "not-applied", "unaddressed", "unknown", None], ["real-bug", "style", "false-positive", None]
    adj = spark.createDataFrame([(f"c{k % 95}", "f", 1, labels[k % 4], None, "e") for k in range(100)], "candidate_id string, file string, line int, label string, severity_class string, evidence string")
    cands = spark.createDataFrame([(f"c{k}", "o/r", "sha", "u", outcomes[k % 5], "gone" if k % 9 == 0 else None) for k in range(99)],
                                  "id string, repo string, original_commit string, thread_url string, disposition string, error string")
    asked = []
    monkeypatch.setattr(B, "hash_cut", lambda rows, *a, cut=B.hash_cut: asked.append(rows.columns) or cut(rows, *a))
    got = sorted(((r.candidate_id, r.why, r.label) for r in B.spot_check_rows(adj, cands, seed=3).collect()), key=lambda r: (r[0], r[1], r[2] or ""))
    assert asked == [["candidate_id"]]
    rows = [(f"c{k % 95}", outcomes[k % 95 % 5], labels[k % 4]) for k in range(100) if k % 95 % 9]
    order = sorted((hashlib.sha256(f"3:{c}".encode()).hexdigest(), c) for c, _, _ in rows)
    last = order[max(1, round(len(order) * 0.2)) - 1]
    want = []
    for c, d, x in rows:
        why = ["random"] * ((hashlib.sha256(f"3:{c}".encode()).hexdigest(), c) <= last)
        why += ["disagreement"] * ((d == "fixed" and x == "false-positive") or (d in ("not-applied", "unaddressed") and x == "real-bug"))
        if why:
            want.append((c, "+".join(why), x))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2] or ""))


def test_anchors_are_shuffled_once(spark, tmp_path):
    """Winners are told apart without a second copy of the rows; rows without a whole anchor are in neither part."""
    rows = spark.createDataFrame(
        [("c3", "r", 1, "f", 1, "style", False), ("c2", "r", 1, "f", 1, "real-bug", False), ("c1", "r", 1, "f", 1, "style", True), ("c4", "r", 1, "f", 2, "style", False),
         ("c4", "r", 1, "f", 2, "style", False), ("c5", "r", 1, None, 2, "style", False), ("c6", None, 1, "f", 1, "real-bug", True)],
        "candidate_id string, repo string, pr int, file string, line int, label string, human boolean")
    rows.write.parquet(str(tmp_path / "rows"))
    kept, lost = B.dedupe_anchors(spark.read.parquet(str(tmp_path / "rows")))
    assert sorted(r.candidate_id for r in kept.collect()) == ["c1", "c4", "c4"]
    assert sorted((r.candidate_id, r.kept_id) for r in lost.collect()) == [("c2", "c1"), ("c3", "c1")]
    for part in (kept, lost):
        assert part.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rows_and_file_lines_are_shuffled_once(spark, tmp_path):
    """Repeated lines repeat a row; null keys meet nothing."""
    rows = spark.createDataFrame(
        [("c1", "r", "a" * 40, "f", 1, "x"), ("c2", "r", "a" * 40, "f", 2, "x"), ("c3", "r", "a" * 40, "f", 9, "x"), ("c4", "r", "a" * 40, "g", 1, "x"), ("c5", "r", None, "f", 1, "x"),
         ("c6", "r", "a" * 40, "f", None, "x"), ("c7", "r", "main", "f", 3, None), ("c8", "r", "main", "f", 1, "x"), ("c8", "r", "main", "f", 1, "x"), ("c9", "r", "b" * 40, "f", 1, "x")],
        "candidate_id string, repo string, pre_head string, file string, line int, verify_substring string")
    lines = spark.createDataFrame(
        [("r", "a" * 40, "f", 1, "axb"), ("r", "a" * 40, "f", 2, "x"), ("r", "a" * 40, "f", 2, None), ("r", "main", "f", 1, "x"), ("r", "main", "f", 3, "x"), ("r", None, "f", 1, "x"), ("r", "b" * 40, "f", None, "x")],
        "repo string, sha string, file string, line bigint, text string")
    rows.write.parquet(str(tmp_path / "rows"))
    lines.write.parquet(str(tmp_path / "lines"))
    got = B.verify_rows(spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "lines")))
    assert sorted((r.candidate_id, r.problem or "") for r in got.collect()) == [
        ("c1", ""), ("c2", ""), ("c2", "lacks substring"), ("c3", "out of range"), ("c4", "missing"), ("c5", "missing"), ("c6", "lacks substring"),
        ("c7", "lacks substring"), ("c8", ""), ("c8", ""), ("c9", "missing")]
    assert got.columns == ["repo", "file", "line", "candidate_id", "verify_substring", "problem", "pre_head"]
    assert {(r.candidate_id, r.pre_head) for r in got.collect()} >= {("c1", "a" * 40), ("c5", None), ("c7", "main")}
    assert _scans(got.select("*"))[1] == 1


def test_issue_and_dismissed_rows_carry_what_they_show(spark, monkeypatch):
    lines = [(k // 3, k % 4 + 1, k * 5 % 37, k % 3, 4.0, datetime.date(2024, 1, 2)) for k in range(90)]
    li = spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_shipdate date")
    monkeypatch.setattr(QC.V, "table", lambda spark, sf, name: li)
    for made, gone, label in ((QC.i15_issues, "dismissal_reason", "real-bug"), (QC.i15_dismissed, "evidence", "style")):
        seen = {}
        monkeypatch.setattr(QC, "written", lambda df, name: seen.setdefault(name, df))
        assert made(spark, "").count() > 0
        assert gone not in seen["resolved"].columns
        shown = "evidence" if label == "real-bug" else "dismissal_reason"
        assert {r[0] for r in seen["resolved"].filter(F.col(shown).isNotNull()).select(F.col("label") == "real-bug").distinct().collect()} == {label == "real-bug"}


def test_corpus_rows_of_absent_columns(spark):
    kept = spark.createDataFrame([("o/r", 1, "f", 2, "x", "style", False), ("o/r", 1, "f", 3, "x", "real-bug", True)],
                                 "repo string, pr int, file string, line int, verify_substring string, label string, human boolean")
    issues, dismissed = B.corpus_rows(kept)
    assert [tuple(r) for r in issues.select("line", "severity_class", "category", "evidence", "fix_sha", "spot_checked").collect()] == [("3", "minor", "", "", "", "y")]
    assert [tuple(r) for r in dismissed.select("line", "dismissal_reason", "spot_checked").collect()] == [("2", "other", "n")]


def _shuffle_files(spark):
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", names))


def test_written_rows_keep_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    rows = S.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    for _ in range(50):
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before
    assert sorted(map(tuple, rows.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert spark.conf.get(S.DROP_SHUFFLES, None) in (None, "false")


def test_slices_hold_each_row_once(spark, monkeypatch):
    rows = spark.createDataFrame([(f"k{k % 40}", k) for k in range(100)] + [(None, 1), ("k1", None), (None, None)], "a string, b int")
    assert [rows.filter(part("a", "b")).count() for part in S.slices(rows)] == [103]
    monkeypatch.setattr(S, "SLICE_ROWS", 20)
    found = [rows.filter(part("a", "b")).collect() for part in S.slices(rows)]
    assert len(found) == 6 and max(map(len, found)) < 40 and sorted(map(repr, sum(found, []))) == sorted(map(repr, rows.collect()))
    keys = [{r.a for r in rows.filter(part("a")).collect()} for part in S.slices(rows)]
    assert sum(map(len, keys)) == 41


def _sliced(spark, tmp_path, monkeypatch, *made):
    """Rows in slices are the rows in one; returns the tables that each query leaves in the shared folder."""
    lines = [(k // 5, k % 5 + 1, (3, 33, 8, 4, 7)[k % 5] + k // 5 % 7 * 30, k // 5 % 3, 4.0, datetime.date(2024, 1, 2)) for k in range(180)]
    lines += lines[:20] + [(None, 1, 5, 1, 4.0, None), (3, 1, None, 1, 4.0, None), (4, None, 9, None, None, None)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_shipdate date").coalesce(1).write.parquet(str(tmp_path / "li"))
    monkeypatch.setattr(QC.V, "table", lambda spark, sf, name: spark.read.parquet(str(tmp_path / "li")))
    left = {}
    for make in made:
        whole = sorted(map(repr, make(spark, "").collect()))
        folders, steps = [], []
        with monkeypatch.context() as m:
            m.setattr(S, "SLICE_ROWS", 150)
            m.setattr(S, "scratch_path", lambda spark, name, f=S.scratch_path: folders.append(f(spark, name)) or folders[-1])
            m.setattr(QC, "written_in_turn", lambda parts, name: S.written_in_turn((steps.append(name) or p for p in parts), name))
            got = sorted(map(repr, make(spark, "").collect()))
        assert got == whole and whole
        assert {"resolved", "heads", "headed", "verified"} <= {name for name in steps if steps.count(name) == 2}
        left[make.__name__] = sorted(os.path.basename(f).rpartition("-")[0] for f in folders if os.path.exists(f.removeprefix("file:")))
    return left


def test_verified_and_deduplicated_rows_in_slices(spark, tmp_path, monkeypatch):
    left = _sliced(spark, tmp_path, monkeypatch, QC.i14_losers, QC.i15_dismissed)
    assert left == {"i14_losers": ["verified"], "i15_dismissed": ["verified"]}


def test_samples_in_slices(spark, tmp_path, monkeypatch):
    assert _sliced(spark, tmp_path, monkeypatch, QC.i15) == {"i15": ["pre-samples"]}


def test_promotions_in_slices(spark, tmp_path, monkeypatch):
    assert _sliced(spark, tmp_path, monkeypatch, QC.i15_promoted) == {"i15_promoted": ["final"]}
