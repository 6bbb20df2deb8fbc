"""Values that checks over the driver tables do not reach."""

from pyspark.sql import functions as F

from judgelake.operators import inputs as N
from judgelake.operators import judging as J
from judgelake.operators import packaging as P
from judgelake.operators import stats as S
from judgelake.operators import units as U
from judgelake.sources import changes as CH
from judgelake.sources import ledger as L


def test_absent_keys_and_other_types_are_errors(spark, tmp_path):
    bodies = ['{"path":"a.py","after":"x"}', '{"path":"a.py","before":5,"after":"x"}', '{"path":"a.py","before":null,"after":"x"}', '{"before":"x","after":"y"}',
              '{"path":"a.py","before":"x","after":"y","old_path":null}', '{"path":null,"before":"x","after":"y"}']
    lines = ['{"head":"h","files":[%s]}' % b for b in bodies]
    (tmp_path / "d.jsonl").write_text("\n".join(lines) + "\n{bad\n")
    docs = CH.read_documents(spark, str(tmp_path / "d.jsonl"))
    assert [r._corrupt_record for r in docs.filter("damaged").collect()] == ["{bad"]
    named = spark.createDataFrame(list(enumerate(lines)), "doc_id int, value string")
    good, errors = N.validate_changes(CH.explode_files(CH.parse_documents(named)))
    assert sorted(r.doc_id for r in good.collect()) == [2, 4]
    assert {r.doc_id: r.error for r in errors.collect()} == {0: "before is missing", 1: "before must be a string", 3: "path is missing", 5: "path must be a string"}


def test_null_and_boolean_scores(spark):
    def answer(score):
        return '{"answers":{"severity":{%s"confidence":0.5},"is_real_issue":{"noul":0.4},"category":{"choice":"style"}}}' % score
    rows = [(0, answer('"score":null,')), (1, answer('"score":true,')), (2, answer("")), (3, answer('"score":1.5,')), (4, answer('"score":"1",')), (5, None)]
    got = {r.k: (r.outcome, r.severity) for r in J.parse_answers(spark.createDataFrame(rows, "k int, payload string")).collect()}
    assert got == {0: ("shape", None), 1: ("ok", 1.0), 2: ("ok", 0.0), 3: ("ok", 1.5), 4: ("shape", None), 5: ("transport", None)}


def test_only_lock_files_are_lock_changes(spark):
    rows = [(1, "LICENSE", None, "a", "b"), (2, "x/yarn.lock", None, "a", "b")]
    got = S.change_classes(spark.createDataFrame(rows, "range_id int, path string, old_path string, before string, after string"))
    assert {r.range_id: r.lockfile for r in got.collect()} == {1: False, 2: True}


def test_carriage_return_before_a_line_separator_stays(spark):
    diff = "diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -1 +1 @@\n-x\r\u2028\n+y\r\n"
    rows = P.parse_diff(spark.createDataFrame([(1, diff)], "change_id int, diff_text string")).collect()
    assert sorted(r.text for r in rows) == ["x\r\u2028", "y"]


def test_blank_lines_are_those_of_unicode(spark):
    texts = ["\u3000", "\xa0", " \t", "\x1f", "x", "\u200b", "", "x\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.col("t").rlike(U.BLANK).alias("b")).collect()
    assert {r.k: r.b for r in rows} == {k: not t.strip() for k, t in enumerate(texts)}


def test_the_last_record_of_equal_times_wins(spark, tmp_path):
    for ts in ('"2024-01-01T00:00:00Z"', "null"):
        folder = tmp_path / ts[1]
        folder.mkdir()
        (folder / "l.jsonl").write_text("".join('{"label":"a","repo":"r%d","ts":%s}\n' % (i, ts) for i in range(50)))
        runs = L.read_ledger(spark, str(folder))
        assert [r.repo for r in L.latest_by_label(runs.repartition(5)).collect()] == ["r49"]
