import math
import subprocess
import sys
from pathlib import Path

import numpy as np

from judgelake.llm import langid as L
from judgelake.llm.queries_langid import op2_langid

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op2_langid(spark, SF).collect()
    assert len(rows) == len(want) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == want[r.doc_id] for r in held) / len(held) > 0.97


def test_backoff_against_plain_counts(spark):
    rows = [("en", "the cat the dog the"), ("en", "the thing cat"), ("fr", "le chat le chien le"), (None, "x y"), ("fr", None), ("fr", "le chat")]
    m = L.train(spark.createDataFrame(rows, "lang string, text string"))
    assert m.langs == ["en", "fr"] and set(m.words) == {"the", "cat", "le", "chat"}
    en = {"the": 4, "cat": 2}
    total = sum(en.values()) + 0.5 * 4
    assert all(math.isclose(m.word_logs[m.words[w], 0], math.log((en.get(w, 0) + 0.5) / total), rel_tol=1e-5) for w in m.words)
    marked, known = " chats ", []
    known = [m.gram_logs[m.grams[marked[i:i + 4]]] for i in range(4) if marked[i:i + 4] in m.grams]
    assert known and np.allclose(m.unseen("chats"), np.mean(known, axis=0))
    assert not m.unseen("日本").any()


def test_nulls_empty_long_and_clashing_columns(spark):
    m = L.train(spark.createDataFrame([("en", "the the cat cat"), ("fr", "le le chat chat")], "lang string, text string"))
    long = "le chat " * 60_000
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 ² ½ .", 1), (4, long, 1), (4, long, 1), (5, "THE", 1), (None, "日本", 1)],
                               "doc_id long, text string, lang_pred int")
    out = sorted((r.doc_id or 0, r.lang_pred) for r in L.predict(df, m).collect())
    assert out == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "fr"), (4, "fr"), (5, "en")]
    assert L.predict(df.limit(0), m).count() == 0
    none = L.train(df.limit(0).selectExpr("text", "text as lang"))
    assert none.langs == [] and {r.lang_pred for r in L.predict(df, none).collect()} == {"und"}


def test_workers_load_no_pandas():
    """The module that a worker loads with the model needs numpy and Arrow only."""
    code = "import sys, judgelake.llm.langid as L; assert 'pandas' not in sys.modules; assert L._TEXTS <= 256 and L._CACHE <= 20_000"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2])


def test_slices_of_a_batch_keep_rows_and_order(spark):
    rows = [(k, None if k % 5 == 0 else ("the cat", "le chat")[k % 2]) for k in range(3 * L._TEXTS + 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    model = L.train(spark.createDataFrame([("the cat the cat", "en"), ("le chat le chat", "fr")], "text string, lang string"))
    got = [(r.doc_id, r.lang_pred) for r in L.predict(docs, model).collect()]
    assert got == [(k, "und" if t is None else ("en", "fr")[k % 2]) for k, t in rows]
