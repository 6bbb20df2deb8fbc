import hashlib
import random

import pytest

import corpus_pipeline as C
from test_decontaminate import brute as windows
from test_jaccard import brute as classes
from test_jaccard import corpus


@pytest.fixture()
def folder(spark, tmp_path):
    docs = corpus(random.Random(9), 160)
    shared = " ".join(f"bench{i}" for i in range(12))
    docs += [(300, None), (301, "12 34"), (302, f"some words {shared} more"), (303, "Say " + docs[4][1]), docs[2], (None, "no id here"), (None, "no id here"), (305, "x y one"), (305, "other text of one id"), (304, "")]
    rows = [(k, t, "en" if (k or 0) % 2 else "fr", "s", len(t or "")) for k, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, shared), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), docs, shared


def test_each_stage_against_brute_force(spark, folder):
    path, docs, shared = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    kept = sorted(((r.doc_id, r.text) for r in C.language(spark, table, path).collect()), key=repr)
    assert kept == sorted(((k, t) for k, t in docs if any(c.isalpha() for c in t or "")), key=repr)
    left = C.near_duplicates(spark, C.language(spark, table, path), path)
    assert left.columns == list(C.COLUMNS)
    roots = {k for k, _, root in classes(kept) if k == root and k is not None}
    first = {}
    for k, t in sorted((r for r in kept if r[0] is not None)):
        first.setdefault(k, t)
    want = sorted([(k, first[k]) for k in roots] + [r for r in kept if r[0] is None], key=repr)
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert got == want
    pure = sorted((r for r, hit in zip(want, [w[2] for w in windows(want, [(1, shared)])]) if not hit), key=repr)
    assert 0 < len(pure) < len(want)
    out = C.run(spark, path).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r.doc_id, r.decoded_sha256) for r in out), key=repr) == sorted(((k, sha(t)) for k, t in pure), key=repr)


def test_empty_table(spark, folder, tmp_path):
    empty = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, folder[0]).count() == 0
