import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from judgelake.llm import licenses as L
from judgelake.llm.queries_licenses import TEMPLATES, laid_out, op9_licenses


def bag(text):
    return Counter(w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w)


def cosine(unit, df, n):
    bags = {k: bag(t) for k, t in TEMPLATES.items()}
    known = {w for b in bags.values() for w in b}
    idf = lambda w: math.log((1 + n) / (1 + (df[w] if w in known else 0))) + 1
    vec = lambda b: {w: c * idf(w) for w, c in b.items()}
    u, best = vec(bag(unit)), (0.0, None)
    for k in sorted(bags):
        v = vec(bags[k])
        s = sum(x * v.get(w, 0) for w, x in u.items()) / (math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values())) or 1)
        best = max(best, (round(s, 9), k), key=lambda x: x[0])
    return best


def brute(rows):
    own, by_dir = [], {}
    df = Counter(w for _, t in rows for w in bag(t))
    for path, text in rows:
        name = (path or "").rpartition("/")[2].split(".")[0].lower()
        is_file = path is not None and name in L.FILE_NAMES
        units = re.split("\r\n|[\n\r]", text or "") + ([text or ""] if is_file else [])
        s, k = max((cosine(u, df, len(rows)) for u in units), key=lambda x: x[0])
        own.append((k, s) if s >= L.THRESHOLD else (None, None))
        if is_file and own[-1][0]:
            d = path.rpartition("/")[0]
            by_dir[d] = min(by_dir.get(d, (0, "")), (-s, k))
    out = []
    for (path, _), (k, s) in zip(rows, own):
        lic, at = k, path
        while lic is None and at:
            at = at.rpartition("/")[0]
            lic = by_dir.get(at, (0, None))[1]
        out.append((path, k, lic))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    apache, mit = TEMPLATES["Apache-2.0"], TEMPLATES["MIT"]
    rows = [("a/LICENSE", apache + "\nmore text that is long enough to differ"), ("a/x.py", "code"), ("a/b/c/y.py", "code"), ("a/b/z.py", f"x\n# {mit}\ny"), ("a/b/COPYING.md", mit),
            ("LICENSE", TEMPLATES["GPL-3.0"]), ("top.py", None), ("q/w.py", ""), (None, mit), (None, "x"), ("ab/n.py", "mit is german"), ("a/x.py", "code"),
            ("a/long.py", "the version of the license " * 40_000), ("a/b/c/LICENSE", "nothing"), ("a/d/LICENSE", apache), ("a/d/COPYING", apache), ("a/d/e.py", "licensed under cc by 4.0")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "path string, text string, declared string")
    out = L.scan(df, TEMPLATES).collect()
    assert sorted(((r.path, r.declared, r.licence) for r in out), key=repr) == brute(rows)
    assert {r.path: r.origin for r in out if r.path in ("a/x.py", "a/b/c/y.py", "top.py", "a/b/z.py")} == {"a/x.py": "a", "a/b/c/y.py": "a/b", "top.py": "", "a/b/z.py": None}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.path, r.text) for r in laid_out(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    out = op9_licenses(spark, sf).collect()
    assert sorted(((r.path, r.declared, r.licence) for r in out), key=repr) == brute(rows) and any(r.declared for r in out)


def test_empty_table_and_no_templates(spark):
    df = spark.createDataFrame([("a/b", "MIT License")], "path string, text string")
    assert L.scan(df.limit(0), TEMPLATES).count() == 0 and L.scan(df, {}).first().licence is None


def plain(rows):
    """Best template and score of every file's lines, by idf of all words over all files."""
    df = Counter(w for t in rows for w in bag(t))
    vec = lambda b: {w: c * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, c in b.items()}
    norm, out = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1, []
    for t in rows:
        best = (-L.THRESHOLD, None)
        for line in re.split("\r\n|[\n\r]", t):
            u = vec(bag(line))
            for k, v in ((k, vec(bag(x))) for k, x in TEMPLATES.items()):
                best = min(best, (-round(sum(x * v.get(w, 0) for w, x in u.items()) / (norm(u) * norm(v)), 9), k), key=lambda x: (x[0], x[1] or ""))
        out.append(best)
    return out


@pytest.mark.parametrize("frequent", [0, 5, 20, 10_000])
def test_every_word_has_its_own_idf(spark, monkeypatch, frequent):
    monkeypatch.setattr(L, "BROADCAST_ROWS", frequent)
    rows = [f"this project is number {k} see the file for details" for k in range(300)]
    rows[7] = "This project is released under the MIT License.\nsee the file for details"
    rows[9] = "x\nSee the file: this is licensed under CC BY 4.0. For details, see the project"
    rows[11] = "this project is MIT"
    files = spark.createDataFrame([(f"p{k}", k, t, False) for k, t in enumerate(rows)], "path string, part int, text string, is_file boolean")
    want = {f"p{k}": b for k, b in enumerate(plain(rows)) if b[1]}
    got = {r.path: (-r.score, r.declared) for r in L.declared(files, TEMPLATES).collect()}
    assert got.keys() == want.keys() >= {"p7", "p9"}
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-8) for k in want)


def test_score_of_a_line_does_not_follow_the_size_of_the_table(spark):
    found = []
    for n in (200, 200_000):
        line = "This project is released under the MIT License."
        text = F.when(F.col("id") % 100 == 3, line).when(F.col("id") % 2 == 0, "this project is large, see the file").otherwise("under the roof")
        files = spark.range(n).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit(0).alias("part"), text.alias("text"), F.lit(False).alias("is_file"))
        out = L.declared(files, TEMPLATES)
        found.append(out.agg(F.count("*"), F.min("score"), F.max("score")).first())
        assert found[-1][0] == n // 100 and found[-1][1] == found[-1][2]
    assert abs(found[0][1] - found[1][1]) < 0.05
