"""Scalar rules with literal cases."""

from pyspark.sql import functions as F

from judgelake.functions import paths as P
from judgelake.functions import scores as S
from judgelake.functions import texts as X

TEST_PATHS = ["__tests__/gate.test.tsx", "tests/unit/a.ts", "src/test/Foo.java", "pkg/__mocks__/fs.js", "spec/user.rb", "web/e2e/login.ts", "specs/user.rb",
              "src/foo.test.ts", "src/foo.spec.js", "pkg/test_utils.py", "pkg/foo_test.go", "conftest.py", "pkg/conftest.py", "SRC\\Tests\\Foo.TS", "Src/TESTS/foo.ts"]
CODE_PATHS = ["src/index.ts", "src/testing/clock.ts", "packages/test-utils/src/index.ts", "src/fixtures/seed.ts", "src/contest.py", "src/latest.ts", "src/test", "", None]


def values(spark, rows, expr, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in rows], schema).select(expr(F.col("v"))).collect()]


def test_reflex_class(spark):
    assert values(spark, TEST_PATHS, P.reflex_class) == ["test"] * len(TEST_PATHS)
    assert values(spark, CODE_PATHS, P.reflex_class) == ["code"] * len(CODE_PATHS)


def test_path_triage(spark):
    doc = ["package-lock.json", "a/go.sum", "README.MD", "docs/x.rst", "node_modules/x.js", "a/dist/b.py", "CHANGELOG-2", ".gitignore", "x/.min.js/y"]
    assert values(spark, doc, P.path_triage_reason) == ["docs/generated/lockfile"] * len(doc)
    assert values(spark, ["m.JSONL", "a/t.snap"], P.path_triage_reason) == ["data/snapshot"] * 2
    assert values(spark, ["app.min.js", "a/CHANGELOG", "package.json", "a/distribution.py"], P.path_triage_reason) == [None] * 4


def test_severity_levels_and_near(spark):
    assert values(spark, [None, -1.0, 0.49, 0.5, 1.49, 1.5, 2.5, 9.0], S.sev_level, "v double") == [0, 0, 0, 1, 1, 2, 3, 3]
    # inclusive on doubles: 0.53 - 0.50 is a little more than 0.03
    assert values(spark, [None, 0.53, 0.47, 0.52, 0.5], lambda v: S.near(v, F.lit(0.5)), "v double") == [False, False, False, True, True]


def test_extension_and_ranges(spark):
    assert values(spark, ["a/b.PY", ".gitignore", "x.tar.gz", "a.b/c"], P.extension) == ["py", "", "gz", ""]
    assert values(spark, ["main..", "..x", "a..b", "a...b", "abc", "a..b..c"], P.triple_dot) == ["main...HEAD", "HEAD...x", "a...b", "a...b", "abc", "a..b..c"]


def test_declared_names(spark):
    src = ["def alpha(x):", "  from .utils import beta as b, gamma", "import os.path", "let i = 0", "from . import delta", "import React from 'react'"]
    got = spark.createDataFrame([(src,)], "v array<string>").select(F.array_sort(X.declared_names(F.col("v")))).first()[0]
    assert got == ["alpha", "beta", "delta", "gamma", "os", "utils"]


def test_references_remaining(spark):
    rows = [("deletion-only", ["def run():"], ["run()"]), ("deletion-only", ["def run():"], ["rerun()"]), ("whole-file-deleted", ["def run():"], []), ("code-change", ["def run():"], ["run()"])]
    got = spark.createDataFrame(rows, "c string, r array<string>, s array<string>").select(X.references_remaining(F.col("c"), F.col("r"), F.col("s"))).collect()
    assert [r[0] for r in got] == [True, False, False, None]


def test_labels_and_lines(spark):
    assert values(spark, ["a\nb\n", "a b", "", "a\n\nb"], X.split_lines) == [["a", "b"], ["a b"], [], ["a", "", "b"]]
    assert values(spark, ["corpus:v08:o/r#1@pre:r12"], X.parse_label)[0].asDict() == {"kind": "corpus", "group": "v08", "sample": "o/r#1@pre", "repeat": 12}
    assert values(spark, ["## /fix-pr follow-up\n- **Fixed** a.py\n- **Later** b.py\n - **Fixed** c.py"], X.follow_up_bullets)[0][0].status == "fixed"
