import numpy as np
import public_tokenizers as P
import pytest

from judgelake.llm import tokenfiles as F
from judgelake.llm.bpe import encode_text, encoding
from judgelake.llm.queries_bpe import RANK_FILE


def brute(tokens, sep):
    docs, start = [], 0
    for i, t in enumerate(tokens):
        if t == sep:
            docs.append((len(docs), start, i - start, True))
            start = i + 1
    return docs + ([(len(docs), start, len(tokens) - start, False)] if start < len(tokens) else [])


@pytest.mark.parametrize("width,sep,block", [(">u2", 7, 5), ("<u4", 9, 1), ("<u2", 0, 1000)])
def test_scan_against_plain_loop(spark, tmp_path, width, sep, block):
    rng, want = np.random.default_rng(3), {}
    for k in range(6):
        tokens = rng.integers(0, 12, size=[0, 1, 40, 41, 200, 3][k]) if k != 5 else np.full(3, sep)
        tokens.astype(width).tofile(tmp_path / f"f{k}.bin")
        want[f"f{k}.bin"] = brute(tokens.tolist(), sep)
    out = F.scan(spark, str(tmp_path), width, sep, block).collect()
    got = {k: sorted(tuple(r)[1:] for r in out if r.file.endswith(k)) for k in want}
    assert got == want


def test_round_trip_of_documents(spark, tmp_path):
    texts = ["a b c", None, "", "Ā Ā", "long text " * 30_000, "a b c"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, file int").coalesce(1)
    F.write(df, str(tmp_path / "t"), RANK_FILE, P.PATTERN)
    out = sorted(F.scan(spark, str(tmp_path / "t"), block=1000).collect(), key=lambda r: r.doc_index)
    assert [r.n_tokens for r in out] == [len(encode_text(encoding(RANK_FILE, P.PATTERN), t)) for t in texts] and all(r.closed for r in out)
    F.write(df.limit(0), str(tmp_path / "e"), RANK_FILE, P.PATTERN)
    assert F.scan(spark, str(tmp_path / "e")).count() == 0


def test_broken_length_fails(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="not whole tokens"):
        F.scan(spark, str(tmp_path)).collect()
