import base64
import hashlib
import time

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from judgelake.llm import bpe
from judgelake.llm.queries_bpe import RANK_FILE, digests

LONG = "word  　 don't " * 9000 + "x" * 70_000 + "\n\n  end 12  3 " * 9000


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK_FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_as_library_and_exact_round_trip(spark, enc):
    rows = [(1, "Hé, ça va? 12 ſ​"), (2, None), (3, ""), (4, LONG), (4, LONG), (5, "<|endoftext|>'s \t\n "), (None, "a"),
            (6, "\x1c \x1f\x85   end"), (7, "   \n" * 400)]
    df = spark.createDataFrame([(a, b, "k") for a, b in rows], "doc_id long, text string, ids string")
    out = digests(bpe.encode(df, RANK_FILE, P.PATTERN, decoded="decoded")).collect()
    want = []
    for k, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


def test_decode_alone_and_empty_table(spark):
    df = spark.createDataFrame([(1, "añb"), (2, None)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(df, RANK_FILE, P.PATTERN), RANK_FILE, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {1: "añb", 2: ""}
    assert bpe.encode(df.filter(F.lit(False)), RANK_FILE, P.PATTERN).count() == 0


def test_parts_cover_the_text_and_long_words_end():
    assert "".join(bpe.parts(LONG, 1000)) == LONG and max(map(len, bpe.parts("ab " * 9999, 1000))) < 1010
    t = time.time()
    assert len(bpe.encode_text(bpe.encoding(RANK_FILE, P.PATTERN), "q" * 200_000)) > 0
    assert time.time() - t < 30
