"""Byte-level BPE encoding and decoding with a local rank file (tiktoken)."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters after which a long text is cut at the next safe boundary.
CHUNK_CHARS = 1 << 16
#: A space or line feed after a word character: every match of the split pattern ends
#: before it, in the whole text as in the part, so parts encode to the same ids.
_SAFE = re.compile(r"(?<=\w)[ \n]")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, built once in each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = CHUNK_CHARS):
    """``text`` in parts of about ``size`` characters, cut where no match can cross."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc, text: str | None) -> np.ndarray:
    """The ids of a whole text; none for null. A lone surrogate counts as U+FFFD."""
    if not text:
        return np.empty(0, np.int32)
    if len(text) <= CHUNK_CHARS:
        return np.asarray(enc.encode_ordinary(text), np.int32)
    return np.concatenate([np.asarray(enc.encode_ordinary(p), np.int32) for p in parts(text)])


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``keep`` and ``ids`` (array of int), one row per input row; with ``decoded`` also the
    bytes that the ids stand for.

    Null and empty texts give an empty array. Repeated rows stay repeated rows. Columns
    other than ``text`` and ``keep`` are not read, whatever their names. ``rank_file`` must
    be at the same place on every executor. Rows go through in Arrow batches; nothing is
    shuffled, and a lost task is run again from the scan.
    """
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType()))]
                          + ([T.StructField(decoded, T.BinaryType())] if decoded else []))

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                found = [encode_text(enc, t) for t in rows.column(len(keep)).to_pylist()]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.concatenate(found) if found else np.empty(0, np.int32)
                cols = [rows.column(i) for i in range(len(keep))] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    cols.append(pa.array([enc.decode_bytes(f.tolist()) for f in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",),
           decoded: str = "decoded") -> DataFrame:
    """``keep`` and the bytes of ``ids``; null ids give no bytes. An id outside the rank
    file fails the task with a KeyError that names it."""
    schema = T.StructType([tokens.schema[k] for k in keep] + [T.StructField(decoded, T.BinaryType())])

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(x or []) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(raw, pa.binary())], names=schema.names)

    return tokens.select(*keep, ids).mapInArrow(run, schema)
