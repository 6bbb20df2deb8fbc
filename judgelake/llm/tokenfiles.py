"""Token counts of flat, unindexed token files, found by a scan for the separator.

A file is nothing but token ids of fixed width, each document ended by one separator id.
Blocks of tokens are searched by numpy; a prefix scan over the blocks of a file then gives
each document that begins in one block and ends in a later one its start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from judgelake.llm.bpe import encode_text, encoding

#: Big-endian 16-bit ids. The separator is above all ids of a 50k vocabulary, and its two
#: bytes are the UTF-8 form of one character, so Spark's text writer can put it.
WIDTH, SEPARATOR = ">u2", 0xC480
BLOCK_TOKENS = 1 << 20


def write(docs: DataFrame, path: str, rank_file: str, pattern: str, text: str = "text") -> None:
    """Token files of all rows in the order of the scan: ids, then the separator, and so on.

    Null and empty texts are documents of no tokens. The files come from Spark's text
    writer, so they are committed whole and may lie in any store. A vocabulary of more
    than ``SEPARATOR`` ids does not fit this width.
    """
    def run(batches):
        enc = encoding(rank_file, pattern)
        assert enc.n_vocab <= SEPARATOR
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [encode_text(enc, t).astype(WIDTH).tobytes() for t in batch.slice(at, 256).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    raw = docs.select(text).mapInArrow(run, "ids binary")
    raw.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", bytes([SEPARATOR >> 8, SEPARATOR & 255]).decode()).text(path)


def scan(spark: SparkSession, path: str, width: str = WIDTH, separator: int = SEPARATOR, block: int = BLOCK_TOKENS) -> DataFrame:
    """file, doc_index, start, n_tokens, closed: every document of every file below ``path``.

    ``start`` is the offset in tokens in the file; separators belong to no document. Tokens
    after a file's last separator are a document that is not ``closed``; nothing after it
    is none. An empty file has no documents. Each file is searched by one task, in blocks;
    files above Spark's limit for binary files fail with its message. A length that is no
    multiple of the width fails too.
    """
    wide = np.dtype(width).itemsize

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.frombuffer(content.as_buffer(), width)
                names, ids, firsts, sizes, ends = [], [], [], [], []
                for k, at in enumerate(range(0, len(tokens), block)):
                    part = tokens[at:at + block]
                    names.append(name)
                    ids.append(k)
                    firsts.append(at)
                    sizes.append(len(part))
                    ends.append(at + np.flatnonzero(part == separator))
                if names:
                    offsets = np.cumsum([0, *map(len, ends)], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names), pa.array(ids, pa.int32()), pa.array(firsts, pa.int64()), pa.array(sizes, pa.int64()),
                         pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ends).astype(np.int64)))], names=["file", "block", "first", "size", "ends"])

    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    files = files.withColumn("content", F.when(F.col("length") % wide != 0, F.raise_error(F.concat(F.lit("not whole tokens: "), "path"))).otherwise(F.col("content")))
    blocks = files.select("path", "content").mapInArrow(run, "file string, block int, first long, size long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_end = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    scanned = blocks.select("*", F.coalesce(F.last(last_end, ignorenulls=True).over(before) + 1, F.lit(0)).alias("open"),
                            F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("index"),
                            F.max("block").over(Window.partitionBy("file")).alias("top"))
    # the end of a file closes nothing, but ends what is still open
    stop = F.col("first") + F.col("size")
    left = (F.col("block") == F.col("top")) & (F.coalesce(last_end + 1, "open") < stop)
    marks = F.transform("ends", lambda e: F.struct(e.alias("at"), F.lit(True).alias("closed")))
    marks = F.concat(marks, F.when(left, F.array(F.struct(stop.alias("at"), F.lit(False).alias("closed")))).otherwise(F.slice(marks, 1, 0)))
    rows = scanned.select("file", "index", "open", "ends", F.posexplode(marks).alias("i", "mark"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.get("ends", F.col("i") - 1) + 1)
    return rows.select("file", (F.col("index") + F.col("i")).alias("doc_index"), start.alias("start"), (F.col("mark.at") - start).alias("n_tokens"), F.col("mark.closed").alias("closed"))
