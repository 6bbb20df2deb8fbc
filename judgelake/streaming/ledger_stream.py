"""Incremental jobs over the append-only ledger.

Each micro-batch is reduced first (last record per label; per class the counts and the last
outcomes) and written to a folder of the store, ``delta-<batch>``. When ``FOLDERS`` of them
have gathered, they are merged with the base into ``base-<batch>``, which stands for all
batches up to that one. So the store holds one row per key and a bounded number of reduced
batches, however long the stream runs, and a hot label or class costs a few rows a batch.

A folder counts once Spark has marked it as written. A replayed batch rewrites its delta, or
is skipped if a base holds it, so a failure never counts a record twice. A merge keeps the
folders of the one before for readers that are at them. A store belongs to one checkpoint.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from judgelake import constants as K
from judgelake.sources.ledger import latest_by_label

#: Reduced batches that gather before they are merged.
FOLDERS = 16
#: What tells records of one label apart: time, file, split of the file, record in the split.
ORDER = ("ts", "source_file", "source_pos", "position")


def _folders(spark: SparkSession, store: str) -> dict[tuple[int, str], str]:
    """(batch, kind) -> path of the finished folders of a store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in fs.listStatus(path) if fs.exists(path) else []:
        name = status.getPath().getName()
        if (m := re.fullmatch(r"(base|delta)-(\d+)", name)) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[int(m[2]), m[1]] = f"{store}/{name}"
    return found


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _live(folders: dict[tuple[int, str], str]) -> tuple[int, list[str]]:
    """The batch of the last base (-1 without one) and the folders that hold the state."""
    base = max((n for n, kind in folders if kind == "base"), default=-1)
    return base, [p for (n, kind), p in sorted(folders.items()) if (n, kind) == (base, "base") or (kind == "delta" and n > base)]


def _start(stream: DataFrame, store: str, checkpoint: str, reduce: Callable, merge: Callable, folders: int) -> StreamingQuery:
    """Runs over what is there, then stops; ``merge`` takes rows of several folders to one row per key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _live(_folders(spark, store))[0] >= batch_id:
            return
        reduce(batch).write.mode("overwrite").parquet(f"{store}/delta-{batch_id}")
        there = _folders(spark, store)
        base, live = _live(there)
        if sum(kind == "delta" and n > base for n, kind in there) >= folders:
            merge(spark.read.parquet(*live)).write.mode("overwrite").parquet(f"{store}/base-{batch_id}")
            for (n, kind), path in there.items():
                if n < base or (n, kind) == (base, "delta"):
                    _delete(spark, path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ledger_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Appended JSON records with the file and position that break ties."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path).withColumn("source_file", F.col("_metadata.file_path")).withColumn(
        "source_pos", F.col("_metadata.file_block_start"))


def start_latest(stream: DataFrame, store: str, checkpoint: str, order: tuple[str, ...] = ORDER, folders: int = FOLDERS) -> StreamingQuery:
    """Keep the last record of every label; runs over what is there, then stops.

    Records are numbered as they are read, so of two records of a label with equal ``ts`` in
    one file the later one is the last. ``stream`` must be as read, without a shuffle.
    """
    def reduce(batch: DataFrame) -> DataFrame:
        return latest_by_label(batch.withColumn("position", F.monotonically_increasing_id()), order)

    return _start(stream, store, checkpoint, reduce, lambda rows: latest_by_label(rows, order), folders)


def latest(spark: SparkSession, store: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The current record of every label."""
    return latest_by_label(spark.read.parquet(*_live(_folders(spark, store))[1]), order)


def _merged(rows: DataFrame, window: int) -> DataFrame:
    """One row per class from rows of several folders, ``last`` newest first."""
    last = F.slice(F.sort_array(F.flatten(F.collect_list("last")), asc=False), 1, window)
    return rows.groupBy("class").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), last.alias("last"))


def start_class_state(outcomes: DataFrame, store: str, checkpoint: str, window: int = K.RETIRE_WINDOW, folders: int = FOLDERS) -> StreamingQuery:
    """Per class: the counts of all outcomes and the last ``window`` of them by (ts, id).

    ``outcomes``: class, ts, id, sustained.
    """
    def reduce(batch: DataFrame) -> DataFrame:
        counts = batch.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if("sustained").alias("s"))
        ranked = batch.selectExpr("class", "struct(ts, id, sustained) AS o", "row_number() OVER (PARTITION BY class ORDER BY ts DESC, id DESC, sustained DESC) AS r")
        last = ranked.filter(F.col("r") <= window).groupBy("class").agg(F.sort_array(F.collect_list("o"), asc=False).alias("last"))
        same = counts["class"].eqNullSafe(last["class"])
        return counts.join(last, same).select(counts["class"], "n", "s", "last")

    return _start(outcomes, store, checkpoint, reduce, lambda rows: _merged(rows, window), folders)


def class_state(spark: SparkSession, store: str, window: int = K.RETIRE_WINDOW) -> DataFrame:
    """The same status rows as the batch rule over all outcomes so far."""
    state = _merged(spark.read.parquet(*_live(_folders(spark, store))[1]), window)
    recent = F.size(F.filter("last", lambda o: o["sustained"])) / F.col("n_last")
    state = state.select("class", F.col("n").alias("n_adjudicated"), F.col("s").alias("n_sustained"), F.size("last").cast("bigint").alias("n_last"), "last")
    return state.withColumn("recent_rate", recent).withColumn("rate", F.col("n_sustained") / F.col("n_adjudicated")).withColumn(
        "status", F.when((F.col("n_last") >= window) & (F.col("recent_rate") < K.RETIRE_RATE), "retire")
        .when((F.col("n_adjudicated") >= K.SHIP_MIN) & (F.col("rate") >= K.SHIP_RATE), "ship").otherwise("hold")).drop("last")
