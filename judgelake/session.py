"""Session defaults for local runs, and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that are shuffled at one time where a query works in slices.
SLICE_ROWS = 1 << 26
#: Spark's switch by which an action drops its own shuffle files when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "16g",
                  app: str = "judgelake") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Where it is unset, a local master (as in tests) gets a new folder of its machine; a
    cluster raises, as its executors would each write to their own disk.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not conf and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(conf or tempfile.mkdtemp(prefix="judgelake-"))
    return conf or spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise once into the shared checkpoint folder, surviving executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared checkpoint folder, packed by column, and read back.

    It survives the loss of an executor and takes a fraction of a checkpoint's room; later
    steps read the columns they need.  What was shuffled to make it goes at once.
    """
    return written_in_turn([df], name)


def written_in_turn(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """As ``written``, for the parts of a table: what one part shuffles is gone before the next begins."""
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or scratch_path(spark, name)
        before = spark.conf.get(DROP_SHUFFLES, None)
        spark.conf.set(DROP_SHUFFLES, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Drop the files of tables that ``written`` returned and that nothing reads any more."""
    for df in tables:
        path = vars(df).get("_written_at")
        if path is not None:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(rows: DataFrame) -> list[Callable[..., Column]]:
    """Conditions on key columns that deal a table by hash into slices of about ``SLICE_ROWS`` rows.

    The same condition on the other side's keys, of the same types, holds for all that can
    meet a slice.  Each row, with null keys too, is in one slice; a small table is one slice.
    """
    n = max(1, -(-rows.count() // SLICE_ROWS))
    return [partial(_in_slice, n, i) for i in range(n)]


def _in_slice(n: int, i: int, *keys: str) -> Column:
    return F.lit(True) if n == 1 else F.pmod(F.xxhash64(*keys), F.lit(n)) == i
