"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Settings the plans rely on. AQE picks broadcast joins from measured sizes,
#: splits hot join partitions and merges small ones; the initial partition
#: number is only an upper bound for it.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "skuweave", master: str | None = None,
                  conf: dict[str, str] | None = None,
                  input_bytes: int | None = None) -> SparkSession:
    """Make (or get) a session. `master` is for tests; spark-submit sets it otherwise.

    `input_bytes` is what the job reads, about: shuffles then start with a number of
    partitions that fits it. It changes partitioning only, never a result.
    """
    if input_bytes is not None:
        number = initial_shuffle_partitions(input_bytes)
        conf = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(number),
                **(conf or {})}
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def initial_shuffle_partitions(shuffle_bytes: int, target_bytes: int = 128 << 20,
                               total_cores: int = 8) -> int:
    """Partition number that keeps one shuffle partition near `target_bytes`.

    Give it to `spark.sql.adaptive.coalescePartitions.initialPartitionNum`: AQE
    merges partitions that turn out small, but cannot undo ones that are too big.
    """
    return max(total_cores, -(-shuffle_bytes // target_bytes))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in `spark.checkpoint.dir`; without one, a folder of the warehouse.

    A warehouse on the driver's own disk serves local sessions only: on a cluster the executors
    would write to their disks, and later reads would miss those files. That is an error here.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    on_disk = warehouse.startswith(("file:", "/")) or "://" not in warehouse
    if on_disk and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/scratch"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure `DataFrame.checkpoint` and the tree learners have a folder to write to."""
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table below the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


#: About the size in memory of the rows of one file of a staged table.
FILE_BYTES = 34 << 20


def rows_per_file(schema: T.StructType) -> int:
    """How many rows of this schema take `FILE_BYTES` as objects.

    Tasks are cut by bytes on disk. Repeated vectors and small numbers take next to none there, so
    the rows of a few files could be many GB in the task that reads them. A scan counts every file
    as `spark.sql.files.openCostInBytes` at least, so files of a bounded number of rows bound the
    rows of a task, whatever they take on disk.
    """
    def width(field: T.StructField) -> int:
        if isinstance(field.dataType, VectorUDT):
            size = int(field.metadata.get("ml_attr", {}).get("num_attrs", 64))
            return max(8 * size + 64, 512)  # the least that learners keep for a row
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return 512
        return 40 if isinstance(field.dataType, (T.StringType, T.BinaryType)) else 16

    return max(1, FILE_BYTES // (sum(map(width, schema.fields)) + 1))


def write_staged(df: DataFrame, path: str) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file(df.schema)).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    For a table that several branches of a plan need: it is computed once, later
    joins know its size, and a lost executor does not send the job back to the
    raw data.
    """
    path = scratch_path(df.sparkSession, name)
    write_staged(df, path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Intermediate tables of one job, removed when it ends: `with Scratch(spark) as scratch:`.

    For fits, whose result is a model: no lazy DataFrame over the tables may leave the block.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` to the shared folder and read it back with its column metadata."""
        path = scratch_path(self.spark, name)
        write_staged(df, path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_last(self, n: int = 1) -> None:
        """Remove all tables but the last `n`."""
        for path in self.paths[:-n]:
            self._remove(path)
        self.paths = self.paths[-n:]

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *error) -> None:
        for path in self.paths:
            self._remove(path)
        self.paths = []


@contextmanager
def staged_for(df: DataFrame) -> Iterator[DataFrame]:
    """`df` written to the shared folder for one block of code.

    A checkpoint: Spark removes its files after the DataFrame is gone
    (`spark.cleaner.referenceTracking.cleanCheckpoints`).
    """
    ensure_checkpoint_dir(df.sparkSession)
    yield df.checkpoint()
