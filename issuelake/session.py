"""Sessions, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "issuelake", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_code(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, wherever they are started."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory; pruning and pushdown are left to the optimizer."""
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of the session.

    A cluster names a shared folder in spark.checkpoint.dir and that one is used.
    Only where the setting is absent (tests, a laptop) a temporary folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="issuelake-checkpoint-")
    sc.setCheckpointDir(configured)
    drop_at_exit(spark, sc.getCheckpointDir() or configured)
    return configured


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete `path` when the driver ends: what is written there serves this session's queries alone."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder once; later reads survive the loss of an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes below which a core's share of a table counts as small.
SMALL_SHARE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """`df`, over all cores where it is read from fewer files than there are cores and is small.

    A small file is one row group and so one task, whatever its splits. Heavy
    work on its rows is then dealt out first, at the price of moving a few
    megabytes. Tables of more files, or of more bytes, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * SMALL_SHARE or not 0 < len(df.inputFiles()) < cores:
        return df
    return df.repartition(cores)


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as a columnar table in the shared checkpoint folder and read it back.

    Like cut_lineage, but later reads take only the columns they need. The
    table is deleted when the driver ends.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
