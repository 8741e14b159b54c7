"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
RUN = f"sittings-{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", app: str = "sittings") -> SparkSession:
    """Session for tests and the benchmark; on a cluster the submitter's is used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sittings-"))
        .getOrCreate()
    )


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="sittings-")


def run_folder(spark: SparkSession) -> str:
    """This process's folder below the shared one that `spark.checkpoint.dir` names.

    A session of one machine that names none gets a temporary folder, which there every
    task can reach; a cluster session without the setting is refused. No setting of the
    session is changed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/{RUN}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the run folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a result that many later steps read, and read it back.

    The steps then neither repeat the work behind it nor lose it with an executor. The
    shuffle files behind it are dropped as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*settled: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in settled:
        _delete(df.sparkSession, df._scratch)


def drop_run(spark: SparkSession) -> None:
    """Delete every table this process has settled."""
    _delete(spark, run_folder(spark))
