"""Session defaults and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "tandemtape") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; one is made only for a local master where none is set, as in tests.

    On a cluster a folder of the driver's machine would be empty to the other machines, and a later read would find no rows, so a
    missing setting is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not is_local(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


#: Folders of the tables that cut() wrote and release() has not removed.
CUTS: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read to the shared folder and read it back.

    Its lineage ends at files every executor can reach, so a lost executor costs no recomputation, and later scans still
    prune columns.  Runs at once.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(root)
    CUTS.append(root)
    table = spark.read.schema(df.schema).parquet(root)
    table._cut_root = root
    return table


def release(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Remove cut tables, given as frames or folders, once everything that reads them has run."""
    for table in tables:
        root = table if isinstance(table, str) else table._cut_root
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if root in CUTS:
            CUTS.remove(root)
