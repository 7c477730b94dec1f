"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str, master: str = "local[8]", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the Python line of every column call slows plan building.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


#: Longest generated method, in bytes of code, that the JVM compiles; longer ones stay interpreted.
COMPILED_BYTES = 8000


def compiled_methods(spark: SparkSession) -> None:
    """Has a stage run operator by operator where its one method would be too long to be compiled.

    For plans of very many expressions, as the cell parsers are.  A session that
    sets the limit itself keeps its own.
    """
    name, default = "spark.sql.codegen.hugeMethodLimit", "65535"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(COMPILED_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Where it is unset, as in tests, a session in one JVM gets a folder of its
    own; a cluster has to name one, as a machine's folder is lost with it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="sumstead-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark removes the shuffle files of a job when it ends, not when the driver's memory is next cleaned up.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame, written once to the shared folder as Parquet and read back.

    For frames that several branches of one plan use; survives lost executors,
    and later readers still get pruning and statistics.  What was shuffled to
    write it is removed from the disks at once, as nothing reads it again; so
    steps that are stored one after another need the disk of the largest only.
    """
    path, conf = new_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(RELEASE, "false")
    conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(RELEASE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
