"""Session, table and stage helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "quakeloom", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; reads nothing until an action."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent and the session is local is a folder of this
    machine taken instead; a cluster without the setting is an error, since a
    machine-local folder would not be seen by the other executors. Whether a folder that
    is set is shared cannot be told from its name (a mounted file system is a file: path
    too): what the cluster names is taken as it is.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_STAGES: set[str] = set()


def new_stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's own folder in the shared one; that folder is deleted when the driver ends."""
    parent = f"{shared_dir(spark)}/stages-{spark.sparkContext.applicationId}"
    if parent not in _STAGES:
        folder = spark._jvm.org.apache.hadoop.fs.Path(parent)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _STAGES.add(parent)
    return f"{parent}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder; for steps of a loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
