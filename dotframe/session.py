"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("dotframe")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, read from the
    session. Only where that is unset and the master is this machine does a
    local temporary folder take its place."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    sc = spark.sparkContext
    own = sc.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = f"file://{tempfile.mkdtemp(prefix='dotframe-')}"
    sc.setCheckpointDir(at)
    return sc.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df``, written once to the shared folder and read back.

    Cuts the lineage with a compressed columnar table, so a lost executor
    costs a reread and not a recomputation. The table goes when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return spark.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by the keys over all shuffle partitions. For stages of
    Python code, whose small inputs would else be put into one partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def _close() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark.stop()
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass


atexit.register(_close)
