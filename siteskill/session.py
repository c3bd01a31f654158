"""Session helpers and the one way this library cuts a long plan: a written table."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Names the shared folder where `spark.checkpoint.dir`, which a running session can't change, is unset.
SHARED_DIR = "siteskill.shared.dir"


def local_session(
    cores: int | str = "*", app: str = "siteskill", memory: str = "8g", settings: Mapping[str, str] | None = None
) -> SparkSession:
    """A session for tests and the bench. On a cluster, pass your own session to every function."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def has_shared_dir(spark: SparkSession) -> bool:
    return bool(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED_DIR, None))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, else `siteskill.shared.dir`. No fallback."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED_DIR, None)
    if not path:
        raise RuntimeError(f"set spark.checkpoint.dir (or {SHARED_DIR}) to a folder all executors share")
    return path.rstrip("/")


class Staging:
    """Owns the tables staged while it is open: `close` (or the end of a `with`) removes them.

    Frames that still read a staged table must have been written or collected by then. Without an owner
    staged tables stay until the shared folder is cleaned.
    """

    _open: list[Staging] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/siteskill-{uuid.uuid4().hex}"

    def __enter__(self) -> Staging:
        Staging._open.append(self)
        return self

    def __exit__(self, *error: object) -> None:
        Staging._open.remove(self)
        self.close()

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where one derived table feeds several branches, where a value such as a partition number
    must stay the same for all readers even if an executor is lost, and between rounds of an
    iteration. Readers get column pruning, and the optimizer gets a real size, so it alone decides
    whether a staged table is small enough to broadcast.
    """
    spark = df.sparkSession
    root = Staging._open[-1].root if Staging._open else shared_dir(spark)
    path = f"{root}/siteskill-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
