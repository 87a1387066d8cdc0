"""Sessions, lineage cuts and helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "lociweave", **conf: str) -> SparkSession:
    """A session for tests and the command line; clusters bring their own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.memory": "8g",
        # Files behind cut() go when nothing refers to them any more; clusters should set it too.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, or a local one where that is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="lociweave-")
        sc.setCheckpointDir(named)
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder once and go on from the written rows; partitions and their order are kept."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def partitions_for(spark: SparkSession) -> int:
    """Shuffle width of the session; explicit range exchanges follow it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits_broadcast(df: DataFrame, most_rows: int = 100_000) -> bool:
    """Whether `df` has at most `most_rows` rows; reads no more than that many."""
    return df.limit(most_rows + 1).count() <= most_rows


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """`df` with a broadcast hint where a count has shown it to be small, else as it is (a shuffle join)."""
    return F.broadcast(df) if fits_broadcast(df, most_rows) else df
