"""Settings and sessions."""

from __future__ import annotations

import os
import shutil
import tempfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """From the environment; what is required and missing is named at once."""

    data_dir: str
    master: str | None = None
    shuffle_partitions: int | None = None

    @classmethod
    def load(cls, env=os.environ) -> Settings:
        if not env.get("QUILLSTRATA_DATA"):
            raise KeyError("QUILLSTRATA_DATA: the folder of the tables")
        parts = env.get("QUILLSTRATA_SHUFFLE_PARTITIONS")
        return cls(env["QUILLSTRATA_DATA"], env.get("QUILLSTRATA_MASTER"), int(parts) if parts else None)


def session(name: str = "quillstrata", master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster everything else comes from spark-submit."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    if shuffle_partitions:
        own["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (own | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder: the cluster's spark.checkpoint.dir; where that is unset and all runs on one machine, a temporary one. On a cluster without the setting it is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir: a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillstrata-checkpoint-"))


def ship(spark: SparkSession | None = None) -> None:
    """Sends this package to the executors through Spark's file server, once for each application, so that Python functions find it there."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_quillstrata_sent", False):
        return
    package = Path(__file__).resolve().parent
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='quillstrata-')}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(made)
    spark.sparkContext._quillstrata_sent = True
