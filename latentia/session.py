"""Session settings that the operators expect."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "latentia", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (CONF | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package wherever the driver was started.

    On a cluster the package travels as usual (``--py-files``).
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder (``spark.checkpoint.dir``).

    Only a local master, whose one process is driver and executor, gets a temporary folder where none is set; on a
    cluster that is an error, since other machines could not see it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there; lost executors cost nothing that is stored."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
