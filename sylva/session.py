"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sylva", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    The session's ``spark.checkpoint.dir`` is used when set; only where it is
    unset (local tests) a temporary folder of this machine takes its place.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf)
        return conf
    have = sc.getCheckpointDir()
    if have is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = tempfile.mkdtemp(prefix="sylva-checkpoint-")
        sc.setCheckpointDir(have)
    return have


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
