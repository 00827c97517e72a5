"""Session helpers: reading tables and cutting lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "threadmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; cluster settings win over these."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def show_package(spark: SparkSession) -> None:
    """Lets Python workers import this package where only the driver's own path has it."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    show_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the folder that spark.checkpoint.dir names.

    Only where neither the setting nor a folder is set, and Spark runs in one process (tests, a laptop), is a local folder
    chosen; a cluster without the setting is an error. Checkpoints that nothing refers to any more are removed where
    spark.cleaner.referenceTracking.cleanCheckpoints is set, as build_session does.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors reach")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="threadmill-"))
    return df.checkpoint(eager=True)
