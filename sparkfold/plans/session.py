"""Session defaults for pair workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "sparkfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive planning, UTC and small Arrow batches; conf values override these."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    own = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=own | conf).getOrCreate()


def once(df: DataFrame) -> DataFrame:
    """Computes df and reads it back from the shared checkpoint folder: for a dear table that a plan uses more than once.

    The folder is the session's spark.checkpoint.dir or, where it names none, one of the warehouse.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()
