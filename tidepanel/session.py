"""Session settings the library expects; a cluster's own settings win where it sets them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidepanel", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder so that lost executors cost no recomputation.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; where none is
    named the frame is returned as it is, because no other folder is known to be shared.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            return df
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """A small table that several later steps read: checkpointed where a shared folder is named, else persisted when first read."""
    out = cut_lineage(df)
    return df.persist() if out is df else out
