"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_spark(app_name: str = "docloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for; extra ``conf`` wins."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Long documents: keep one Arrow batch well below an executor's Python memory.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: a subfolder of ``spark.checkpoint.dir`` per application.

    Where the setting is absent, a local master gets a temporary folder; a cluster must name a
    shared one, as a machine-local folder would not survive the loss of an executor.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="docloom-checkpoints-")
        spark.conf.set(_CHECKPOINT_KEY, root)
    return f"{root.rstrip('/')}/docloom-{spark.conf.get('spark.app.id', 'session')}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the scratch folder that nothing else uses."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    Cuts the lineage and fixes row contents for every later pass; the copy outlives executors. ``by`` names a
    column with few values whose rows later passes read one value at a time.
    """
    path = path or scratch_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    if not path.startswith(scratch_root(spark) + "/"):
        raise ValueError(f"not a scratch table of this application: {path}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this application wrote to its scratch folder.

    Call it when no DataFrame made by this library is needed any more: many of them read from there.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
