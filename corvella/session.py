"""Session defaults the engine is designed for: AQE on, UTC, pruned scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "corvella", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword settings (dots as `__`) win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows and bytes of an Arrow batch between the JVM and Python, so that a batch of long texts stays small; a single longer row is a batch.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
#: Rows of a batch that Parquet columns are read in: all texts of a batch lie in one array, which grows by doubling.
READ_ROWS = 512


def bounded(df: DataFrame) -> DataFrame:
    """Lowers the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES, and Parquet's to READ_ROWS; lower settings stay. Results don't depend on it."""
    conf = df.sparkSession.conf
    for key, most in (("execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("parquet.columnarReaderBatchSize", READ_ROWS)):
        key = f"spark.sql.{key}"
        now = conf.get(key).lower().removesuffix("b")
        now = int(now) if now.lstrip("-").isdigit() else int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]]
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df
