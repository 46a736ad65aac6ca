"""Tables written once to the shared folder and read from there by all later steps.

The folder is the one in spark.checkpoint.dir; only where that is unset (one machine,
tests) a temporary folder is made. A lost executor costs no recomputation of what was
written, and every reader sees the same rows.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from corvella.sources.files import Files


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A temporary folder of this machine stands in only where the executors are on it too."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='corvella-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Staging:
    """Calls write a table and give the same rows read from there; the tables go at the end of a `with`, else of the driver."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        atexit.register(self.clear)

    def folder(self) -> str:
        """Path of a folder that isn't there yet and goes with the tables."""
        self.paths.append(f"{shared_folder(self.spark)}/corvella-{uuid.uuid4().hex}")
        return self.paths[-1]

    def __call__(self, df: DataFrame) -> DataFrame:
        path = self.folder()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        self.clear()
        atexit.unregister(self.clear)

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is None:  # the session has ended before the driver
            return
        try:
            while self.paths:
                Files(self.spark).remove(self.paths.pop())
        except (ConnectionError, Py4JError):
            pass
