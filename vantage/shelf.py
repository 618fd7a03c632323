"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: The driver is cleared when its heap takes more than this share of its limit, but no more often than this.
CLEAR_FROM, CLEAR_EVERY_S = 0.5, 3.0
_last_clear = float("-inf")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session may do without one: its executors are
    the driver, so a temporary folder is shared, too."""
    found = spark.sparkContext.getConf().get(_KEY) or spark.conf.get("vantage.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise RuntimeError(f"{_KEY} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vantage-")
        spark.conf.set("vantage.shared.dir", found)
    return found.rstrip("/")


def clear(spark: SparkSession) -> None:
    """Frees what ended plans left on the driver: trees, broadcasts and generated classes, which a
    heap of a few hundred MB otherwise holds until it is full, beside all that lies outside it."""
    global _last_clear
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if time.monotonic() - _last_clear >= CLEAR_EVERY_S and runtime.totalMemory() > CLEAR_FROM * runtime.maxMemory():
        gc.collect()
        runtime.gc()
        _last_clear = time.monotonic()


class Shelf:
    """Tables written to the shared folder: they cut lineage and survive lost executors. They go
    with the application, if not earlier."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0
        clear(spark)

    def _place(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        if self.n == 1:
            p, files = self._place(self.base)
            files.deleteOnExit(p)
        clear(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for t in tables:
            if path := self.paths.pop(id(t), None):
                p, files = self._place(path)
                files.delete(p, True)
