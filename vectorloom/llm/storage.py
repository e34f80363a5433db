"""Tables between steps, in the folder that the cluster shares."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """A folder of its own under ``spark.checkpoint.dir``. Where the session names none, a local folder serves a local master, as in tests; on a cluster that is an error, as executors would write where nobody reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not root:
            import tempfile

            root = f"file://{tempfile.gettempdir()}/vectorloom-checkpoints"
        self.path = f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"
        files, path = self._files("")
        files.mkdirs(path)
        files.deleteOnExit(path)  # results that have been returned may still read it until the application ends

    def _files(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def written(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """``df`` as a Parquet table, read again: lineage ends here and survives lost executors."""
        df.write.mode("overwrite").option("compression", compression).parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def release(self) -> None:
        """Lets Spark remove shuffle files of steps whose results are written: it does so once the JVM has collected their handles."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def remove(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        files, path = self._files(name)
        files.delete(path, True)
