"""Steps of iterative operators, each kept in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Steps:
    """A folder of its own under ``spark.checkpoint.dir`` for an operator's steps, as Parquet tables: lineage ends there and survives lost executors. A local folder serves only a local master whose session
    names none. Tables that no later step reads can go at once; the rest goes when the application ends, as a result may still read it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        self.path = f"{(root or f'file://{tempfile.gettempdir()}/vectorloom-checkpoints').rstrip('/')}/steps-{uuid.uuid4().hex}"
        files, path = self._files("")
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _files(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read again."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def append(self, df: DataFrame, name: str) -> DataFrame:
        """The table that ``df`` has been added to: what rounds find adds up in one table, not in a union over all rounds."""
        df.write.mode("append").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            files, path = self._files(name)
            files.delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` as one kept step."""
    return Steps(df.sparkSession).kept(df, "step")
