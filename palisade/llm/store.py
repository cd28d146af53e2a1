"""Written intermediate tables in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one below the warehouse where that is unset and Spark runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages").rstrip("/")


class Stages:
    """Tables that one operator writes and reads again; this cuts lineage, so a lost executor costs one stage at most.

    Spark deletes a plan's shuffle files once the driver has noticed that the plan is garbage; an operator of
    many jobs asks with ``tidy`` for that after every write, so that the files of its earlier jobs do not add up.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.root, self.n, self.tidy = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0, tidy

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet in the shared folder and return the table read from there."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        if self.tidy:
            self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``keep`` returned and that no later plan reads."""
        for path in _folders(df):
            self._delete(path)

    def only(self, *read: DataFrame) -> None:
        """Delete all that ``keep`` has written but the tables ``read``."""
        names = {path.rsplit("/", 1)[1] for df in read for path in _folders(df)}
        for i in range(1, self.n + 1):
            if str(i) not in names:
                self._delete(f"{self.root}/{i}")

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
