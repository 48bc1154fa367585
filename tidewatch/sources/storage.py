"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    Only where that setting is unset (tests, local mode) a temporary folder is made and set as checkpoint folder; on a
    cluster, whose executors would not see it, an unset folder is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Workspace:
    """Written tables of one run, of which those that nothing reads any more are removed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors. A name may be used again."""
        path = shared_dir(self.spark, name)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes all tables of these names; all but the last written one of a name that ends in ``*``."""
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            paths = self.paths.get(name.rstrip("*"), [])
            for path in paths[: len(paths) - name.endswith("*")]:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(hadoop).delete(folder, True)
                paths.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of the shared folder that stays."""
    return Workspace(df.sparkSession).write(df, name)
