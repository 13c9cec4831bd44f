"""A session with the settings the library expects, and durable intermediates."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "skylattice", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode one is made where none is set; a cluster has to name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_shared_dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark._shared_dir = tempfile.mkdtemp(prefix="skylattice-")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows without their lineage, as a table in the cluster's shared checkpoint folder. A table, as a checkpoint would keep
    size estimates that multiply from round to round."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Bucketed:
    """A table of the shared folder that is bucketed by columns, so that joins on them move the other side only. Rows can be added."""

    def __init__(self, spark: SparkSession, buckets: int, *columns: str):
        self.spark, self.buckets, self.columns = spark, buckets, columns
        self.name = f"b_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/{self.name}"

    def add(self, df: DataFrame) -> DataFrame:
        dealt = df.repartition(self.buckets, *self.columns)  # a file a bucket
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, *self.columns).sortBy(*self.columns).option("path", self.path).saveAsTable(self.name)
        return self.table()

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Takes the name out of the session's catalogue; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, once; workers don't share the driver's import path."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_skylattice_shipped", False) or not root.is_dir():
        return
    path = f"{tempfile.mkdtemp(prefix='skylattice-')}/{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(path)
    context._skylattice_shipped = True
