"""Tables in the folder that the cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset and all runs on one machine, below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def materialize(df: DataFrame, base: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = base or shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


_kept: dict[tuple, tuple] = {}


def kept(spark: SparkSession, name: str, source: str, make) -> DataFrame:
    """The table ``name`` of a source, as ``make()`` gives it: written once for an application, read by all that ask for it."""
    key = (spark.sparkContext.applicationId, name, source)
    if key in _kept:
        path, schema = _kept[key]
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.read.schema(schema).parquet(path)
    df = materialize(make())
    _kept[key] = (df.scratch, df.schema)
    return df


def release(*tables: DataFrame) -> None:
    """Delete materialized tables; what was made from them must be written before."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
