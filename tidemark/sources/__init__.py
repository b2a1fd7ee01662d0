"""Readers and writers of files, tolerant where their sources are not clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BAD = "_bad"


def read_table(spark: SparkSession, path: str, schema: StructType, required: str | None = None) -> DataFrame:
    """A Parquet, TSV or CSV table by its extension; rows whose ``required`` column is null are left out."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        rows = spark.read.schema(schema).parquet(path)
    elif kind in ("tsv", "csv"):
        rows = spark.read.schema(schema).option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("multiLine", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"no reader for .{kind}")
    return rows.where(F.col(required).isNotNull()) if required else rows


def write_table(df: DataFrame, path: str) -> None:
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        df.write.parquet(path)
    else:
        df.write.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"').csv(path)


def read_splits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All of ``event=../split=..``, with both as columns; a split that isn't there gives no rows."""
    return spark.read.schema(f"{schema}, event string, split string").option("basePath", path).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType, required: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Records of JSON lines. Blank and malformed lines and records without a required field are left out; other fields that
    are missing take their default."""
    rows = spark.read.schema(StructType([*schema.fields]).add(BAD, "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    rows = rows.where(F.col(BAD).isNull())
    for name in required:
        rows = rows.where(F.col(name).isNotNull())
    for name, value in (defaults or {}).items():
        rows = rows.withColumn(name, F.coalesce(name, value))
    return rows.drop(BAD)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """The table, which must have a row."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def with_vectors(ids: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Ids joined to their vectors; both must have as many rows."""
    n, m = ids.count(), vectors.count()
    if n != m:
        raise ValueError(f"{n} ids for {m} vectors")
    return ids.join(vectors, key)
