"""Tables that are replaced as a whole or not at all, and checked before they are.

A table is a folder of versions and a manifest that names the one that counts. A commit writes a new version, reads it back and
holds it against its contract; then the manifest is put in place by one rename. What fails before that, a lost driver as well,
leaves the table as it was; a commit of a version that is there already changes nothing, so a job may be run again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.json"


class ContractError(ValueError):
    """A version that doesn't keep its contract."""


@dataclass(frozen=True)
class Contract:
    """What a version must keep: columns and their types, at least so many rows, columns without nulls, keys that are unique, and
    conditions that no row may violate, by name."""

    columns: tuple[tuple[str, str], ...]
    least_rows: int = 1
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    conditions: dict[str, str] = field(default_factory=dict)

    def broken(self, df: DataFrame) -> tuple[list[str], int]:
        """What the table violates, and its rows: all is counted in one pass, keys in another."""
        wrong = []
        if (have := tuple(df.dtypes)) != self.columns:
            wrong.append(f"columns {have}, not {self.columns}")
            return wrong, df.count()
        checks = {f"null in {c}": F.col(f"`{c}`").isNull() for c in self.required} | {name: ~F.coalesce(F.expr(e), F.lit(False)) for name, e in self.conditions.items()}
        row = df.agg(F.count("*").alias("_rows"), *[F.count_if(e).alias(f"_c{k}") for k, e in enumerate(checks.values())]).first()
        wrong += [f"{name}: {row[f'_c{k}']} rows" for k, name in enumerate(checks) if row[f"_c{k}"]]
        if row["_rows"] < self.least_rows:
            wrong.append(f"{row['_rows']} rows, fewer than {self.least_rows}")
        if self.unique and (twice := df.groupBy(*self.unique).agg(F.count("*").alias("_n")).where("_n > 1").count()):
            wrong.append(f"{twice} repeated keys of {', '.join(self.unique)}")
        return wrong, row["_rows"]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _text(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it there, over what is there."""
    p, fs = _path(spark, f"{path}.new")
    stream = fs.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(p, _path(spark, path)[0], options)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What counts of the table, or nothing if it was never committed."""
    text = _text(spark, f"{path}/{MANIFEST}")
    return json.loads(text) if text else None


def commit(df: DataFrame, path: str, version: str, contract: Contract, partition_by: Sequence[str] = ()) -> dict:
    """Make ``df`` the table at ``path``, if it keeps its contract; gives the manifest. ``version`` names the run: the same version isn't
    written twice. A version that is half there, of a run that was lost, is written anew."""
    spark = df.sparkSession
    there = manifest(spark, path)
    if there and there["version"] == version:
        return there
    folder = f"{path}/{version}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(folder)
    schema = df.select(*[f"`{c}`" for c in [*(c for c in df.columns if c not in partition_by), *partition_by]]).schema
    back = spark.read.schema(schema).parquet(folder).select(*[f"`{c}`" for c in df.columns])
    wrong, rows = contract.broken(back)
    if wrong:
        p, fs = _path(spark, folder)
        fs.delete(p, True)
        raise ContractError(f"{path}: " + "; ".join(wrong))
    now = {"version": version, "rows": rows, "columns": df.columns, "schema": schema.json(), "before": there["version"] if there else None}
    _put(spark, f"{path}/{MANIFEST}", json.dumps(now))
    return now


def read(spark: SparkSession, path: str) -> DataFrame:
    """The version that counts."""
    from pyspark.sql.types import StructType

    there = manifest(spark, path)
    if not there:
        raise FileNotFoundError(f"{path} was never committed")
    return spark.read.schema(StructType.fromJson(json.loads(there["schema"]))).parquet(f"{path}/{there['version']}").select(*[f"`{c}`" for c in there["columns"]])
