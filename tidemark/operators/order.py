"""Numbers of rows in a global order, and pointers that are followed all the way, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import materialize, release


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, the place of each row in the order of ``keys`` from 0; rows are dealt to ranges and numbered there."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_m"))  # a row a partition
    before = sizes.select("_part", (F.sum("_m").over(W.orderBy("_part")) - F.col("_m")).alias("_shift"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*keys)) - 1
    out = materialize(ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_inside") + F.col("_shift")).drop("_part", "_inside", "_shift"))
    release(ranged)
    return out


def carried(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``df`` with ``value`` filled by the last one that isn't null, of the same ``by``, in the order of ``order``, which tells a key's rows
    apart; a key may be in several ranges, each of which hands on its last value."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, by, order).withColumn("_part", F.spark_partition_id()))
    ends = ranged.groupBy(by, "_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))  # a key has a row a range
    earlier = W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).select(F.col(by).alias("_by"), F.col("_part").alias("_p"), "_before")
    here = F.last(value, ignorenulls=True).over(W.partitionBy("_part", by).orderBy(order))
    filled = ranged.withColumn("_here", here).join(before, (F.col("_by").eqNullSafe(F.col(by))) & (F.col("_p") == F.col("_part")), "left")
    return filled.withColumn(value, F.coalesce("_here", "_before")).select(*df.columns)


def followed(links: DataFrame, merge: dict[str, tuple]) -> DataFrame:
    """``links(node, parent, ..)`` of a forest with the columns of ``merge`` gathered along the way to the root, by doubling.

    ``merge`` gives for each column how a node's value, which covers its way so far, and that of the next node meet: a function
    of two columns. A root's parent is null. As many rounds as the depth has binary digits.
    """
    columns = list(merge)
    now = materialize(links.select("node", "parent", *columns))
    while not now.where("parent is not null").isEmpty():
        ahead = now.select(F.col("node").alias("parent"), F.col("parent").alias("_next"), *[F.col(c).alias(f"_{c}") for c in columns])
        joined = now.join(ahead, "parent", "left")
        values = [F.when(F.col("parent").isNull(), F.col(c)).otherwise(merge[c](F.col(c), F.col(f"_{c}"))).alias(c) for c in columns]
        after = materialize(joined.select("node", F.col("_next").alias("parent"), *values))
        release(now)
        now = after
    return now.select("node", *columns)


def gathered(links: DataFrame, value: str) -> DataFrame:
    """``(node, value)`` of ``links(node, parent, value)``: sums of the values of each node and all below it, by doubling."""
    now = materialize(links.select("node", "parent", value))
    while not now.where("parent is not null").isEmpty():
        gain = now.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.sum(value).alias("_gain"))
        ahead = now.select(F.col("node").alias("parent"), F.col("parent").alias("_next"))
        joined = now.join(ahead, "parent", "left").join(gain, "node", "left")
        after = materialize(joined.select("node", F.col("_next").alias("parent"), (F.col(value) + F.coalesce("_gain", F.lit(0))).alias(value)))
        release(now)
        now = after
    return now.select("node", value)


def later(_: Column, ahead: Column) -> Column:
    """For ``followed``: what lies farther along the way, null as well."""
    return ahead


def farthest(own: Column, ahead: Column) -> Column:
    """For ``followed``: what lies farther along the way, if there is something."""
    return F.coalesce(ahead, own)
