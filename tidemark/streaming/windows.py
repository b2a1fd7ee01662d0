"""Event windows as Structured Streaming: read as a stream, finish with what is there, and give the result as a table.

Windows are kept in update mode: a batch gives the windows that it changed, which are written over what the table had of them, and
windows that the watermark has passed leave the state. A row that comes later than that is dropped and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from ..scratch import shared_dir

#: Batches whose changes a table keeps beside each other before they are put together.
TOGETHER = 8
#: Width and slide of the radar's windows; how late a row may be.
WIDTH, SLIDE, LATE = "30 minutes", "10 minutes", "10 minutes"


def tumbling(rows: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and event type; works on streams and tables."""
    return windowed(rows, width, None, late)


def windowed(rows: DataFrame, width: str = WIDTH, slide: str | None = SLIDE, late: str = LATE) -> DataFrame:
    """Counts and sums by window, sliding if ``slide`` is given, and event type; works on streams and tables."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if rows.isStreaming else timed
    out = timed.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.unix_seconds("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(rows: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Sessions of a user: events without a pause as long as ``gap``."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
    return out.select("user_id", "first_event", "n")


class Upserts:
    """A table in a shared folder that a stream's batches write over, row by row; ``keys`` tell its rows apart.

    A batch writes its changes to a folder of its own number, so that a batch that is run again changes nothing. Every
    ``TOGETHER`` batches what they say last of each key becomes one folder; readers take the last word of each key.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder, keys
        self.schema = StructType([*schema.fields]).add("batch", "long")

    def save(self, changes: DataFrame, number: int) -> None:
        changes.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/changes/upto={number}")
        if number % TOGETHER == TOGETHER - 1:
            self.last(self.all_changes().where(F.col("upto") <= number)).write.mode("overwrite").parquet(f"{self.folder}/together/upto={number}")

    def all_changes(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add("upto", "long")).option("basePath", f"{self.folder}/changes").parquet(f"{self.folder}/changes")

    def last(self, rows: DataFrame) -> DataFrame:
        newest = W.partitionBy(*self.keys).orderBy(F.desc("batch"))
        return rows.withColumn("_k", F.row_number().over(newest)).where("_k = 1").select(*self.schema.names)

    def read(self) -> DataFrame:
        """The table: what was put together last, and the changes since then."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/together")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if fs.exists(path) else []
        rows = self.all_changes()
        if done:
            base = self.spark.read.schema(self.schema).parquet(f"{self.folder}/together/upto={max(done)}")
            rows = rows.where(F.col("upto") > max(done)).select(*self.schema.names).union(base)
        return self.last(rows).drop("batch")


def advance(spark: SparkSession, source: str, schema: StructType, folder: str, windows, keys: list[str]) -> tuple[Upserts, dict]:
    """Run ``windows`` over the files of ``source`` that are new since the last call; gives the table and what became of the rows: how many
    were read, how many updates came too late, how many windows the state still has and how many have left it."""
    stream = windows(spark.readStream.schema(schema).parquet(source))
    table = Upserts(spark, folder, stream.schema, keys)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").foreachBatch(table.save).trigger(availableNow=True).start()
    query.awaitTermination()
    told = {"read": 0, "late": 0, "held": 0, "left": 0}
    for p in query.recentProgress:
        told["read"] += p["numInputRows"]
        for s in p["stateOperators"]:
            told["late"] += s["numRowsDroppedByWatermark"]
            told["left"] += s["numRowsRemoved"]
            told["held"] = s["numRowsTotal"]
    return table, told


def events_stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling windows of a stream of the events table, in one run over what is there."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = shared_dir(spark)
    rows.write.parquet(f"{folder}/source")
    return advance(spark, f"{folder}/source", rows.schema, folder, tumbling, ["window_start", "event_type"])[0].read()


def events_in_parts(spark: SparkSession, sf_dir: str, folder: str, windows=windowed) -> tuple[Upserts, list[dict]]:
    """Four runs over events that come in order of time, but for every fiftieth, which come last, most of them too late."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    ends = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    lo, hi = (rows.select(F.unix_seconds(F.lit(x).cast("timestamp"))).first()[0] for x in ends)
    part = F.when(F.col("event_id") % 50 == 7, 3).otherwise(F.least(F.floor((second - lo) * 3 / F.lit(max(hi - lo, 1))), F.lit(2)))
    told, table = [], None
    for k in range(4):
        rows.where(part == k).coalesce(8).write.mode("append").parquet(f"{folder}/source")
        table, now = advance(spark, f"{folder}/source", rows.schema, folder, windows, ["window_start", "event_type"])
        told.append(now)
    return table, told


def events_stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows kept up in four runs; what comes after a window has left the state doesn't count in it."""
    return events_in_parts(spark, sf_dir, shared_dir(spark))[0].read()


def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))


QUERIES = {"events_stream_hourly": events_stream_hourly, "events_stream_sliding": events_stream_sliding, "events_session": events_session}
SQL = {
    "events_stream_hourly": "select cast(floor(epoch(ts) / 3600) * 3600 as bigint) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    # a row is in three windows; one that comes last only counts in those that end after the watermark of the others
    "events_stream_sliding": """with m as (select max(epoch_ms(ts)) - 600000 as mark from events where event_id % 50 <> 7),
        e as (select event_id, event_type, value, cast(floor(epoch(ts) / 600) * 600 as bigint) - k * 600 as window_start from events cross join range(3) r(k))
        select window_start, event_type, count(*) as n, round(sum(value), 4) as total from e cross join m where event_id % 50 <> 7 or (window_start + 1800) * 1000 > mark group by 1, 2""",
    "events_session": """with e as (select user_id, event_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hours then 0 else 1 end as fresh from events),
        s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as k from e)
        select user_id, min(event_id) as first_event, count(*) as n from s group by user_id, k""",
}
