"""Tables that go through files and come back: by extension, by split, as JSON lines with bad ones among them, as cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .. import sources
from ..functions import lexicon as lx
from ..scratch import shared_dir
from .portable import duckdb_sql, spark_query

PAIR = StructType([StructField("key", LongType()), StructField("name", StringType())])
RECORD = StructType([StructField("record_id", StringType()), StructField("claim", StringType()), StructField("rating", StringType()), StructField("keywords", ArrayType(StringType())), StructField("dhash", StringType())])
CARD = StructType([
    StructField("name", StringType()), StructField("least", DoubleType()),
    StructField("measurements", ArrayType(StructType([StructField("metric", StringType()), StructField("value", DoubleType()), StructField("n", LongType())]))),
])


def tables_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows through Parquet, TSV and CSV files; rows without a name are left out on the way back."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("key"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("name"))
    out = None
    for kind in ("parquet", "tsv", "csv"):
        path = f"{shared_dir(spark)}.{kind}"
        sources.write_table(rows, path)
        got = sources.read_table(spark, path, PAIR, "name").select("key", "name", F.lit(kind).alias("kind"))
        out = got if out is None else out.union(got)
    return out


def split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents filed by event and split, of which some are missing, read in one scan."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("event"), F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 8, "dev").otherwise("test").alias("split"))
    path = shared_dir(spark)
    rows.where("not (event like '%3' and split = 'dev')").write.partitionBy("event", "split").parquet(path)
    return sources.read_splits(spark, path, "doc_id long").groupBy("event", "split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def tolerant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool as JSON lines, among them blank and broken ones and records without a claim; what can be read comes back."""
    vec = F.lpad(F.lower(F.hex(F.col("item_id") * 1_000_003)), 16, "0")
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.struct(F.format_string("KRP-%05d", "item_id").alias("record_id"), F.when(F.col("item_id") % 5 != 0, F.col("text")).alias("claim"), F.lit("Yanlış").alias("rating"), F.when(F.col("item_id") % 2 == 0, F.array(F.lit("anahtar"))).alias("keywords"), vec.alias("dhash")).alias("r"))
    line = F.when(F.col("item_id") % 11 == 3, "").when(F.col("item_id") % 11 == 7, F.concat(F.substring(F.to_json("r"), 1, 20), F.lit("..."))).otherwise(F.to_json("r"))
    path = shared_dir(spark)
    rows.select(line.alias("value")).write.text(path)
    got = sources.not_empty(sources.read_jsonl(spark, path, RECORD, ["record_id", "claim"], {"keywords": F.array().cast("array<string>")}), "the pool")
    return got.select("record_id", F.md5("claim").alias("claim_md5"), "rating", F.size("keywords").cast("long").alias("n_keywords"), F.conv("dhash", 16, 10).cast("long").alias("hash"))


def seeds_and_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed records first, then the pool's; of equal ids the first stays."""
    pool = tolerant_records(spark, sf_dir).select("record_id", F.lit(1).alias("ord"))
    seeds = spark.range(0, 12).select(F.format_string("KRP-%05d", "id").alias("record_id"), F.lit(0).alias("ord"))
    return seeds.unionByName(pool).groupBy("record_id").agg(F.min("ord").alias("ord"))


def model_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of one JSON document a source, with measurements, written and read again; a card passes at its least score."""
    rows = spark_query("select d.source as name, count(*) as n, avg(l.quality) as accuracy, avg(l.toxic) as toxic from {documents} d join {labels} l on d.doc_id = l.doc_id group by d.source")(spark, sf_dir)
    metric = lambda m, c: F.struct(F.lit(m).alias("metric"), F.round(c, 4).alias("value"), F.col("n").alias("n"))
    path = shared_dir(spark)
    sources.write_jsonl(rows.select("name", F.lit(0.6).alias("least"), F.array(metric("accuracy", F.col("accuracy")), metric("toxic", F.col("toxic"))).alias("measurements")), path)
    cards = sources.read_jsonl(spark, path, CARD, ["name"])
    return cards.select("name", "least", F.explode("measurements").alias("m")).select("name", "m.metric", "m.value", "m.n", ((F.col("m.metric") != "accuracy") | (F.col("m.value") >= F.col("least"))).alias("passes"))


def card_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of a Markdown table for each measurement."""
    return model_cards(spark, sf_dir).select("name", "metric", F.format_string("| %s | %s | %.4f | %d |", "name", "metric", "value", "n").alias("line"))


def calibration_artefact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured knots as a JSON artefact, reloaded; keys without measurements keep the knots that are set, others none."""
    rows = spark_query("select lang as name, s as x, avg(y) as y from (select d.lang, floor(least(d.n_chars, 4000) / 1000e0) / 4e0 as s, l.quality as y from {documents} d join {labels} l on d.doc_id = l.doc_id) q group by lang, s")(spark, sf_dir)
    path = shared_dir(spark)
    knots = F.sort_array(F.collect_list(F.struct("x", F.round("y", 4).alias("y"))))
    sources.write_jsonl(rows.groupBy("name").agg(knots.alias("knots")), path)
    schema = StructType([StructField("name", StringType()), StructField("knots", ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])))])
    measured = sources.read_jsonl(spark, path, schema, ["name", "knots"]).select("name", F.size("knots").cast("long").alias("n"), F.round(F.aggregate("knots", F.lit(0.0), lambda a, k: a + k["y"]), 4).alias("total"))
    wanted = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("name")).distinct().union(spark.createDataFrame([(k,) for k in (*lx.KNOTS, "unknown.key")], "name string"))
    default = F.when(F.col("name").isin(*lx.KNOTS), F.lit("set")).otherwise("none")
    return wanted.join(measured, "name", "left").select("name", F.when(F.col("n").isNotNull(), "measured").otherwise(default).alias("origin"), "n", "total")


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and vectors that are kept apart, joined; as many of each are needed."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return sources.with_vectors(rows.select("vec_id", "label"), rows.select("vec_id", F.size("embedding").cast("long").alias("d")), "vec_id")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by id after upserts in order of time: the last write of an id stays."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 500).alias("post_id"), "event_id", "event_type")
    return rows.groupBy("post_id").agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("last_event"), F.count("*").alias("writes"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows with their place in each day's log."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type in ('error', 'purchase')").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return rows.withColumn("seq", F.row_number().over(W.partitionBy("day").orderBy("event_id")))


QUERIES = {q.__name__: q for q in (tables_by_extension, split_scan, tolerant_records, seeds_and_pool, model_cards, card_report, calibration_artefact, vector_store, upserted, audit_log)}
_RECORDS = "pool as (select printf('KRP-%05d', item_id) as record_id, md5(text) as claim_md5, 'Yanlış' as rating, case when item_id % 2 = 0 then 1 else 0 end as n_keywords, item_id * 1000003 as hash from benchmark where item_id % 5 <> 0 and item_id % 11 not in (3, 7))"
_CARDS = """c as (select d.source as name, count(*) as n, round(avg(l.quality), 4) as accuracy, round(avg(l.toxic), 4) as toxic from documents d join labels l using (doc_id) group by d.source),
cards as (select name, 'accuracy' as metric, accuracy as value, n, accuracy >= 0.6 as passes from c union all select name, 'toxic', toxic, n, true from c)"""
_names = ", ".join(f"('{k}')" for k in (*lx.KNOTS, "unknown.key"))
_set = ", ".join(f"'{k}'" for k in lx.KNOTS)
SQL = {
    "tables_by_extension": "select c_custkey as key, c_name as name, kind from customer cross join (select unnest(['parquet', 'tsv', 'csv']) as kind) k where c_custkey % 7 <> 0 and c_name is not null",
    "split_scan": "select * from (select source as event, case when doc_id % 10 < 7 then 'train' when doc_id % 10 < 8 then 'dev' else 'test' end as split, count(*) as n, min(doc_id) as first_doc from documents group by 1, 2) q where not (event like '%3' and split = 'dev')",
    "tolerant_records": f"with {_RECORDS} select * from pool",
    "seeds_and_pool": f"with {_RECORDS} select record_id, min(ord) as ord from (select printf('KRP-%05d', k) as record_id, 0 as ord from range(12) r(k) union all select record_id, 1 from pool) q group by record_id",
    "model_cards": f"with {_CARDS} select * from cards",
    "card_report": f"with {_CARDS} select name, metric, printf('| %s | %s | %.4f | %d |', name, metric, value, n) as line from cards",
    "calibration_artefact": duckdb_sql(f"""with k as (select lang as name, s as x, round(avg(y), 4) as y from (select d.lang, floor(least(d.n_chars, 4000) / 1000e0) / 4e0 as s, l.quality as y from {{documents}} d join {{labels}} l on d.doc_id = l.doc_id) q group by lang, s),
m as (select name, count(*) as n, round(sum(y), 4) as total from k group by name), w as (select distinct lang as name from {{documents}} union all select * from (values {_names}) v(name))
select w.name, case when n is not null then 'measured' when w.name in ({_set}) then 'set' else 'none' end as origin, n, total from w left join m on m.name = w.name"""),
    "vector_store": "select vec_id, label, len(embedding) as d from embeddings",
    "upserted": "select event_id % 500 as post_id, arg_max(event_type, event_id) as state, max(event_id) as last_event, count(*) as writes from events group by 1",
    "audit_log": "select event_id, strftime(ts, '%Y-%m-%d') as day, event_type, row_number() over (partition by strftime(ts, '%Y-%m-%d') order by event_id) as seq from events where event_type in ('error', 'purchase')",
}
