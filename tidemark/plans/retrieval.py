"""How well the pool of records is found by questions that people ask: an evaluation set as a JSON document, and its measures.

The set has questions with a pattern each, and questions that no record answers. A pattern stands for all records in whose claim
it is found, so that a set outlives a rebuilt pool. Questions are looked up by vectors and by key terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.dialect import DUCKDB, SPARK, stepped_sql
from ..operators.containment import contained
from ..operators.similarity import cosine_top
from ..scratch import materialize, shared_dir
from . import knowledge, posts

#: Questions and questions without an answer that a set has: its size is its definition. Ranks that count.
ASKED, UNANSWERED, K = 28, 7, 5
_text = lambda *names: StructType([StructField(n, StringType()) for n in names])
SET = StructType([StructField("version", StringType()), StructField("questions", ArrayType(_text("question", "pattern", "topic"))), StructField("unanswered", ArrayType(_text("question", "topic")))])


def write_set(spark: SparkSession, questions: DataFrame, unanswered: DataFrame, path: str) -> None:
    """One JSON document over several lines, as people keep such sets."""
    whole = questions.agg(F.sort_array(F.collect_list(F.struct(*questions.columns))).alias("questions")).crossJoin(unanswered.agg(F.sort_array(F.collect_list(F.struct(*unanswered.columns))).alias("unanswered")))  # single rows
    lines = whole.select(F.to_json(F.struct(F.lit("0.1").alias("version"), "questions", "unanswered"), {"pretty": "true"}).alias("value"))
    lines.coalesce(1).write.text(path)


def read_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(number, question, pattern)`` and ``(number, question)`` of a set; entries without a question are left out."""
    whole = spark.read.schema(SET).option("multiLine", True).json(path)
    asked = whole.select(F.posexplode("questions").alias("number", "q")).select(F.col("number").cast("long"), "q.question", "q.pattern")
    without = whole.select(F.posexplode("unanswered").alias("number", "q")).select((F.col("number") + 1_000_000).cast("long").alias("number"), "q.question")
    return asked.where("question is not null and pattern is not null"), without.where("question is not null")


def targets(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """``(number, ord)``: all records whose normal claim holds the normal form of a question's pattern."""
    patterns = asked.select("number", F.expr(posts.normalized(SPARK, "pattern")).alias("term"))
    claims = pool.select(F.col("ord").alias("id"), F.expr(posts.normalized(SPARK, "claim")).alias("text"))
    return contained(claims, patterns.select("term")).join(patterns, "term").select("number", F.col("id").alias("ord"))


def made_set(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions on the pool's claims in other words around them, by the order of hashes, and questions on something else."""
    pool = posts.pool_of(spark, sf_dir)
    some = pool.orderBy(F.md5("record_id"), "record_id").limit(ASKED)
    questions = some.select(F.concat(F.lit("doğru mu "), F.substring("claim", 1, 40), F.lit(" diyorlar")).alias("question"), F.upper(F.substring("claim", 1, 12)).alias("pattern"), F.col("rating").alias("topic"))
    other = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy(F.md5(F.col("item_id").cast("string")), "item_id").limit(UNANSWERED)
    path = shared_dir(spark)
    write_set(spark, questions, other.select(F.substring("text", 1, 60).alias("question"), F.lit("other").alias("topic")), path)
    return read_set(spark, path)


def ranked(asked: DataFrame, pool: DataFrame, k: int = K) -> dict[str, DataFrame]:
    """``(number, ord, rank, score)`` of the first ``k`` records by each way."""
    texts = asked.select("number", F.expr(posts.normalized(SPARK, "question")).alias("text"))
    queries = knowledge.with_vectors(texts.select((-1 - F.col("number")).alias("vec_id"), "text"), "text").select("vec_id", "embedding")
    near = cosine_top(knowledge.pool_vectors(pool, k), queries, k).select((-1 - F.col("query_id")).alias("number"), F.col("vec_id").alias("ord"), "rank", F.col("cosine").alias("score"))
    by_terms = knowledge.scored_records(texts.select(F.col("number").alias("id"), "text"), pool).where("similarity > 0")
    order = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "ord"))
    return {"vectors": near, "terms": by_terms.withColumn("rank", order).where(F.col("rank") <= k).select(F.col("id").alias("number"), "ord", "rank", F.col("similarity").alias("score"))}


def pool_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each way: questions with a target, recall at 1 and 5, mean reciprocal rank, and the best score of questions without an answer."""
    pool = posts.pool_of(spark, sf_dir)
    asked, without = made_set(spark, sf_dir)
    asked, without = materialize(asked), materialize(without)
    wanted = materialize(targets(asked, pool))
    known = wanted.select("number").distinct()
    out = None
    for way, top in ranked(asked.select("number", "question").union(without), pool).items():
        top = materialize(top)
        first = known.join(top.join(wanted, ["number", "ord"]).groupBy("number").agg(F.min("rank").alias("rank")), "number", "left")
        share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
        row = first.agg(F.count("*").alias("n"), share((F.col("rank") == 1).cast("double")).alias("recall_at_1"), share((F.col("rank") <= K).cast("double")).alias("recall_at_5"), share(1 / F.col("rank")).alias("mrr"))
        best = without.join(top, "number", "left").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("best_without_answer"))
        row = row.crossJoin(best).select(F.lit(way).alias("way"), "*")  # single rows
        out = row if out is None else out.union(row)
    return out


def pattern_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that each question's pattern stands for, and the questions whose pattern is found nowhere."""
    asked = made_set(spark, sf_dir)[0]
    found = targets(asked, posts.pool_of(spark, sf_dir)).groupBy("number").agg(F.count("*").alias("records"), F.min("ord").alias("first"))
    return asked.join(found, "number", "left").select("question", "pattern", F.coalesce("records", F.lit(0)).alias("records"), "first")


QUERIES = {q.__name__: q for q in (pool_evaluation, pattern_targets)}
_n = lambda x: posts.normalized(DUCKDB, x)
_SET = (
    stepped_sql(posts.BASE, posts.steps(DUCKDB, "text"))
    + f""", {knowledge.pool_sql('posts')},
qs as (select 'doğru mu ' || substring(claim, 1, 40) || ' diyorlar' as question, upper(substring(claim, 1, 12)) as pattern, rating as topic from (select * from pool order by md5(record_id), record_id limit {ASKED}) q),
asked as (select row_number() over (order by question, pattern, topic) - 1 as number, question, pattern from qs),
un as (select row_number() over (order by question) - 1 + 1000000 as number, question from (select substring(text, 1, 60) as question from (select * from benchmark order by md5(item_id::varchar), item_id limit {UNANSWERED}) b) c),
tg as (select number, ord from asked join pool on contains({_n('claim')}, {_n('pattern')})) """
)
_every = f"(select number as post_id, {_n('question')} as claims_norm from (select number, question from asked union all select number, question from un) z)"
SQL = {
    "pattern_targets": _SET + "select question, pattern, coalesce(records, 0) as records, first from asked left join (select number, count(*) as records, min(ord) as first from tg group by number) t using (number)",
    "pool_evaluation": _SET
    + f""", ev as (select * from {_every}), {knowledge.best_sql('ev')}, {knowledge.near_sql('ev')},
ht as (select post_id as number, ord, similarity as score, row_number() over (partition by post_id order by similarity desc, ord) as rank from hit where similarity > 0),
vt as (select cv.post_id as number, pv.ord, round(list_cosine_similarity(cv.v, pv.v), 4) as score, row_number() over (partition by cv.post_id order by round(list_cosine_similarity(cv.v, pv.v), 4) desc, pv.ord) as rank from cv cross join pv),
tp as (select 'vectors' as way, * from (select number, ord, score, rank from vt where rank <= {K}) a union all select 'terms', * from (select number, ord, score, rank from ht where rank <= {K}) b),
kn as (select distinct number from tg), fr as (select w.way, kn.number, min(r.rank) as rank from kn cross join (values ('vectors'), ('terms')) w(way) left join (select tp.way, tp.number, tp.rank from tp join tg on tg.number = tp.number and tg.ord = tp.ord) r on r.number = kn.number and r.way = w.way group by w.way, kn.number)
select way, count(*) as n, round(avg(case when rank = 1 then 1.0::double else 0 end), 6) as recall_at_1, round(avg(case when rank <= {K} then 1.0::double else 0 end), 6) as recall_at_5, round(avg(coalesce(1.0::double / rank, 0)), 6) as mrr,
coalesce((select max(score) from tp join un on un.number = tp.number where tp.way = fr.way), 0.0::double) as best_without_answer from fr group by way""",
}
