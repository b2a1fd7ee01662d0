"""Term statistics of the corpus: document frequencies, keywords, anchors, and keyword overlap with a pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _terms(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 3))
    return rows.select(key, F.explode(found).alias("term"))


def idf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _terms(spark, sf_dir, "documents", "doc_id").groupBy("term").agg(F.count("*").alias("df"))
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log(F.col("n") / (1.0 + F.col("df"))), 6).alias("idf"))  # n is one row


#: Pools of up to so many terms are broadcast; larger ones are joined by shuffles.
BROADCAST = 200_000


def of_pool(spark: SparkSession, sf_dir: str, terms: DataFrame) -> DataFrame:
    """Those of ``terms(.., term)`` that the pool has: most terms leave before anything is shuffled."""
    pool = _terms(spark, sf_dir, "benchmark", "item_id").select("term").distinct()
    return terms.join(F.broadcast(pool) if pool.count() <= BROADCAST else pool, "term", "left_semi")


def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight rarest terms of each pool item, by document frequency in the corpus."""
    pool = _terms(spark, sf_dir, "benchmark", "item_id")
    df = of_pool(spark, sf_dir, _terms(spark, sf_dir, "documents", "doc_id")).groupBy("term").agg(F.count("*").alias("df"))
    ranked = pool.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return ranked.withColumn("k", F.row_number().over(W.partitionBy("item_id").orderBy("df", "term"))).where("k <= 8").select("item_id", "term", "df", "k")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count("*").alias("n"))
    rows = top_keywords(spark, sf_dir).crossJoin(F.broadcast(n)).where("df <= 0.02 * n")
    return rows.withColumn("a", F.row_number().over(W.partitionBy("item_id").orderBy("k"))).where("a <= 3").select("item_id", "term", "df")


def knowledge_overlap_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the pool item of which it holds the largest share of keywords, if that is at least 0.34; the
    join is on terms, an inverted index, so no document meets an item that it shares nothing with."""
    keys = top_keywords(spark, sf_dir).select("item_id", "term", F.count("*").over(W.partitionBy("item_id")).alias("n"))
    hits = of_pool(spark, sf_dir, _terms(spark, sf_dir, "documents", "doc_id")).join(keys, "term").groupBy("doc_id", "item_id").agg(F.round(F.count("*") / F.max("n"), 4).alias("score"))
    best = hits.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("item_id")).alias("o"))).alias("b"))
    return best.where("b.score >= 0.34").select("doc_id", (-F.col("b.o")).alias("item_id"), F.col("b.score").alias("score"))


def knowledge_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a veto: an item takes part in a document only where one of its anchors is there; items without anchors
    always do."""
    keys = top_keywords(spark, sf_dir).select("item_id", "term", F.count("*").over(W.partitionBy("item_id")).alias("n"))
    keys = keys.join(anchors(spark, sf_dir).select("item_id", "term", F.lit(1).alias("anchor")), ["item_id", "term"], "left")
    keys = keys.withColumn("anchored", F.max(F.coalesce("anchor", F.lit(0))).over(W.partitionBy("item_id")))
    hits = of_pool(spark, sf_dir, _terms(spark, sf_dir, "documents", "doc_id")).join(keys, "term").groupBy("doc_id", "item_id")
    hits = hits.agg(F.round(F.count("*") / F.max("n"), 4).alias("score"), F.coalesce(F.max("anchor"), F.lit(0)).alias("anchor"), F.max("anchored").alias("anchored")).where("anchor = 1 or anchored = 0")
    best = hits.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("item_id")).alias("o"))).alias("b"))
    return best.where("b.score >= 0.25").select("doc_id", (-F.col("b.o")).alias("item_id"), F.col("b.score").alias("score"))


def lexicon_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 1 and 5 and mean reciprocal rank of pool items asked for by documents that hold their first sentence's start;
    documents without such an item are left out, items without any shared term are no candidates."""
    pool = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.md5(F.substring("text", 1, 24)).alias("h"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.split("text", "[.!?]\\s+|\\n")).alias("p")).where("length(p) >= 24")
    target = docs.select("doc_id", F.md5(F.substring("p", 1, 24)).alias("h")).distinct().join(pool, "h").select("doc_id", "item_id").distinct()
    keys = top_keywords(spark, sf_dir).select("item_id", "term", F.count("*").over(W.partitionBy("item_id")).alias("n"))
    wanted = of_pool(spark, sf_dir, _terms(spark, sf_dir, "documents", "doc_id")).join(target.select("doc_id").distinct(), "doc_id", "left_semi")
    scored = wanted.join(keys, "term").groupBy("doc_id", "item_id").agg(F.round(F.count("*") / F.max("n"), 4).alias("score"))
    ranked = scored.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "item_id"))).where("k <= 5")
    first = target.join(ranked, ["doc_id", "item_id"], "left").groupBy("doc_id").agg(F.min("k").alias("k"))
    return first.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("k") == 1, 1.0).otherwise(0.0)), 6).alias("recall_at_1"), F.round(F.avg(F.when(F.col("k").isNotNull(), 1.0).otherwise(0.0)), 6).alias("recall_at_5"), F.round(F.avg(F.coalesce(1 / F.col("k"), F.lit(0.0))), 6).alias("mrr"))


QUERIES = {q.__name__: q for q in (knowledge_anchored, lexicon_retrieval, idf_terms, top_keywords, anchors, knowledge_overlap_top1)}
_T = "select {k}, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 3))) as term from {t}"
_DOCS, _POOL = _T.format(k="doc_id", t="documents"), _T.format(k="item_id", t="benchmark")
_BASE = f"""with dt as ({_DOCS}), pt as ({_POOL}), df as (select term, count(*) as df from dt group by term),
tk as (select * from (select item_id, term, coalesce(df, 0) as df, row_number() over (partition by item_id order by coalesce(df, 0), term) as k from pt left join df using (term)) q where k <= 8) """
SQL = {
    "idf_terms": _BASE + "select term, df, round(ln((select count(*) from documents) / (1.0::double + df)), 6) as idf from df",
    "top_keywords": _BASE + "select item_id, term, df, k from tk",
    "anchors": _BASE + "select item_id, term, df from (select *, row_number() over (partition by item_id order by k) as a from tk where df <= 0.02 * (select count(*) from documents)) q where a <= 3",
    "knowledge_anchored": _BASE
    + """, an as (select item_id, term from (select *, row_number() over (partition by item_id order by k) as a from tk where df <= 0.02 * (select count(*) from documents)) q where a <= 3),
    h as (select dt.doc_id, x.item_id, round(count(*) / max(n), 4) as score, count(an.term) as anchor, max(w.n_anchors) as n_anchors from dt join (select *, count(*) over (partition by item_id) as n from tk) x using (term) left join an on an.item_id = x.item_id and an.term = dt.term
    left join (select item_id, count(*) as n_anchors from an group by item_id) w on w.item_id = x.item_id group by dt.doc_id, x.item_id having count(an.term) > 0 or coalesce(max(w.n_anchors), 0) = 0)
    select doc_id, item_id, score from (select *, row_number() over (partition by doc_id order by score desc, item_id) as k from h) q where k = 1 and score >= 0.25""",
    "lexicon_retrieval": _BASE
    + """, target as (select distinct doc_id, item_id from (select doc_id, md5(substring(p, 1, 24)) as h from (select doc_id, unnest(regexp_split_to_array(text, '[.!?]\\s+|\\n')) as p from documents) a where length(p) >= 24) d join (select item_id, md5(substring(text, 1, 24)) as h from benchmark) b using (h)),
    sc as (select dt.doc_id, x.item_id, round(count(*) / max(n), 4) as score from dt join (select *, count(*) over (partition by item_id) as n from tk) x using (term) group by dt.doc_id, x.item_id),
    rk as (select *, row_number() over (partition by doc_id order by score desc, item_id) as k from sc), f as (select t.doc_id, min(case when rk.k <= 5 then rk.k end) as k from target t left join rk on rk.doc_id = t.doc_id and rk.item_id = t.item_id group by t.doc_id)
    select count(*) as n, round(avg(case when k = 1 then 1.0::double else 0 end), 6) as recall_at_1, round(avg(case when k is not null then 1.0::double else 0 end), 6) as recall_at_5, round(avg(coalesce(1.0::double / k, 0)), 6) as mrr from f""",
    "knowledge_overlap_top1": _BASE
    + """, h as (select doc_id, item_id, round(count(*) / max(n), 4) as score from dt join (select *, count(*) over (partition by item_id) as n from tk) x using (term) group by doc_id, item_id)
    select doc_id, item_id, score from (select *, row_number() over (partition by doc_id order by score desc, item_id) as k from h) q where k = 1 and score >= 0.34""",
}
