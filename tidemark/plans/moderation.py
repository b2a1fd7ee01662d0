"""What moderators and authors do about posts: decisions, appeals and their outcomes, from a log of acts; the last act counts.

The log is ``events``: three kinds are decisions, one is an appeal, one resolves the appeal that the post had last. A post's
appeals are told apart in its acts' order, which is followed across ranges of the log, so that a post that everybody acts on
is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.dialect import DUCKDB, stepped_sql
from ..operators.order import carried
from ..scratch import materialize
from . import posts

#: Kinds of acts by kind of event; the value from which a resolution accepts.
DECISIONS = {"click": "onayla", "purchase": "kaldir_etiket", "signup": "ust_kurula"}
APPEALS, RESOLVES, ACCEPTS = "error", "view", 20.0
PENDING, ACCEPTED, REFUSED = "bekliyor", "kabul", "ret"
QUEUE, NEWEST, LEVEL = 100, 50, 4


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(act_id, at, post_id, kind, value)``: each act is on a post, which may not exist."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    post = F.col("user_id") * 100 + F.col("event_id") % 10
    return rows.select(F.col("event_id").alias("act_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), post.alias("post_id"), F.col("event_type").alias("kind"), "value")


def judged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts' verdicts, written once for what joins them several times."""
    return materialize(posts.posts(spark, sf_dir, "fusion", ["post_id", "author_id", "minute", "verdict", "confidence", "rule_zero", "level", "spread"]))


def flagged(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("verdict").isin(lx.CLEAN, lx.UNKNOWN) & ~F.col("rule_zero"))


def appeals(log: DataFrame, about: DataFrame) -> DataFrame:
    """``(appeal_id, post_id, created, status)`` of the appeals against ``about(post_id)``: as they were resolved last, or pending."""
    own = log.where(F.col("kind").isin(APPEALS, RESOLVES)).join(about.select("post_id"), "post_id", "left_semi")
    marked = own.withColumn("opened", F.when(F.col("kind") == APPEALS, F.col("act_id")))
    told = carried(marked, "post_id", "act_id", "opened").where("opened is not null")  # a resolution before any appeal is of none
    accepted = F.max_by(F.col("value") >= ACCEPTS, F.when(F.col("kind") == RESOLVES, F.col("act_id")))
    out = told.groupBy(F.col("opened").alias("appeal_id"), "post_id").agg(F.min("at").alias("created"), accepted.alias("accepted"), F.count_if(F.col("kind") == RESOLVES).alias("n"))
    status = F.when(F.col("n") == 0, PENDING).when(F.col("accepted"), ACCEPTED).otherwise(REFUSED)
    return out.select("appeal_id", "post_id", "created", status.alias("status"))


def moderator_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last decision on each post that needs one, how many there were, and what becomes of its verdict."""
    needs = judged_posts(spark, sf_dir).where(F.col("level") == LEVEL).select("post_id", "verdict")
    made = acts(spark, sf_dir).where(F.col("kind").isin(*DECISIONS))
    last = made.groupBy("post_id").agg(F.max_by("kind", "act_id").alias("kind"), F.max("act_id").alias("act_id"), F.count("*").alias("decisions"))
    decision = F.element_at(F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair]), F.col("kind"))
    out = needs.join(last, "post_id").select("post_id", "act_id", "decisions", decision.alias("decision"), F.col("verdict").alias("before"))
    return out.withColumn("after", F.when(F.col("decision") == DECISIONS["purchase"], lx.CLEAN).otherwise(F.col("before")))


def appeal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = flagged(judged_posts(spark, sf_dir))
    return appeals(acts(spark, sf_dir), about).join(about.select("post_id", "verdict"), "post_id").select("appeal_id", "post_id", "created", "status", "verdict")


def appeals_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appeals(acts(spark, sf_dir), flagged(judged_posts(spark, sf_dir))).orderBy(F.desc("created"), F.desc("appeal_id")).limit(NEWEST)


def moderation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts that spread most, with the first of their appeals that is pending."""
    about = flagged(judged_posts(spark, sf_dir))
    open_ = appeals(acts(spark, sf_dir), about).where(F.col("status") == PENDING).groupBy("post_id").agg(F.min("appeal_id").alias("appeal_id"))
    top = about.where("level > 0").orderBy(F.desc("spread"), F.desc("minute"), F.desc("post_id")).limit(QUEUE)
    return top.join(open_, "post_id", "left").select("post_id", "author_id", "verdict", "level", F.coalesce("spread", F.lit(0.0)).alias("spread"), "appeal_id")


def verdict_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader is told: a sentence a verdict, and a detail where it has one; a table of seven rows is joined."""
    cards = spark.createDataFrame([(v, h, lx.DETAILS.get(v)) for v, h in lx.HEADLINES.items()], "verdict string, headline string, detail string")
    rows = posts.posts(spark, sf_dir, "fusion", ["post_id", "verdict", "level"])
    return rows.join(F.broadcast(cards), "verdict", "left").select("post_id", "verdict", "level", "headline", "detail")


QUERIES = {q.__name__: q for q in (moderator_decisions, appeal_outcomes, appeals_newest, moderation_queue, verdict_cards)}
_decided = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in DECISIONS.items()) + " end"
#: One act after the other: how many appeals the post had before tells which one an act is about.
_LOG = (
    stepped_sql(posts.BASE, posts.steps(DUCKDB, "fusion"))
    + f""", log as (select event_id as act_id, cast(floor(epoch(ts)) as bigint) as at, user_id * 100 + event_id % 10 as post_id, event_type as kind, value from events),
about as (select * from posts where verdict not in ('{lx.CLEAN}', '{lx.UNKNOWN}') and not rule_zero),
al as (select log.*, count(case when kind = '{APPEALS}' then 1 end) over (partition by log.post_id order by act_id) as nth from log join about using (post_id) where kind in ('{APPEALS}', '{RESOLVES}')),
rs as (select post_id, nth, arg_max(value >= {ACCEPTS}, act_id) as accepted from al where kind = '{RESOLVES}' group by post_id, nth),
ap as (select al.act_id as appeal_id, al.post_id, al.at as created, case when rs.accepted is null then '{PENDING}' when rs.accepted then '{ACCEPTED}' else '{REFUSED}' end as status from al left join rs on rs.post_id = al.post_id and rs.nth = al.nth where kind = '{APPEALS}') """
)
_cards = ", ".join(f"('{v}', '{h}', {posts.quoted(lx.DETAILS[v]) if v in lx.DETAILS else 'null'})" for v, h in lx.HEADLINES.items())
SQL = {
    "moderator_decisions": _LOG + f"""select p.post_id, d.act_id, d.decisions, d.decision, p.verdict as before, case when d.decision = 'kaldir_etiket' then '{lx.CLEAN}' else p.verdict end as after
from posts p join (select post_id, max(act_id) as act_id, count(*) as decisions, arg_max({_decided}, act_id) as decision from log where {_decided} is not null group by post_id) d using (post_id) where p.level = {LEVEL}""",
    "appeal_outcomes": _LOG + "select appeal_id, ap.post_id, created, status, about.verdict from ap join about using (post_id)",
    "appeals_newest": _LOG + f"select * from ap order by created desc, appeal_id desc limit {NEWEST}",
    "moderation_queue": _LOG + f"""select p.post_id, p.author_id, p.verdict, p.level, coalesce(p.spread, 0) as spread, a.appeal_id from about p left join (select post_id, min(appeal_id) as appeal_id from ap where status = '{PENDING}' group by post_id) a using (post_id)
where level > 0 order by p.spread desc, p.minute desc, p.post_id desc limit {QUEUE}""",
    "verdict_cards": stepped_sql(posts.BASE, posts.steps(DUCKDB, "fusion")) + f"select p.post_id, p.verdict, p.level, c.headline, c.detail from posts p left join (values {_cards}) c(verdict, headline, detail) using (verdict)",
}
