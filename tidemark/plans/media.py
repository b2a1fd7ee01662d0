"""What is known of media without looking at pixels: hashes of their names, the manifests they carry, scenes against claims."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType

from ..functions import lexicon as lx

#: Kinds of scenes that a picture may show; the last one decides nothing. How far a lead counts in full.
SCENES, LEAD = ("deprem", "yangin", "sel", "diger"), 0.08
GENERATED = "trainedAlgorithmicMedia"


@F.pandas_udf(LongType())
def name_hash(names: pd.Series) -> pd.Series:
    """The 64-bit BLAKE2b hash of a name, as a signed number."""
    return names.map(lambda x: None if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big", signed=True))


def demo_score(salt: str, name: Column, low: float, high: float) -> Column:
    """A score between ``low`` and ``high`` that depends on the name only: its unsigned hash modulo 1000."""
    h = name_hash(F.concat(F.lit(f"{salt}:"), name))
    thousandth = F.pmod(F.pmod(h, F.lit(1000)) + F.when(h < 0, (1 << 64) % 1000).otherwise(0), F.lit(1000))
    return F.round(F.lit(low) + thousandth / 1000.0 * (high - low), 4)


def name_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes and scores of page addresses. No SQL: DuckDB has no such hash; tests compare with the library."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", name_hash("url").alias("hash"), demo_score("video", F.col("url"), 0.05, 0.35).alias("video"), demo_score("scene", F.col("url"), 0.0, 1.0).alias("scene"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' manifests as JSON: an active one and its ancestors, each with assertions that hold actions."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")

    def one(generated: Column, name: Column) -> Column:
        kind = F.when(generated, F.lit(f"http://cv.iptc.org/newscodes/digitalsourcetype/{GENERATED}")).otherwise("http://cv.iptc.org/newscodes/digitalsourcetype/digitalCapture")
        actions = F.array(F.struct(F.lit("c2pa.opened").alias("action"), F.lit("none").alias("source")), F.struct(F.lit("c2pa.created").alias("action"), kind.alias("source")))
        return F.struct(F.array(F.struct(F.lit("c2pa.hash").alias("label"), F.array().cast("array<struct<action:string,source:string>>").alias("actions")), F.struct(F.lit("c2pa.actions").alias("label"), actions.alias("actions"))).alias("assertions"), name.alias("generator"))

    id_ = F.col("page_id")
    active = one(id_ % 5 == 0, F.when(id_ % 2 == 0, F.concat(F.lit("tool-"), (id_ % 7).cast("string"))))
    older = one(id_ % 4 == 1, F.when(id_ % 3 != 0, F.concat(F.lit("maker-"), (id_ % 11).cast("string"))))
    return rows.select("page_id", F.to_json(F.struct(active.alias("active"), F.array(older).alias("ancestors"))).alias("manifest"))


_MANIFEST = "assertions array<struct<label:string,actions:array<struct<action:string,source:string>>>>, generator string"


def manifest_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the active manifest, or else one of its ancestors, says that the media were generated, and by what."""
    rows = manifests(spark, sf_dir).select("page_id", F.from_json("manifest", f"active struct<{_MANIFEST}>, ancestors array<struct<{_MANIFEST}>>").alias("m"))

    def generated(m: Column) -> Column:
        return F.exists(m["assertions"], lambda a: F.exists(a["actions"], lambda x: x["source"].endswith(GENERATED)))

    older = F.filter("m.ancestors", generated)
    origin = F.when(generated(F.col("m.active")), "active").when(F.size(older) > 0, "ancestor")
    name = F.coalesce(F.when(origin == "active", F.col("m.active.generator")), F.when(F.size(older) > 0, F.get(older, F.lit(0))["generator"]), F.col("m.active.generator"))
    return rows.select("page_id", origin.alias("origin"), F.when(origin.isNotNull(), F.coalesce(name, F.lit("unknown"))).alias("generator"))


def scene_contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures (vectors whose id divides by 20) against prompts (the first twelve, three of each kind): the best kind, the lead of
    the best one that is not claimed over the claimed one, and how much that contradicts the claim."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    kind = F.element_at(F.array(*map(F.lit, SCENES)), (F.col("vec_id") % len(SCENES) + 1).cast("int"))
    prompts = rows.where("vec_id < 12").select(kind.alias("kind"), F.col("v").alias("p"))
    dot = F.aggregate(F.zip_with("v", "p", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scores = rows.where("vec_id % 20 = 0").crossJoin(F.broadcast(prompts)).groupBy("vec_id", "kind").agg(F.round(F.max(dot), 4).alias("score"))  # twelve prompts
    claimed = F.element_at(F.array(*map(F.lit, SCENES)), (F.floor(F.col("vec_id") / 20) % (len(SCENES) - 1) + 1).cast("int"))
    own = F.max(F.when(F.col("kind") == claimed, F.col("score")))
    other = F.max(F.when((F.col("kind") != claimed) & (F.col("kind") != SCENES[-1]), F.col("score")))
    best = F.max(F.struct("score", (-F.array_position(F.array(*map(F.lit, SCENES)), F.col("kind"))).alias("o"), "kind"))["kind"]
    out = scores.groupBy("vec_id").agg(best.alias("best"), F.first(claimed).alias("claimed"), F.round(other - own, 4).alias("lead"))
    return out.select("*", F.round(F.greatest(F.lit(0.0), F.least(F.col("lead") / LEAD, F.lit(1.0))), 4).alias("contradiction"), (F.col("lead") > 0).alias("mismatch"))


def scene_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By claimed kind: how often the claim leads strictly."""
    return scene_contest(spark, sf_dir).groupBy("claimed").agg(F.count("*").alias("n"), F.round(F.avg((F.col("lead") < 0).cast("double")), 6).alias("accuracy"))


def author_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three events of each user with the user's name of a city: a feed page."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type")
    city = F.element_at(F.array(*map(F.lit, lx.CITIES)), (F.col("user_id") % len(lx.CITIES) + 1).cast("int"))
    k = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))
    return rows.withColumn("k", k).where("k <= 3").select("user_id", city.alias("city"), "event_id", "event_type", "k")


QUERIES = {q.__name__: q for q in (name_hashes, manifest_walk, scene_contest, scene_accuracy, author_feed)}
_scenes, _cities = (", ".join(f"'{x}'" for x in some) for some in (SCENES, lx.CITIES))
_CONTEST = f"""with p as (select ([{_scenes}])[vec_id % 4 + 1] as kind, embedding::double[] as p from embeddings where vec_id < 12),
s as (select vec_id, kind, round(max(list_dot_product(embedding::double[], p)), 4) as score, ([{_scenes}])[(vec_id // 20) % 3 + 1] as claimed from embeddings cross join p where vec_id % 20 = 0 group by vec_id, kind),
r as (select *, row_number() over (partition by vec_id order by score desc, list_position([{_scenes}], kind)) as k from s),
c as (select vec_id, max(case when k = 1 then kind end) as best, any_value(claimed) as claimed, round(max(case when kind <> claimed and kind <> 'diger' then score end) - max(case when kind = claimed then score end), 4) as lead from r group by vec_id) """
SQL = {
    "manifest_walk": """with p as (select page_id, page_id % 5 = 0 as a, page_id % 4 = 1 as b, case when page_id % 2 = 0 then 'tool-' || (page_id % 7) end as tool, case when page_id % 3 <> 0 then 'maker-' || (page_id % 11) end as maker from pages)
        select page_id, case when a then 'active' when b then 'ancestor' end as origin, case when a or b then coalesce(case when a then tool end, case when b then maker end, tool, 'unknown') end as generator from p""",
    "scene_contest": _CONTEST + f"select *, round(greatest(0.0::double, least(lead / {LEAD}::double, 1.0)), 4) as contradiction, lead > 0 as mismatch from c",
    "scene_accuracy": _CONTEST + "select claimed, count(*) as n, round(avg(case when lead < 0 then 1.0::double else 0 end), 6) as accuracy from c group by claimed",
    "author_feed": f"select * from (select user_id, ([{_cities}])[user_id % {len(lx.CITIES)} + 1] as city, event_id, event_type, row_number() over (partition by user_id order by event_id desc) as k from events) q where k <= 3",
}
