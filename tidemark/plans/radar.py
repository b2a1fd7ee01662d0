"""Clusters of claims that circulate, and what official sources say of them.

Three ways to group claims: each joins the first cluster, in the order of posts, that its key terms overlap with; density of
the vectors of their texts, where there are vectors and enough claims; and components of all overlaps of half of the smaller set
of terms, which don't depend on an order (equal sets meet first, as one; only sets that share one of their rarest terms
are compared).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lexicon as lx
from ..functions.dialect import DUCKDB, SPARK, Dialect, Steps, names_in, stepped, stepped_ctes, stepped_sql
from ..operators.density import density_clusters_of_kinds
from ..operators.graph import components
from ..operators.ordered import first_fit
from ..scratch import materialize
from . import posts
from . import knowledge
from .posts import BASE, VERIFIED, knowledge_steps, normalized, quoted

#: Minutes that a snapshot covers, share of the smaller set of terms, clusters shown.
MINUTES, OVERLAP, SHOWN = 30, 0.5, 8
#: Claims below which there is no density to speak of, and the members that make a cluster.
LEAST_CLAIMS, LEAST_MEMBERS = 6, 2
FLAGGED = f"verdict not in ('{lx.CLEAN}', '{lx.UNKNOWN}') and not rule_zero and claim is not null"


def token_steps(d: Dialect) -> Steps:
    stop = ", ".join(map(quoted, lx.CLUSTER_STOP_WORDS))
    words = d.kept(d.split(normalized(d, "claim"), " "), "w", f"length(w) > 2 and w not in ({stop})")
    return [{"terms": d.distinct(words)}, {"n_terms": d.size("terms"), "term_key": d.joined("terms", " ")}]


def flagged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stepped(posts.posts(spark, sf_dir, wanted={"post_id", "knowledge", "city", *names_in(FLAGGED)}).where(FLAGGED), token_steps(SPARK)).where("n_terms > 0")
    return materialize(rows.select("post_id", "verdict", "knowledge", "city", "claim", "terms", "n_terms", "term_key"))  # read several times


def term_clusters(claims: DataFrame) -> DataFrame:
    """``claims`` with ``cluster``, the least post_id of the claim's cluster."""
    sets = claims.groupBy("term_key").agg(F.min("post_id").alias("node"), F.first("terms").alias("terms"), F.first("n_terms").alias("n"))
    terms = sets.select("node", "n", "terms", F.explode("terms").alias("term"))
    rare = F.row_number().over(W.partitionBy("node").orderBy("df", "term"))
    ranked = terms.join(terms.groupBy("term").agg(F.count("*").alias("df")), "term").withColumn("k", rare)
    # a set shares at least half of its terms with a larger one, so one of its rarest terms beyond the other half
    probe = ranked.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * OVERLAP) + 1).select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("terms").alias("ta"), "term")
    met = probe.join(terms.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("terms").alias("tb"), "term"), "term").where("na <= nb and a != b")
    edges = met.where(F.size(F.array_intersect("ta", "tb")) >= F.col("na") * OVERLAP).select("a", "b").distinct()
    roots = components(edges)
    named = sets.select("term_key", "node").join(roots, "node", "left").select("term_key", F.coalesce("root", "node").alias("cluster"))
    return claims.join(named, "term_key")


def grouped(claims: DataFrame, vectors: DataFrame | None = None) -> tuple[DataFrame, str]:
    """``claims`` with ``cluster``, the first post of the claim's cluster, and how they were grouped: by density, if there are
    ``vectors(term_key, v)`` and at least ``LEAST_CLAIMS`` claims, noise being clusters of one, else by terms in the order of posts."""
    if vectors is not None and claims.count() >= LEAST_CLAIMS:
        found = density_clusters_of_kinds(claims.select(F.col("post_id").alias("id"), F.col("term_key").alias("kind")), vectors.select(F.col("term_key").alias("kind"), "v"), LEAST_MEMBERS)
        return claims.join(found.select(F.col("id").alias("post_id"), "cluster"), "post_id"), "density"
    found = first_fit(claims.select(F.col("post_id").alias("id"), "terms"), OVERLAP)
    return claims.join(found.withColumnRenamed("id", "post_id"), "post_id"), "terms"


def claim_vectors(claims: DataFrame) -> DataFrame:
    """``(term_key, v)``: unit vectors of the claims' distinct terms; terms without a trigram have a vector of zeros."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    kinds = knowledge.spread(claims.select("term_key").distinct(), "term_key")
    rows = knowledge.with_vectors(kinds, "term_key", zeros=True).withColumn("length", length)
    return rows.select("term_key", F.transform("embedding", lambda x: F.when(F.col("length") > 0, x / F.col("length")).otherwise(0.0)).alias("v"))


def snapshot(found: DataFrame) -> DataFrame:
    """The clusters with most posts: first claim, count, spread, acceleration, leading verdict, official status, places."""
    verdicts = found.groupBy("cluster", "verdict").agg(F.count("*").alias("n"), F.min("post_id").alias("first")).groupBy("cluster").agg(F.max(F.struct("n", (-F.col("first")).alias("o"), "verdict")).alias("v"))
    spoken = F.col("knowledge") != lx.SILENT
    rows = found.groupBy("cluster").agg(
        F.min_by("claim", "post_id").alias("claim"), F.count("*").alias("posts"), F.array_join(F.sort_array(F.collect_set("city")), ",").alias("places"),
        F.coalesce(F.min_by("knowledge", F.when(spoken, F.col("post_id"))), F.lit(lx.SILENT)).alias("official"),
    )
    half = F.greatest(F.floor(F.col("posts") / 2), F.lit(1))
    rows = rows.join(verdicts, "cluster").withColumns({"spread": F.round(F.col("posts") / MINUTES * 60, 1), "acceleration": F.when(F.col("posts") > 1, F.round((F.col("posts") - half) / half, 2)).otherwise(1.0)})
    top = rows.orderBy(F.desc("posts"), "cluster").limit(SHOWN)
    ordinal = F.row_number().over(W.orderBy(F.desc("posts"), "cluster"))  # of the few that are shown
    return top.select(F.concat(F.lit("kume_"), F.lpad(ordinal.cast("string"), 2, "0")).alias("id"), "cluster", "claim", "posts", "spread", "acceleration", F.col("v.verdict").alias("verdict"), "official", "places")


def claim_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What circulates most, grouped by terms in the order of posts."""
    return snapshot(grouped(flagged_claims(spark, sf_dir))[0])


def claim_clusters_by_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What circulates most, grouped by density of the claims' vectors."""
    claims = flagged_claims(spark, sf_dir)
    return snapshot(grouped(claims, claim_vectors(claims))[0])


def claim_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the three ways agree: clusters and the largest of each, and the adjusted Rand index of each two."""
    claims = flagged_claims(spark, sf_dir)
    ways = {"terms": grouped(claims)[0], "density": grouped(claims, claim_vectors(claims))[0], "components": term_clusters(claims)}
    ways = {k: v.select("post_id", F.col("cluster").alias(k)) for k, v in ways.items()}
    rows = materialize(ways["terms"].join(ways["density"], "post_id").join(ways["components"], "post_id"))
    pairs = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("s"), F.count("*").alias("k"), F.max("n").alias("m"))
    out = None
    for a, b in (("terms", "density"), ("terms", "components"), ("density", "components")):
        one, two, both = (pairs(rows, *by) for by in ((a,), (b,), (a, b)))
        joined = one.select(F.col("s").alias("sa"), F.col("k").alias("clusters"), F.col("m").alias("largest")).crossJoin(two.select(F.col("s").alias("sb"))).crossJoin(both.select("s")).crossJoin(rows.agg(F.count("*").alias("n")))  # single rows
        chance = F.col("sa") * F.col("sb") / (F.col("n") * (F.col("n") - 1) / 2)
        row = joined.select(F.lit(a).alias("way"), F.lit(b).alias("other"), "clusters", "largest", F.round(F.try_divide(F.col("s") - chance, (F.col("sa") + F.col("sb")) / 2 - chance), 6).alias("ari"))
        out = row if out is None else out.union(row)
    return out


def claim_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_clusters(flagged_claims(spark, sf_dir)).groupBy("cluster").agg(F.count("*").alias("posts"), F.count_distinct("term_key").alias("kinds"))


def knowledge_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon proposes a record, and vectors of the texts confirm it: it must be among the nearest records of the claim."""
    pool = posts.pool_of(spark, sf_dir)
    rows = materialize(posts.posts(spark, sf_dir, "text", ["post_id", "claims", "claims_norm"]).where("claims is not null"))
    claims = rows.select(F.col("post_id").alias("id"), F.col("claims_norm").alias("text"))
    best = knowledge.best_records(claims, pool)
    asked = materialize(claims.join(best.where(F.col("similarity") >= VERIFIED), "id").select("id", "text"))  # others need no confirmation
    known = best.join(knowledge.near_records(asked, pool), "id", "left").withColumnRenamed("id", "post_id")
    found = rows.join(known, "post_id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    found = stepped(found, knowledge_steps(SPARK, VERIFIED, "coalesce(array_contains(near, best_ord), false)"))
    return found.select("post_id", "best_record", "record", "similarity", "knowledge")


def knowledge_pool_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool as it is read from its lines."""
    joined = [F.array_join(c, " ").alias(c) for c in ("keywords", "anchors")]
    return posts.pool_of(spark, sf_dir).select("ord", "record_id", F.md5("claim").alias("claim_md5"), "rating", *joined)


def pool_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the record on a claim itself is found: by terms and anchors, by the vectors' first five, by both."""
    pool = posts.pool_of(spark, sf_dir)
    rows = posts.posts(spark, sf_dir, "text", ["post_id", "claims_norm"]).where("claims_norm is not null").where(knowledge.OF)
    claims = materialize(rows.select(F.col("post_id").alias("id"), F.col("claims_norm").alias("text")))
    own = claims.join(pool.select((F.col("ord") - len(knowledge.SEEDS)).alias("id"), "record_id", F.col("ord").alias("own")), "id")
    found = own.join(knowledge.best_records(claims, pool), "id", "left").join(knowledge.near_records(claims, pool), "id", "left")
    first, near = F.coalesce(F.col("best_record") == F.col("record_id"), F.lit(False)), F.coalesce(F.array_contains("near", F.col("own")), F.lit(False))
    share = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    return found.agg(F.count("*").alias("n"), share(first, "by_terms"), share(near, "by_vectors"), share(first & near, "by_both"))


QUERIES = {q.__name__: q for q in (claim_clusters, claim_clusters_by_density, claim_grouping, claim_cluster_sizes, knowledge_verified, knowledge_pool_records, pool_retrieval)}
_CLAIMS = (
    stepped_sql(BASE, posts.steps(DUCKDB, "fusion")).replace("with ", "with recursive ", 1)
    + ", "
    + stepped_ctes(f"select * from posts where {FLAGGED}", token_steps(DUCKDB), "c", "c_")
    + ", claims as (select * from c where n_terms > 0)"
)
_FOUND = _CLAIMS + f""", sets as (select term_key, min(post_id) as node, any_value(terms) as terms, any_value(n_terms) as n from claims group by term_key),
e as (select a.node as a, b.node as b from sets a join sets b on a.node <> b.node and len(list_intersect(a.terms, b.terms)) >= {OVERLAP} * least(a.n, b.n)),
r as (select node, node as root from sets union select e.b, r.root from r join e on e.a = r.node), m as (select node, min(root) as cluster from r group by node),
found as (select claims.*, m.cluster from claims join sets using (term_key) join m on m.node = sets.node) """
#: One post after the other: it joins the first cluster that its terms overlap with, whose terms then grow, or begins one.
_FOLDED = _CLAIMS + f""", one as (select *, row_number() over (order by post_id) as k from claims),
fold as (select 0::bigint as k, null::bigint as post_id, null::bigint as cluster, []::struct(c bigint, t varchar[])[] as held union all
    select k, post_id, coalesce(hit, post_id), case when hit is null then list_append(held, struct_pack(c := post_id, t := terms)) else list_transform(held, lambda x: case when x.c = hit then struct_pack(c := x.c, t := list_distinct(list_concat(x.t, terms))) else x end) end
    from (select o.k, o.post_id, o.terms, f.held, list_extract(list_filter(f.held, lambda x: len(list_intersect(x.t, o.terms)) >= {OVERLAP} * least(len(x.t), len(o.terms))), 1).c as hit from fold f join one o on o.k = f.k + 1) n),
found as (select claims.*, fold.cluster from claims join fold using (post_id)) """
SQL = {
    "claim_cluster_sizes": _FOUND + "select cluster, count(*) as posts, count(distinct term_key) as kinds from found group by cluster",
    "claim_clusters": _FOLDED
    + f""", v as (select cluster, verdict, count(*) as n, min(post_id) as first from found group by cluster, verdict), w as (select *, row_number() over (partition by cluster order by n desc, first) as k from v),
g as (select cluster, arg_min(claim, post_id) as claim, count(*) as posts, array_to_string(list_sort(list_distinct(list(city))), ',') as places, coalesce(arg_min(knowledge, case when knowledge <> '{lx.SILENT}' then post_id end), '{lx.SILENT}') as official from found group by cluster),
o as (select *, row_number() over (order by posts desc, cluster) as k from g)
select 'kume_' || lpad(o.k::varchar, 2, '0') as id, o.cluster, o.claim, posts, round(posts / {MINUTES}::double * 60, 1) as spread, case when posts > 1 then round((posts - greatest(posts // 2, 1)) / greatest(posts // 2, 1)::double, 2) else 1.0 end as acceleration, w.verdict, official, places
from o join w on w.cluster = o.cluster and w.k = 1 where o.k <= {SHOWN}""",
    "knowledge_verified": stepped_sql(BASE, posts.steps(DUCKDB, "text"))
    + f", {knowledge.pool_sql('posts')}, {knowledge.best_sql('posts')}, {knowledge.near_sql('posts')}, "
    + stepped_ctes(
        "select p.*, b.best_record, b.best_ord, coalesce(b.similarity, 0.0::double) as similarity, b.rating, near.near from posts p left join best b using (post_id) left join near using (post_id) where claims is not null",
        knowledge_steps(DUCKDB, VERIFIED, "coalesce(list_contains(near, best_ord), false)"), "kp", "k_",
    )
    + " select post_id, best_record, record, similarity, knowledge from kp",
    "knowledge_pool_records": stepped_sql(BASE, posts.steps(DUCKDB, "text")) + f", {knowledge.pool_sql('posts')} select ord, record_id, md5(claim) as claim_md5, rating, array_to_string(keywords, ' ') as keywords, array_to_string(anchors, ' ') as anchors from pool",
    "pool_retrieval": stepped_sql(BASE, posts.steps(DUCKDB, "text"))
    + f""", {knowledge.pool_sql('posts')}, {knowledge.best_sql('posts')}, {knowledge.near_sql('posts')},
f as (select coalesce(b.best_record = r.record_id, false) as t, coalesce(list_contains(near.near, r.ord), false) as v from pool r left join best b on b.post_id = r.ord - {len(knowledge.SEEDS)} left join near on near.post_id = r.ord - {len(knowledge.SEEDS)} where r.ord >= {len(knowledge.SEEDS)})
select count(*) as n, round(avg(t::int::double), 6) as by_terms, round(avg(v::int::double), 6) as by_vectors, round(avg((t and v)::int::double), 6) as by_both from f""",
}
