"""The pool of official records: seeds, and bulletins on claims that circulate, as JSON lines; and which record a claim meets.

A record has key terms and anchors. Claims are matched by containment, also inside words: only records one of whose anchors a
claim holds take part, and of these the one counts that has the largest share of its key terms there, the first of equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .. import sources
from ..functions.dialect import DUCKDB, SPARK, Dialect
from ..operators.containment import contained
from ..operators.similarity import cosine_top
from ..scratch import materialize, shared_dir

#: Seed records: id, key terms, anchors, rating.
SEEDS = [
    ("K1", "baraj yikil izmir", "baraj", "YANLIŞ"), ("K2", "ikinci deprem bekleniyor hatay", "ikinci", "Yanlış"), ("K3", "tahliye konya edil", "tahliye", "DOĞRU"), ("K4", "kopru coktu yol kapandi", "kopru", "yanlis"),
    ("K5", "elektrik kesil bursa", "elektrik", "Doğru"), ("K6", "tsunami uyarisi", "tsunami", "Karma"), ("K7", "sel bekleniyor saat", "sel", "YANLIS"), ("K8", "bina coktu van", "bina coktu", "dogru"), ("K9", "terk sehri", "terk", "doğru"),
]
#: Key terms and anchors of a bulletin; the share of bulletins that an anchor may be in; ratings of bulletins, by conversation.
KEYS, ANCHORS, RARE = 8, 3, 0.02
#: Records of an anchor that a text meets in one place; and what one ten thousandth of likeness counts beside any place in the pool.
MET, STEP = 256, "100000000000000000000"
RATINGS = ("YANLIŞ", "Doğru", "Karma")
#: Bulletins are on the claims of every second conversation.
OF = "post_id div 100 % 2 = 0"
RECORD = StructType([
    StructField("ord", LongType()), StructField("record_id", StringType()), StructField("claim", StringType()), StructField("rating", StringType()),
    StructField("keywords", ArrayType(StringType())), StructField("anchors", ArrayType(StringType())),
])
#: Numbers of a text's vector; ranks of the records that a match must be among.
DIMS, VETO = 64, 5


def seeds(spark: SparkSession) -> DataFrame:
    rows = [(k, n, t, r, t.split() if n != "K8" else ["bina", "coktu", "van"], a.split(",")) for k, (n, t, a, r) in enumerate(SEEDS)]
    return spark.createDataFrame(rows, RECORD)


def bulletins(claims: DataFrame) -> DataFrame:
    """A record for each of ``claims(post_id, claims_norm)``: its rarest terms among all bulletins; those without a rare one, an
    anchor, are left out."""
    found = F.array_distinct(F.filter(F.regexp_extract_all("claims_norm", F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 3))
    rows = materialize(claims.select("post_id", "claims_norm", found.alias("terms")).where(F.size("terms") > 0))
    n = rows.count()
    each = rows.select("post_id", F.explode("terms").alias("term"))
    each = each.join(each.groupBy("term").agg(F.count("*").alias("df")), "term")
    terms = each.groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("df", "term"))).alias("t"))  # the terms of one claim
    rare = F.slice(F.filter("t", lambda x: x["df"] <= RARE * n), 1, ANCHORS)
    rating = F.element_at(F.lit(list(RATINGS)), (F.expr("post_id div 100") % len(RATINGS) + 1).cast("int"))
    out = rows.join(terms, "post_id").select(
        (F.col("post_id") + len(SEEDS)).alias("ord"), F.concat(F.lit("B"), F.col("post_id")).alias("record_id"), F.col("claims_norm").alias("claim"), rating.alias("rating"),
        F.transform(F.slice("t", 1, KEYS), lambda x: x["term"]).alias("keywords"), F.transform(rare, lambda x: x["term"]).alias("anchors"),
    )
    return out.where(F.size("anchors") > 0)


def saved_pool(spark: SparkSession, claims: DataFrame) -> DataFrame:
    """Seeds first, then the bulletins, written as JSON lines and read as a pool is read; lines that can't be read are left out."""
    path = shared_dir(spark)
    sources.write_jsonl(seeds(spark).union(bulletins(claims)), path)
    return sources.not_empty(sources.read_jsonl(spark, path, RECORD, ["record_id", "claim"], {"keywords": F.array().cast("array<string>"), "anchors": F.array().cast("array<string>")}), "the pool")


def scored_records(claims: DataFrame, pool: DataFrame) -> DataFrame:
    """``(id, ord, record_id, rating, similarity)`` of ``claims(id, text)`` and the records that have an anchor in the text. Records without
    anchors take part nowhere.

    Records with their terms are many times what Spark judges them by, so they are never broadcast; those of a frequent anchor are
    dealt into parts of about ``MET``, which its texts meet one by one.
    """
    own = F.filter(F.array_distinct("anchors"), lambda a: a != "")
    anchors = pool.withColumn("anchors", own).select("*", F.posexplode("anchors").alias("at", "term"))
    parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = anchors.groupBy("term").agg(F.ceil(F.count("*") / MET).cast("int").alias("parts"))
    anchors = anchors.join(often.hint("merge"), "term").withColumn("part", F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int")).drop("parts")
    held = contained(claims, anchors.select("term")).join(claims.hint("merge"), "id").join(often.hint("merge"), "term")
    held = held.select("id", "text", "term", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).repartition(parts, "term", "part")  # few rows that make many
    # a pair counts at the first of the record's anchors that the text holds, so that no task holds all its pairs to tell them apart
    pairs = held.join(anchors.hint("merge"), ["term", "part"]).where(~F.exists(F.slice("anchors", 1, F.col("at")), lambda a: F.contains(F.col("text"), a)))
    share = F.size(F.filter("keywords", lambda k: F.contains(F.col("text"), k))) / F.size("keywords")
    return pairs.select("id", "ord", "record_id", "rating", F.when(F.size("keywords") > 0, F.round(share + 1e-9, 4)).otherwise(0.0).alias("similarity"))


def best_records(claims: DataFrame, pool: DataFrame) -> DataFrame:
    """``(id, best_record, best_ord, similarity, rating)`` of ``claims(id, text)``: the best record that has an anchor in the text; texts that
    hold no anchor, or none of its record's key terms, have no row."""
    place = F.lit(STEP).cast("decimal(38,0)")
    # one number orders pairs by likeness, then by place, so that the best is held by hash and pairs are never sorted
    key = F.round(F.col("similarity") * 10_000).cast("decimal(5,0)") * F.lit(STEP).cast("decimal(21,0)") - F.col("ord").cast("decimal(19,0)")
    best = scored_records(claims, pool).where("similarity > 0").groupBy("id").agg(F.max(key.cast("decimal(38,0)")).alias("k"))
    steps = F.round(F.col("k") / place).cast("decimal(5,0)")
    told = best.select("id", (steps * F.lit(STEP).cast("decimal(21,0)") - F.col("k")).cast("long").alias("best_ord"), (steps.cast("double") / 10_000).alias("similarity"))
    named = pool.select(F.col("ord").alias("best_ord"), F.col("record_id").alias("best_record"), "rating").dropDuplicates(["best_ord"])
    return told.join(named.hint("merge"), "best_ord").select("id", "best_record", "best_ord", "similarity", "rating")


def text_vector(d: Dialect, x: str) -> tuple[str, str]:
    """Hashed counts of a text's trigrams with signs, a vector of what the text says, without a model: the expression of the hashes, and
    that of the vector over them, which are called ``hs``."""
    places = f"sequence(1, greatest(length({x}) - 2, 1))" if d.spark else f"range(1, greatest(length({x}) - 2, 1) + 1)"
    raw = "substring(md5(substring({x}, cast(i as int), 3)), 1, 7)".replace("{x}", x)
    number = f"cast(conv({raw}, 16, 10) as bigint) % {2 * DIMS}" if d.spark else f"('0x' || {raw})::bigint % {2 * DIMS}"
    dims = f"sequence(0, {DIMS - 1})" if d.spark else f"range({DIMS})"
    count = lambda e: d.size(d.kept("hs", "h", f"h = {e}"))
    return f"{d.each(places, 'i', number)}", d.each(dims, "b", f"cast({count('b')} - {count(f'b + {DIMS}')} as double)")


def with_vectors(rows: DataFrame, x: str, zeros: bool = False) -> DataFrame:
    """``rows`` with the vector of a text as ``embedding``; rows whose vector has only zeros are left out, if not wanted."""
    hashes, vector = text_vector(SPARK, x)
    made = rows.withColumn("hs", F.expr(hashes)).withColumn("embedding", F.expr(vector)).drop("hs")
    return made if zeros else made.where(F.exists("embedding", lambda v: v != 0))


def pool_vectors(pool: DataFrame, k: int) -> DataFrame:
    """``(vec_id, embedding)``, written, of the records that may be among a text's nearest ``k``: of those with the same claim the first ``k``.
    Few files hold the pool and vectors are dear, so that records are dealt to all tasks first."""
    order = W.partitionBy("claim").orderBy("ord")
    first = pool.select("ord", "claim").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return materialize(with_vectors(spread(first.select(F.col("ord").alias("vec_id"), "claim")), "claim").select("vec_id", "embedding"))


def spread(rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """Rows, few by their size, dealt to all tasks that there may be."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def near_records(claims: DataFrame, pool: DataFrame, k: int = VETO) -> DataFrame:
    """``(id, near)`` of ``claims(id, text)``: the places in the pool of the ``k`` records whose texts' vectors are nearest."""
    texts = claims.groupBy("text").agg(F.min("id").alias("first"))
    asked = materialize(with_vectors(spread(texts.select((-1 - F.col("first")).alias("vec_id"), "text")), "text").select("vec_id", "embedding"))
    top = cosine_top(pool_vectors(pool, k), asked, k)
    found = top.groupBy((-1 - F.col("query_id")).alias("first")).agg(F.collect_set("vec_id").alias("near"))
    return claims.join(texts, "text").join(found, "first").select("id", "near")


def pool_sql(source: str) -> str:
    """The pool as DuckDB's common table expressions over the posts ``source``, written on its own."""
    values = ", ".join(f"({k}, '{n}', '{t}', '{r}', {t.split()!r}, {a.split(',')!r})" for k, (n, t, a, r) in enumerate(SEEDS))
    ratings = ", ".join(f"'{r}'" for r in RATINGS)
    return f"""bul as (select * from (select post_id, claims_norm, list_distinct(list_filter(regexp_extract_all(claims_norm, '[a-z0-9]+'), lambda t: length(t) > 3)) as terms from {source} where claims_norm is not null and (post_id // 100) % 2 = 0) q where len(terms) > 0),
bt as (select post_id, unnest(terms) as term from bul), bdf as (select term, count(*) as df from bt group by term),
bk as (select post_id, term, df, row_number() over (partition by post_id order by df, term) as k from bt join bdf using (term)),
bs as (select post_id, list(term order by k) filter (k <= {KEYS}) as keywords, list(term order by k) filter (k <= {ANCHORS} and df <= {RARE} * (select count(*) from bul)) as anchors from bk group by post_id),
pool as (select * from (values {values}) v(ord, record_id, claim, rating, keywords, anchors) union all
    select b.post_id + {len(SEEDS)}, 'B' || b.post_id, claims_norm, list_extract([{ratings}], b.post_id // 100 % {len(RATINGS)} + 1), keywords, anchors from bul b join bs using (post_id) where len(anchors) > 0)"""


def best_sql(source: str) -> str:
    """The best record of each of the posts ``source``; follows ``pool_sql``."""
    return f"""hit as (select p.post_id, r.ord, r.record_id, r.rating, round(len(list_filter(r.keywords, lambda k: contains(p.claims_norm, k))) / len(r.keywords)::double + 1e-9, 4) as similarity
    from (select post_id, claims_norm from {source} where claims_norm is not null) p cross join pool r where len(list_filter(r.anchors, lambda a: contains(p.claims_norm, a))) > 0),
best as (select post_id, record_id as best_record, ord as best_ord, similarity, rating from (select *, row_number() over (partition by post_id order by similarity desc, ord) as k from hit where similarity > 0) q where k = 1)"""


def near_sql(source: str) -> str:
    """The nearest records of each of the posts ``source``; follows ``pool_sql``."""
    hashes, vector = text_vector(DUCKDB, "t")
    made = lambda key, text, table: f"(select * from (select {key}, {vector} as v from (select {key}, t, {hashes} as hs from (select {key}, {text} as t from {table}) a) b) c where len(list_filter(v, lambda x: x <> 0)) > 0)"
    return f"""pv as {made("ord", "claim", "pool")}, cv as {made("post_id", "claims_norm", f"{source} where claims_norm is not null")},
cs as (select cv.post_id, pv.ord, row_number() over (partition by cv.post_id order by round(list_cosine_similarity(cv.v, pv.v), 4) desc, pv.ord) as k from cv cross join pv),
near as (select post_id, list(ord) as near from cs where k <= {VETO} group by post_id)"""
