"""Where a picture was seen first: an index of hashes of many pictures, in three views each, that posts' pictures are looked up in.

A picture is a vector of 64 numbers (of ``embeddings``), one line of it; a view is its middle part, stretched to full length.
Each view has two hashes: of differences between neighbours, and of signs. The index is kept as JSON lines, three rows a
picture, without the pictures that are held back, so that wrong matches can be counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .. import sources
from ..functions import lexicon as lx
from ..operators.similarity import BITS, NEAR, hamming_near
from ..scratch import kept, materialize, shared_dir

#: Views of an indexed picture: name, and the share of it that is seen, in percent.
VIEWS = (("tam", 100), ("merkez_%80", 80), ("merkez_%60", 60))
#: How posts show pictures, by their number in turn: the share that is seen, in percent, and how strong the noise is.
SHOWN = ((100, 0.0), (100, 0.01), (80, 0.02), (90, 0.0), (60, 0.01))
#: Pictures that are held back: those with the least hashes of their id. Bits that a hash needs to be looked up at all.
HELD, FEWEST = 100, 12
PLACES = tuple(lx.CITY_NAMES.get(c, c.capitalize()) for c in lx.CITIES)
ENTRY = StructType([StructField(n, t) for n, t in (
    ("record_id", LongType()), ("view", StringType()), ("event", StringType()), ("place", StringType()), ("first_seen", StringType()), ("dhash", StringType()), ("phash", StringType()),
)])
HEX16 = "^[0-9a-f]{16}$"


def cut(v: Column, percent: Column) -> Column:
    """The middle part of a line of numbers, stretched to its length; numbers are repeated, never mixed."""
    places = F.sequence(F.lit(0), F.lit(BITS - 1))
    begin = F.lit(BITS // 2) * (100 - percent)
    return F.transform(places, lambda i: F.element_at(v, (F.floor((begin + i * percent) / 100) + 1).cast("int")).cast("double"))


def noisy(x: Column, level: Column, seed: Column) -> Column:
    """Numbers with noise that follows from their places and a seed."""
    return F.transform(x, lambda v, i: v + level * ((i * 7 + seed * 13) % 11 - 5).cast("double"))


def packed(bits: Column) -> Column:
    """64 booleans as a long, the first one in the highest bit."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(F.when(b, 1).otherwise(0).cast("long")))


def hashes(v: Column) -> tuple[Column, Column]:
    """The hash of differences, cyclically, and the hash of signs."""
    places = F.sequence(F.lit(1), F.lit(BITS))
    return packed(F.transform(places, lambda i: F.element_at(v, (i % BITS + 1).cast("int")) > F.element_at(v, i))), packed(F.transform(v, lambda x: x > 0))


def hex_of(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def long_of(x: Column) -> Column:
    """The long of 16 hexadecimal digits, the highest bit as its sign."""
    high, low = F.conv(F.substring(x, 1, 8), 16, 10).cast("long"), F.conv(F.substring(x, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(record_id, v, event, place, first_seen)`` of all pictures; those without 64 numbers are left out."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(f"vec_id is not null and size(embedding) >= {BITS}")
    name = lambda k: F.element_at(F.lit(list(PLACES)), (F.pmod(k, F.lit(len(PLACES))) + 1).cast("int"))
    one, other = name(F.col("label") * 7), name(F.col("label") * 7 + F.col("vec_id"))
    place = F.when(F.col("vec_id") % 4 == 0, F.concat(one, F.lit("/"), other)).when(F.col("vec_id") % 4 == 1, other).otherwise(one)
    day = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("vec_id") % 900).cast("int")), "dd.MM.yyyy")
    return rows.select(F.col("vec_id").alias("record_id"), F.slice("embedding", 1, BITS).alias("v"), F.concat(F.lit("olay-"), F.col("label")).alias("event"), place.alias("place"), day.alias("first_seen"))


def held_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures that stay out of the index; a limit by an order, so no task numbers all rows."""
    return pictures(spark, sf_dir).select("record_id").distinct().orderBy(F.md5(F.col("record_id").cast("string")), "record_id").limit(HELD)


def index_rows(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Three entries a picture, with both hashes in hexadecimal."""
    kept = rows.join(held, "record_id", "left_anti")
    views = F.explode(F.array(*[F.struct(F.lit(n).alias("view"), cut(F.col("v"), F.lit(p)).alias("x")) for n, p in VIEWS]))
    seen = kept.select("*", views.alias("w")).select("record_id", "event", "place", "first_seen", "w.view", "w.x")
    d, p = hashes(F.col("x"))
    return seen.select("record_id", "view", "event", "place", "first_seen", hex_of(d).alias("dhash"), hex_of(p).alias("phash"))


def index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a source's pictures; it is made once."""
    return kept(spark, "pictures", sf_dir, lambda: saved_index(spark, index_rows(pictures(spark, sf_dir), held_ids(spark, sf_dir))))


def saved_index(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """The index as written and read again: lines that can't be read, or whose hashes aren't hexadecimal, are left out."""
    path = shared_dir(spark)
    sources.write_jsonl(entries, path)
    rows = sources.read_jsonl(spark, path, ENTRY, ["record_id", "dhash", "phash"], {"view": F.lit(VIEWS[0][0])})
    return sources.not_empty(rows.where(F.col("dhash").rlike(HEX16) & F.col("phash").rlike(HEX16)), "the index").select("*", long_of(F.col("dhash")).alias("d"), long_of(F.col("phash")).alias("p"))


def looked_up(asked: DataFrame, index: DataFrame) -> DataFrame:
    """``(id, record_id, view, kind, distance)`` of ``asked(id, d, p)``: the nearest entry within ``NEAR`` bits by the better of both hashes;
    of equal ones the hash of differences, the first record and the fullest view. Hashes with few bits are not looked up."""
    order = F.element_at(F.create_map(*[F.lit(x) for k, (n, _) in enumerate(VIEWS) for x in (n, k)]), F.col("view"))
    entries = materialize(index.select("record_id", order.alias("o"), "d", "p").withColumn("entry", F.col("record_id") * len(VIEWS) + F.col("o")))
    found = None
    for rank, kind in enumerate(("d", "p")):
        queries = asked.where(F.bit_count("d") >= FEWEST).select(F.col("id").alias("query_id"), F.lit(kind).alias("view"), F.col(kind).alias("h"))
        near = hamming_near(entries.select(F.col("entry").alias("vec_id"), F.col(kind).alias("h")), queries)
        near = near.select("query_id", "distance", F.lit(rank).alias("rank"), F.col("vec_id").alias("entry"))
        found = near if found is None else found.union(near)
    best = found.groupBy("query_id").agg(F.min(F.struct("distance", "entry", "rank")).alias("b"))
    view = F.element_at(F.lit([n for n, _ in VIEWS]), (F.pmod(F.col("b.entry"), F.lit(len(VIEWS))) + 1).cast("int"))
    record = F.floor((F.col("b.entry") - F.pmod(F.col("b.entry"), F.lit(len(VIEWS)))) / len(VIEWS))
    return best.select(F.col("query_id").alias("id"), record.alias("record_id"), view.alias("view"), F.when(F.col("b.rank") == 0, "dHash").otherwise("pHash").alias("kind"), F.col("b.distance").alias("distance"))


def shown_pictures(posts: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """``(id, d, p)`` of the posts with media: post k shows the k-th picture, counted around, or its middle."""
    media = posts.where("media_kind <> 'yok'").select("post_id", F.pmod("post_id", F.lit(max(n, 1))).alias("record_id"))
    turn = (F.pmod(F.col("post_id"), F.lit(len(SHOWN))) + 1).cast("int")
    part, level = (F.element_at(F.lit([s[k] for s in SHOWN]), turn) for k in (0, 1))
    seen = media.hint("merge").join(rows.select("record_id", "v"), "record_id").select("post_id", noisy(cut(F.col("v"), part), level, F.col("post_id")).alias("x"))
    d, p = hashes(F.col("x"))
    return seen.select(F.col("post_id").alias("id"), d.alias("d"), p.alias("p"))


def looked_up_posts(posts: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(post_id, distance, record_id, original)``: what the index says of each post's picture."""
    rows = pictures(spark, sf_dir)
    index = index_of(spark, sf_dir)
    found = looked_up(materialize(shown_pictures(posts, rows, rows.count())), index)
    places = index.where(F.col("view") == VIEWS[0][0]).select("record_id", F.col("place").alias("original"))
    return found.join(places.hint("merge"), "record_id").select(F.col("id").alias("post_id"), "distance", "record_id", "original")


def provenance_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).select("record_id", "view", "event", "place", "first_seen", "dhash", "phash")


def provenance_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of the index and those held back, each shown in five ways: how often they are found as themselves, and how often as others."""
    rows = pictures(spark, sf_dir)
    ways = F.explode(F.array(*[F.struct(F.lit(k).alias("way"), noisy(cut(F.col("v"), F.lit(p)), F.lit(e), F.col("record_id")).alias("x")) for k, (p, e) in enumerate(SHOWN)]))
    d, p = hashes(F.col("w.x"))
    held = held_ids(spark, sf_dir).withColumn("held", F.lit(True))
    asked = rows.join(held, "record_id", "left").select(F.col("record_id").alias("own"), F.coalesce("held", F.lit(False)).alias("held"), ways.alias("w"))
    asked = materialize(asked.where(F.col("held") | (F.col("own") % 20 == 0)).select("own", "held", "w.way", d.alias("d"), p.alias("p")).withColumn("id", F.col("own") * 10 + F.col("way")))
    found = asked.join(looked_up(asked.select("id", "d", "p"), index_of(spark, sf_dir)), "id", "left")
    own, any_ = F.coalesce(F.col("record_id") == F.col("own"), F.lit(False)), F.col("record_id").isNotNull()
    share = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    return found.groupBy("held", F.col("way").cast("long").alias("way")).agg(F.count("*").alias("n"), share(own, "right"), share(any_ & ~own, "wrong"))


QUERIES = {q.__name__: q for q in (provenance_index, provenance_held_out)}


def _cut_sql(v: str, percent: str) -> str:
    return f"list_transform(range({BITS}), lambda i: list_extract({v}, (({BITS // 2} * (100 - {percent}) + i * {percent}) // 100 + 1))::double)"


def _noisy_sql(x: str, level: str, seed: str) -> str:
    return f"list_transform({x}, lambda v, i: v + {level} * ((((i - 1) * 7 + {seed} * 13) % 11) - 5)::double)"


def _bits_sql(x: str) -> tuple[str, str]:
    """The hashes as strings of 64 digits."""
    joined = lambda e: f"array_to_string(list_transform(range({BITS}), lambda i: case when {e} then '1' else '0' end), '')"
    return joined(f"list_extract({x}, (i + 1) % {BITS} + 1) > list_extract({x}, i + 1)"), joined(f"list_extract({x}, i + 1) > 0")


def _hex_sql(b: str) -> str:
    return f"array_to_string(list_transform(range(16), lambda k: substr('0123456789abcdef', 1 + (8 * substr({b}, 4 * k + 1, 1)::int + 4 * substr({b}, 4 * k + 2, 1)::int + 2 * substr({b}, 4 * k + 3, 1)::int + substr({b}, 4 * k + 4, 1)::int), 1)), '')"


_names = "[" + ", ".join(f"'{p}'" for p in PLACES) + "]"
_place = lambda k: f"list_extract({_names}, ({k}) % {len(PLACES)} + 1)"
_D, _P = _bits_sql("x")
#: Pictures, the ids held back and the index's entries, as DuckDB's common table expressions.
INDEX_SQL = f"""pic as (select vec_id as record_id, embedding[1:{BITS}] as v, 'olay-' || label as event, case when vec_id % 4 = 0 then {_place('label * 7')} || '/' || {_place('label * 7 + vec_id')} when vec_id % 4 = 1 then {_place('label * 7 + vec_id')} else {_place('label * 7')} end as place,
    strftime(date '2023-01-01' + (vec_id % 900)::int, '%d.%m.%Y') as first_seen from embeddings where vec_id is not null and len(embedding) >= {BITS}),
held as (select record_id from pic order by md5(record_id::varchar), record_id limit {HELD}),
ent as (select *, {_D} as d, {_P} as p from (select pic.*, w.view, w.o, {_cut_sql('v', 'w.percent')} as x from pic cross join (values {', '.join(f"('{n}', {p}, {k})" for k, (n, p) in enumerate(VIEWS))}) w(view, percent, o) where record_id not in (select record_id from held)) q)"""


def lookup_sql(asked: str) -> str:
    """The best entry of each of ``asked(id, d, p)``, as strings of bits; follows ``INDEX_SQL``."""
    pair = lambda k, r: f"select a.id, e.record_id, e.o, {r} as rank, bit_count(xor(a.{k}::bit, e.{k}::bit))::bigint as distance from {asked} a cross join ent e where length(replace(a.d, '0', '')) >= {FEWEST}"
    return f"""dist as ({pair('d', 0)} union all {pair('p', 1)}),
nearest as (select * from (select *, row_number() over (partition by id order by distance, record_id, o, rank) as k from dist where distance <= {NEAR}) q where k = 1)"""


def posts_sql(source: str) -> str:
    """What the index says of the posts ``source``; follows ``INDEX_SQL``."""
    part, level = ("list_extract([" + ", ".join(f"{s[k]}::{t}" for s in SHOWN) + f"], post_id % {len(SHOWN)} + 1)" for k, t in ((0, "int"), (1, "double")))
    return f"""asked as (select post_id as id, {_D} as d, {_P} as p from (select post_id, {_noisy_sql(_cut_sql('v', part), level, 'post_id')} as x from (select post_id, post_id % (select count(*) from pic) as record_id from {source} where media_kind <> 'yok') m join pic using (record_id)) q),
{lookup_sql('asked')},
seen as (select id as post_id, distance, nearest.record_id, pic.place as original from nearest join pic on pic.record_id = nearest.record_id)"""


SQL = {
    "provenance_index": f"with {INDEX_SQL} select record_id, view, event, place, first_seen, {_hex_sql('d')} as dhash, {_hex_sql('p')} as phash from ent",
    "provenance_held_out": f"""with {INDEX_SQL}, a0 as (select record_id as own, record_id in (select record_id from held) as held, way, {_noisy_sql(_cut_sql('v', 'percent'), 'level', 'record_id')} as x from pic cross join (values {', '.join(f"({k}, {p}, {e}::double)" for k, (p, e) in enumerate(SHOWN))}) c(way, percent, level)),
asked as (select own, held, way, own * 10 + way as id, {_D} as d, {_P} as p from a0 where held or own % 20 = 0), {lookup_sql('asked')}
select held, way::bigint as way, count(*) as n, round(avg(case when record_id = own then 1.0::double else 0 end), 6) as right, round(avg(case when record_id <> own then 1.0::double else 0 end), 6) as wrong from asked left join nearest on nearest.id = asked.id group by held, way""",
}
