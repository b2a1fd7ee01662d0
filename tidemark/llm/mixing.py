"""Mixing sources to target weights by pivotal dependent rounding (operator 6), in DataFrame operations only.

A source's documents all have the fractional copy count target / size of the source. Whole copies are given; what is
left, a probability for each document, is rounded by pivots: two documents transfer words to each other, at random and
with unchanged expectation, until one of them holds none or all of its words. So a source's words stay as they are. Pivots
run along blocks of a few hundred documents; the one unsettled document of each block goes to the next level of the
tree, until a source has a single one, which is settled by a draw. That leaves a source off its target by up to this
document, which may be a long one; the difference is made up by up to ``EACH`` documents of each power of two of sizes, the
largest that fit first, whose copies rise or fall between 0 and ``COPIES``. All draws are hashes, so reruns agree.

A null text has size 0; a null source is a source of its own, ordered last; rows that repeat a doc_id are told apart by
their order of hash, size and source, equal rows take turns; an empty table gives no rows. ``mix`` leaves other columns out, ``mixed_rows`` keeps them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Documents of a block, on average.
BLOCK = 200
#: A document is taken at most so many times; weights of sources repeat in this order.
COPIES, WEIGHTS = 3, (1, 2, 3)
SCALE = float(1 << 53)
#: Documents of a source and power of two of sizes that may make up what the last draw leaves. A source with few documents keeps
#: a remainder of up to its smallest ones' size: 6.7 % of the target with about ten documents, 0.24 % with fifty.
EACH = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, copies: int = COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row a source.

    Sharing an excess by weight until no target is above its limit ends where target = min(limit, level * weight) with
    one level for all; sorted by limit / weight, the sources at their limit come first. The windows hold one row for
    each source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("limit", copies * F.col("source_size"))
    by = W.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("before", F.coalesce(F.sum("limit").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("rest_w", F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))).withColumn("total", F.sum("source_size").over(W.partitionBy()))
    # The level if all sources before this one, and none from it on, are at their limits; the first such one holds it.
    rows = rows.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest_w"))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct(F.row_number().over(by).alias("k"), "level"))).over(W.partitionBy())["level"])
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("limit").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def draw(*parts: Column | str, seed: int) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 11).cast("double") + 0.5) / SCALE


def settle(level: DataFrame, number: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """One level of the tree over ``(key, source, size, x)``: settled rows ``(key, up)`` and the blocks' unsettled ones.

    Within a block, documents pass in order of hash. ``held`` is the unsettled one. With it at (s, x) and the next at
    (t, y), either the next gives min(y * t, (1 - x) * s) words or takes min(x * s, (1 - y) * t).
    """
    item = F.struct(F.xxhash64("key", F.lit(seed + number)).alias("h"), "key", "size", "x")
    n = level.groupBy(F.col("source").alias("_s")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    joined = level.join(n, F.col("source").eqNullSafe(F.col("_s")))  # one row a source on the right
    blocks = joined.groupBy("source", F.pmod(F.xxhash64("key", F.lit(seed - number - 1)), "blocks").alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    last = F.struct(F.lit("").alias("key"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("x"))
    start = F.struct(last.alias("held"), F.array().cast("array<struct<key:string,up:int>>").alias("done"))

    def step(state: Column, i: Column) -> Column:
        s, x, t, y = state["held"]["size"], state["held"]["x"], i["size"], i["x"]
        give, take = F.least(y * t, (1 - x) * s), F.least(x * s, (1 - y) * t)
        up = draw(state["held"]["key"], i["key"], seed=seed) * (give + take) < take  # the held one rises
        moved = F.when(up, give).otherwise(-take)
        held_full, held_none = up & (give >= (1 - x) * s), ~up & (take >= x * s)
        x2 = F.when(held_full, 1.0).when(held_none, 0.0).otherwise(x + moved / s)
        y2 = F.when(up & ~held_full, 0.0).when(~up & ~held_none, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y - moved / t)))
        settled = held_full | held_none
        new = F.struct(F.when(settled, i["key"]).otherwise(state["held"]["key"]).alias("key"), F.when(settled, t).otherwise(s).alias("size"), F.when(settled, y2).otherwise(x2).alias("x"))
        out = F.struct(F.when(settled, state["held"]["key"]).otherwise(i["key"]).alias("key"), F.when(settled, x2).otherwise(y2).cast("int").alias("up"))
        entered = F.struct(F.struct(i["key"].alias("key"), t.alias("size"), y.alias("x")).alias("held"), state["done"].alias("done"))
        return F.when(s == 0, entered).otherwise(F.struct(new.alias("held"), F.concat(state["done"], F.array(out)).alias("done")))

    folded = common.materialize(blocks.select("source", F.aggregate("items", start, step).alias("r")))
    done = folded.select(F.explode("r.done").alias("d")).select("d.key", "d.up")
    rest = folded.select("source", "r.held.key", "r.held.size", "r.held.x")
    return done, rest


def row_key(id_: Column, text_hash: Column, source: Column) -> Column:
    """Tells rows apart that are not equal."""
    return F.concat_ws("/", F.coalesce(id_.cast("string"), F.lit("-")), text_hash, F.coalesce(F.xxhash64(source), F.lit(0)), source.isNull())


def made_up(planned: DataFrame, copies: int = COPIES) -> DataFrame:
    """``(key, change)``: copies to add or take away, so that each source's words come near its target.

    Of ``(key, source, size, target, copies)`` a bounded number of documents for each source and power of two of sizes is
    gathered; from the largest down, each changes by as many copies as the difference left still holds.
    """
    gaps = planned.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    scale = F.floor(F.log2("size"))
    order = W.partitionBy("source", scale).orderBy(F.xxhash64("key", F.lit(11)), "key")
    some = planned.where("size > 0").select("key", "source", "size", "copies", F.row_number().over(order).alias("k")).where(F.col("k") <= EACH)
    items = some.groupBy("source").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("o"), "key", "size", "copies"))).alias("items"))
    joined = items.withColumnRenamed("source", "_s").join(gaps, F.col("_s").eqNullSafe(F.col("source")))
    start = F.struct(F.col("gap"), F.array().cast("array<struct<key:string,change:int>>").alias("done"))

    def step(state: Column, i: Column) -> Column:
        fits = F.when(state["gap"] >= 0, F.floor(state["gap"] / i["size"])).otherwise(F.ceil(state["gap"] / i["size"]))
        change = F.greatest(-i["copies"], F.least(F.lit(copies) - i["copies"], fits)).cast("int")
        done = F.when(change == 0, state["done"]).otherwise(F.concat(state["done"], F.array(F.struct(i["key"].alias("key"), change.alias("change")))))
        return F.struct((state["gap"] - change * i["size"]).alias("gap"), done.alias("done"))

    return joined.select(F.explode(F.aggregate("items", start, step)["done"]).alias("d")).select("d.key", "d.change")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copies: int = COPIES, weights: tuple[int, ...] = WEIGHTS, seed: int = 5) -> DataFrame:
    """``(doc_id, size, source, source_size, target, copies, taken)`` of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("h"))
    twin = F.row_number().over(W.partitionBy("doc_id", "h", "source").orderBy("size"))  # equal rows only
    rows = common.materialize(rows.withColumn("key", F.concat_ws("/", row_key(F.col("doc_id"), F.col("h"), F.col("source")), twin)).drop("h"))
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), copies, weights)
    joined = rows.join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = common.materialize(joined.withColumn("whole", F.floor(rate).cast("int")).withColumn("x", rate - F.col("whole")))
    level, settled, number = planned.where("size > 0 and x > 0").select("key", "source", "size", "x"), [], 0
    n = level.count()
    while n:
        done, rest = settle(level, number, seed)
        settled.append(done)
        if (m := rest.count()) >= n or rest.groupBy("source").count().where("count > 1").isEmpty():
            settled.append(rest.select("key", (draw("key", seed=seed + 1) < F.col("x")).cast("int").alias("up")))
            break
        level, n, number = rest, m, number + 1
    ups = reduce(DataFrame.union, settled) if settled else planned.select("key", F.lit(0).alias("up"))
    rounded = common.materialize(planned.join(ups, "key", "left").withColumn("copies", F.col("whole") + F.coalesce("up", F.lit(0))))
    out = rounded.join(made_up(rounded, copies), "key", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "key")


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The input's rows as often as the mix takes them."""
    key, copies, n, i = common.fresh(docs, "_key", "_copies", "_n", "_i")
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    by_key = taken.groupBy(F.regexp_replace("key", "/[^/]*$", "").alias(key)).agg(F.sort_array(F.collect_list("copies")).alias(copies))
    keyed = docs.withColumn(key, row_key(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(source_col).cast("string")))
    twin = F.row_number().over(W.partitionBy(key).orderBy(F.lit(0)))  # numbers equal rows
    counted = keyed.join(by_key, key).withColumn(n, F.element_at(copies, twin)).where(F.col(n) > 0)
    return counted.withColumn(i, F.explode(F.sequence(F.lit(1), n))).select(*[f"`{c}`" for c in docs.columns])


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")
