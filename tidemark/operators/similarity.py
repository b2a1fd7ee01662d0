"""Nearest neighbours of a stated query set against all rows: by cosine over vectors, by Hamming distance over hashes.

The queries are the rows whose id is divisible by 20. For hashes, each query is looked up in four views of it, as a picture
is found again after changes: as it is, and with 4, 9 and 14 bits changed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import materialize

EVERY, K = 20, 5
#: Rows of a block of vectors and of a block of queries, which meet in a task; and the queries that it compares at a time.
ROWS, QUERIES_EACH, AT_ONCE = 16384, 8192, 512
#: Lists at most, rows that centres are fitted on, and lists that a query looks through first.
LISTS, SAMPLE, PROBES = 4096, 20_000, 8
#: Bits of a hash and the distance that still matches. Of PARTS parts of a hash, one at least differs by RADIUS bits at most.
BITS, NEAR, PARTS, RADIUS = 64, 10, 4, 2
#: A key of no pair, below those of all pairs.
NONE = np.int64(-15_000) << np.int64(32)
#: Views of a query and how many of its bits each changes.
VIEWS = {"none": 0, "crop": 4, "blur": 9, "noise": 14}


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null and embedding is not null")


def cosine_top(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, vec_id, cosine, rank)``: exact, block of queries by block of rows.

    Each pair of blocks gives its own best ``k`` a query; the best of these are ranked. Ties go to the lesser vec_id.
    """
    n_rows, n_queries = rows.count(), queries.count()
    left, right = max(1, -(-n_queries // QUERIES_EACH)), max(1, -(-n_rows // ROWS))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int, name: str) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.select(F.col("vec_id").alias(name), F.col("embedding").cast("array<double>").alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias(own), copies.alias(other))

    q, r = dealt(queries, "i", left, "j", right, "query_id"), dealt(rows, "j", right, "i", left, "vec_id")

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "cosine"]
        if q.empty or r.empty:
            return pd.DataFrame({c: [] for c in names})
        r = r.sort_values("vec_id")
        a, b = np.stack(q["v"].to_list()), np.stack(r["v"].to_list())
        ids, out = r["vec_id"].to_numpy(), []
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (a, b))
        for begin in range(0, len(a), AT_ONCE):
            likeness = np.round(a[begin : begin + AT_ONCE] @ b.T, 4)
            for i, row in zip(q["query_id"].iloc[begin : begin + AT_ONCE], likeness):
                some = np.flatnonzero(row >= np.partition(row, max(0, len(row) - k - 1))[max(0, len(row) - k - 1)])
                at = some[np.argsort(-row[some], kind="stable")][: k + 1]
                out += [(i, ids[j], row[j]) for j in at if ids[j] != i][:k]
        return pd.DataFrame(out, columns=names)

    near = q.groupBy("i", "j").cogroup(r.groupBy("i", "j")).applyInPandas(best, "query_id long, vec_id long, cosine double")
    order = W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Lists:
    """Inverted lists of unit vectors around centres, for look-ups that skip what cannot be near.

    Centres are fitted on at most ``SAMPLE`` rows; every row is in the list of its nearest centre. Lists that lie near each other make
    a block of about ``ROWS`` rows. Of a list its centre, radius and size are known to the driver, at most ``LISTS`` of them.
    """

    def __init__(self, rows: DataFrame):
        n = rows.count()
        self.dim = 0
        few = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(max(1, n // SAMPLE))) == 0).select("embedding").limit(SAMPLE).collect()
        some = unit(np.array([r.embedding for r in few], float)) if few else np.zeros((0, 1))
        self.centres = fitted_centres(some, max(1, min(LISTS, len(some), int(n**0.5))))
        centres = self.centres

        def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in (part.iloc[begin : begin + AT_ONCE] for part in parts for begin in range(0, len(part), AT_ONCE)):
                x = unit(np.stack(p["embedding"].to_list()).astype(float))
                likeness = x @ centres.T
                best = likeness.argmax(axis=1)
                yield pd.DataFrame({"vec_id": p["vec_id"], "v": list(x), "list": best.astype(np.int32), "angle": angle(likeness[np.arange(len(x)), best])})

        self.rows = materialize(rows.select("vec_id", "embedding").mapInPandas(listed, "vec_id long, v array<double>, list int, angle double"))
        told = self.rows.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # a row a list
        self.size, self.radius = np.zeros(len(centres), np.int64), np.full(len(centres), -np.inf)
        for r in told:
            self.size[r.list], self.radius[r.list] = r.n, r.radius
        self.block = np.zeros(len(centres), np.int32)
        chain = chained(centres)
        self.block[chain] = (np.cumsum(self.size[chain]) - self.size[chain]) // ROWS

    def ask(self, queries: DataFrame, wanted) -> DataFrame:
        """``(query_id, q, block, lists)`` of ``queries(query_id, q, ..)``: the lists that ``wanted(part, likeness)`` marks, by block."""
        centres, block, size = self.centres, self.block, self.size

        def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in (part.iloc[begin : begin + AT_ONCE] for part in parts for begin in range(0, len(part), AT_ONCE)):
                marked = wanted(p, angle(np.stack(p["q"].to_list()) @ centres.T)) & (size > 0)
                for b in np.unique(block[marked.any(axis=0)]).tolist():
                    own = marked & (block == b)
                    at = np.flatnonzero(own.any(axis=1))
                    yield pd.DataFrame({"query_id": p["query_id"].iloc[at], "q": p["q"].iloc[at], "block": b, "lists": [np.flatnonzero(own[k]).tolist() for k in at]})

        return queries.mapInPandas(plan, "query_id long, q array<double>, block int, lists array<int>")

    def compare(self, asked: DataFrame, k: int) -> DataFrame:
        """``(query_id, vec_id, cosine)``: of each question the best ``k`` of each part of a block, which meets at most ``QUERIES_EACH`` questions.

        A task holds the vectors of its block, its questions and ``k`` pairs for each of these, not those of each list."""
        block = F.element_at(F.lit(self.block.tolist()), F.col("list") + 1)
        parts = max(1, -(-asked.count() // max(1, QUERIES_EACH * (int(self.block.max()) + 1))))
        q = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        r = self.rows.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            own, ids = q["query_id"].to_numpy(), np.sort(r["vec_id"].to_numpy())
            kept = np.full((len(q), k), NONE)  # of each question the best keys so far
            if len(q) and len(r):
                order = np.lexsort((r["vec_id"].to_numpy(), r["list"].to_numpy()))
                x, lists = np.stack(r["v"].to_numpy()[order]), r["list"].to_numpy()[order]
                place = np.searchsorted(ids, r["vec_id"].to_numpy()[order])
                v = np.stack(q["q"].to_numpy())
                asks = np.concatenate(q["lists"].to_list())
                by_list = np.argsort(asks, kind="stable")
                asker = np.repeat(np.arange(len(q)), [len(some) for some in q["lists"]])[by_list]
                some, begins = np.unique(asks[by_list], return_index=True)
                for c, lo, hi in zip(some, begins, [*begins[1:], len(asks)]):
                    first, last = np.searchsorted(lists, [c, c + 1])
                    for begin in range(lo, hi, AT_ONCE):
                        at = asker[begin : min(hi, begin + AT_ONCE)]
                        for j in range(first, last, ROWS // 4):
                            here = slice(j, min(last, j + ROWS // 4))
                            keys = rank_keys(v[at] @ x[here].T, place[here])
                            keys[own[at][:, None] == ids[place[here]][None, :]] = NONE
                            kept[at] = largest(np.concatenate([kept[at], largest(keys, k)], axis=1), k)
            i, j = np.nonzero(kept > NONE)
            cosine, at = ranked(kept[i, j])
            return pd.DataFrame({"query_id": own[i], "vec_id": ids[at], "cosine": cosine})

        return q.groupBy("block", "part").cogroup(r.groupBy("block", "part")).applyInPandas(best, "query_id long, vec_id long, cosine double")


def rank_keys(cosine: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers that order pairs by their rounded cosine, equal ones by the lesser place."""
    return (np.rint(np.nan_to_num(cosine, nan=-2.0) * 10_000).astype(np.int64) << 32) - place


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cosines and places of such numbers."""
    cosine = -(-keys >> 32)
    return cosine / 10_000, (cosine << 32) - keys


def largest(keys: np.ndarray, k: int) -> np.ndarray:
    """Of each line the ``k`` largest, in any order."""
    return keys if keys.shape[1] <= k else np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def fitted_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; begins at evenly spaced rows, and a centre without rows stays."""
    if not len(x):
        return np.ones((1, x.shape[1]))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + AT_ONCE] @ centres.T).argmax(axis=1) for a in range(0, len(x), AT_ONCE)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        some = np.linalg.norm(sums, axis=1) > 0
        centres[some] = unit(sums[some])
    return centres


def chained(centres: np.ndarray) -> np.ndarray:
    """The centres' places, each followed by the nearest that is left."""
    likeness, left, out = centres @ centres.T, np.ones(len(centres), bool), [0]
    left[0] = False
    while left.any():
        out.append(int(np.where(left, likeness[out[-1]], -np.inf).argmax()))
        left[out[-1]] = False
    return np.array(out)


def cosine_top_listed(rows: DataFrame, queries: DataFrame, k: int = K, probes: int = PROBES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``cosine_top`` gives, exactly, and the pairs that it took: ``(result, first, asked)``.

    Each query looks through the ``probes`` lists whose centres are nearest; these alone are ``first``, the approximate answer. The
    angle of its k-th neighbour there bounds what else can count: by the triangle inequality no vector of a list is nearer than
    the list's centre less its radius. The lists that this leaves are looked through, too. ``asked(query_id, pairs)`` has the
    number of vectors that each query was compared with. Vectors that are spread evenly leave all lists, so that this is no
    more than an exact search by blocks; the more they cluster, the fewer lists are left.
    """
    lists = Lists(rows)
    asking = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    asking = materialize(asking.withColumn("length", F.greatest(length, F.lit(1e-300))).select("query_id", F.transform("v", lambda x: x / F.col("length")).alias("q")))
    size, radius = lists.size, lists.radius

    def nearest(_: pd.DataFrame, angles: np.ndarray) -> np.ndarray:
        filled = np.where(size > 0, angles, np.inf)
        some = np.argsort(filled, axis=1, kind="stable")[:, :probes]
        out = np.zeros(angles.shape, bool)
        np.put_along_axis(out, some, True, axis=1)
        return out

    def open_(part: pd.DataFrame, angles: np.ndarray) -> np.ndarray:
        reach = angle(part["least"].to_numpy()[:, None] - 6e-5)  # cosines are ranked as they are rounded
        return (angles - radius <= reach) & ~nearest(part, angles)

    order = W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    probed = materialize(lists.ask(asking, nearest))
    first = materialize(lists.compare(probed, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    bound = first.where(F.col("rank") == k).select("query_id", F.col("cosine").alias("least"))
    rest = materialize(lists.ask(asking.join(bound, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0))), open_))
    both = first.drop("rank").union(lists.compare(rest, k)) if not rest.isEmpty() else first.drop("rank")
    result = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    held = F.aggregate(F.transform("lists", lambda c: F.element_at(F.lit(size.tolist()), c + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    pairs = probed.union(rest).groupBy("query_id").agg(F.sum(held).alias("pairs"))
    return result, first, pairs


def cosine_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return cosine_top_listed(rows, rows.where(F.col("vec_id") % EVERY == 0))[0]


def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 1 and 5 and the mean reciprocal rank of the first neighbour with the query's label."""
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    top = cosine_top5(spark, sf_dir).join(labels, "vec_id")
    own = labels.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    ranks = own.join(top, "query_id", "left").groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("own"), F.col("rank"))).alias("r"))
    return ranks.agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(F.col("r") == 1, 1.0).otherwise(0.0)), 6).alias("recall_at_1"),
        F.round(F.avg(F.when(F.col("r").isNotNull(), 1.0).otherwise(0.0)), 6).alias("recall_at_5"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"),
    )


def cosine_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inverted lists save: queries, the share of all pairs that they took, and the recall of the probed lists alone."""
    rows = vectors(spark, sf_dir)
    queries = rows.where(F.col("vec_id") % EVERY == 0)
    result, first, pairs = cosine_top_listed(rows, queries)
    found = result.join(first.select("query_id", "vec_id", F.lit(1).alias("probed")), ["query_id", "vec_id"], "left")
    recall = found.agg(F.round(F.avg(F.coalesce("probed", F.lit(0)).cast("double")), 6).alias("recall_of_probes"))
    share = F.round(F.sum("pairs") / (F.count("*") * F.lit(max(1, rows.count()))), 6).alias("share_of_pairs")
    return pairs.agg(F.count("*").alias("queries"), share).crossJoin(recall)  # single rows


def sign_hash(v: Column, bits: int = BITS) -> Column:
    """A hash of 64 bits: the signs of the first numbers of a vector, the first one in the highest bit."""
    signs = F.transform(F.slice(v, 1, bits), lambda x: F.when(x > 0, 1).otherwise(0))
    return F.aggregate(signs, F.lit(0).cast("long"), lambda h, s: F.shiftleft(h, 1).bitwiseOR(s.cast("long")))


def near_keys(part: Column, radius: int = RADIUS, width: int = BITS // PARTS) -> Column:
    """All keys within ``radius`` bits of a part of a hash."""
    flips = [sum(1 << b for b in some) for r in range(radius + 1) for some in itertools.combinations(range(width), r)]
    return F.transform(F.lit(flips), lambda f: part.bitwiseXOR(f))


def hamming_near(rows: DataFrame, queries: DataFrame, near: int = NEAR) -> DataFrame:
    """``(query_id, view, vec_id, distance)`` of all pairs of ``queries(query_id, view, h)`` and ``rows(vec_id, h)`` within ``near`` bits.

    Rows are indexed by the parts of their distinct hashes, queries ask for all keys near their parts; the first part that is
    near keeps each pair once. Equal hashes, however many, meet as one and are told apart at the end. Keys are hundreds of times
    as large as the hashes that Spark judges them by, so they are joined by merging, never broadcast.
    """
    if near >= PARTS * (RADIUS + 1):
        raise ValueError(f"near must be below {PARTS * (RADIUS + 1)}")
    width = BITS // PARTS
    mask = F.lit((1 << width) - 1)

    def part(h: Column, k: int) -> Column:
        return F.shiftrightunsigned(h, k * width).bitwiseAND(mask)

    def keyed(df: DataFrame, name: str, keys) -> DataFrame:
        some = F.array(*[F.struct(F.lit(k).alias("part"), keys(part(F.col("h"), k)).alias("bits")) for k in range(PARTS)])
        return df.select(F.col("h").alias(name), F.explode(some).alias("k")).select(name, "k.part", F.explode("k.bits").alias("bits"))

    asked = keyed(queries.select("h").distinct(), "q", near_keys)
    index = keyed(rows.select("h").distinct(), "r", F.array)
    x = F.col("q").bitwiseXOR(F.col("r"))
    first = F.coalesce(*[F.when(F.bit_count(part(x, k)) <= RADIUS, k) for k in range(PARTS)])
    met = asked.hint("merge").join(index, ["part", "bits"]).where((first == F.col("part")) & (F.bit_count(x) <= near)).select("q", "r", F.bit_count(x).cast("long").alias("distance"))
    found = queries.withColumnRenamed("h", "q").join(met.hint("merge"), "q").join(rows.withColumnRenamed("h", "r").hint("merge"), "r")
    return found.select("query_id", "view", "vec_id", "distance", F.round(1 - F.col("distance") / BITS, 4).alias("similarity"))


def changed(h: Column, id_: Column, n: int) -> Column:
    """The hash with ``n`` of its bits changed, which ones depends on the id."""
    for j in range(n):
        h = h.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (63 - (7 * j + id_) % 64).cast("int")))
    return h


def hash_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All hashes, and the queries' views."""
    rows = vectors(spark, sf_dir).select("vec_id", sign_hash(F.col("embedding")).alias("h"))
    id_ = F.col("vec_id")
    views = F.array(*[F.struct(F.lit(v).alias("view"), changed(F.col("h"), id_, n).alias("h")) for v, n in VIEWS.items()])
    return rows, rows.where(id_ % EVERY == 0).select(id_.alias("query_id"), F.explode(views).alias("v")).select("query_id", "v.view", "v.h")


def hamming_within_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_near(*hash_views(spark, sf_dir))


def nearest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest record of each view, the first of equals; the distance is 999 where none is near."""
    rows, views = hash_views(spark, sf_dir)
    best = hamming_near(rows, views).groupBy("query_id", "view").agg(F.min(F.struct("distance", "vec_id")).alias("b"))
    return views.select("query_id", "view").join(best, ["query_id", "view"], "left").select("query_id", "view", F.col("b.vec_id").alias("vec_id"), F.coalesce("b.distance", F.lit(999)).cast("long").alias("distance"))


def view_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each view: how often the record itself comes first, the mean distance, and how often another one does."""
    own = F.coalesce(F.col("vec_id") == F.col("query_id"), F.lit(False))
    return nearest_records(spark, sf_dir).groupBy("view").agg(
        F.count("*").alias("n"), F.round(F.avg(own.cast("double")), 6).alias("recall_at_1"), F.round(F.avg(F.when(F.col("distance") < 999, F.col("distance"))), 6).alias("mean_distance"),
        F.round(F.avg((F.col("vec_id").isNotNull() & ~own).cast("double")), 6).alias("false_match"),
    )


def false_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with another record, told apart by whether it has the query's label (a near duplicate) or another (harmful)."""
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    found = nearest_records(spark, sf_dir).join(labels, "vec_id", "left").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    kind = F.when(F.col("vec_id").isNull(), "none").when(F.col("vec_id") == F.col("query_id"), "right").when(F.col("label") == F.col("own"), "near").otherwise("harmful")
    return found.groupBy("view", kind.alias("kind")).agg(F.count("*").alias("n"))


def distance_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of views found within each distance; 999 stands for those without a record."""
    most = F.explode(F.lit([0, 2, 4, 6, 8, 10, 12])).alias("most")
    return nearest_records(spark, sf_dir).select("*", most).groupBy("view", "most").agg(F.round(F.avg((F.col("distance") <= F.col("most")).cast("double")), 6).alias("share"))


def similarity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many right and wrong first neighbours each cosine threshold keeps; right ones have the query's label."""
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    first = cosine_top5(spark, sf_dir).where("rank = 1").join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    rows = first.select("cosine", (F.col("label") == F.col("own")).alias("right"), F.explode(F.lit([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])).alias("threshold"))
    return rows.groupBy("threshold").agg(F.count_if(F.col("right") & (F.col("cosine") >= F.col("threshold"))).alias("kept"), F.count_if("right").alias("right_total"), F.count_if(~F.col("right") & (F.col("cosine") >= F.col("threshold"))).alias("leaked"))


def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query: the best cosine, its lead over the tenth, and its distance from the mean of the best 200 in deviations."""
    rows = vectors(spark, sf_dir)
    top = cosine_top_listed(rows, rows.where(F.col("vec_id") % EVERY == 0), 200)[0]
    one = top.groupBy("query_id").agg(F.max("cosine").alias("top1"), F.max(F.when(F.col("rank") == 10, F.col("cosine"))).alias("tenth"), F.avg("cosine").alias("mean"), F.stddev_pop("cosine").alias("deviation"))
    return one.select("query_id", "top1", F.round(F.col("top1") - F.col("tenth"), 4).alias("lead"), F.round((F.col("top1") - F.col("mean")) / (F.col("deviation") + 1e-9), 4).alias("z"))


def low_information_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes in hexadecimal, and whether they have too few bits set to be matched."""
    h = sign_hash(F.col("embedding"))
    return vectors(spark, sf_dir).select("vec_id", F.lpad(F.lower(F.hex(h)), 16, "0").alias("hash"), (F.bit_count(h) < 12).alias("abstains"))


QUERIES = {q.__name__: q for q in (cosine_top5, cosine_lists, retrieval_recall, hamming_within_10, low_information_hashes, nearest_records, view_recall, false_matches, distance_sweep, similarity_sweep, separation)}
_TOP = f"""with c as (select q.vec_id as query_id, r.vec_id, round(list_cosine_similarity(q.embedding::double[], r.embedding::double[]), 4) as cosine, r.label = q.label as same
from embeddings q join embeddings r on q.vec_id <> r.vec_id where q.vec_id % {EVERY} = 0),
t as (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from c) """
_HASH = "list_reduce(list_prepend('', list_transform(embedding[1:64], lambda x: case when x > 0 then '1' else '0' end)), lambda a, b: a || b)"
#: Bit i of view n is changed if one of the first n steps of seven, from the id on, falls on it; 55 is the inverse of 7 modulo 64.
_NEAR = f"""with h as (select vec_id, {_HASH} as h from embeddings), n as (select * from (values {", ".join(f"('{v}', {n})" for v, n in VIEWS.items())}) v(view, n)),
q as (select vec_id as query_id, view, list_reduce(list_prepend('', list_transform(range(64), lambda i: case when ((i - vec_id % 64 + 64) % 64) * 55 % 64 < n then translate(substr(h, i + 1, 1), '01', '10') else substr(h, i + 1, 1) end)), lambda a, b: a || b) as h
    from h cross join n where vec_id % {EVERY} = 0),
near as (select * from (select query_id, view, h.vec_id, bit_count(xor(q.h::bit, h.h::bit))::bigint as distance from q cross join h) x where distance <= {NEAR}) """
_BEST = _NEAR + """, best as (select q.query_id, q.view, arg_min(vec_id, distance * 1000000000 + vec_id) as vec_id, coalesce(min(distance), 999) as distance from q left join near on near.query_id = q.query_id and near.view = q.view group by q.query_id, q.view) """
SQL = {
    "cosine_top5": _TOP + f"select query_id, vec_id, cosine, rank from t where rank <= {K}",
    "retrieval_recall": _TOP
    + f""", r as (select query_id, min(case when same and rank <= {K} then rank end) as r from t group by query_id)
select count(*) as n, round(avg(case when r = 1 then 1.0::double else 0.0 end), 6) as recall_at_1, round(avg(case when r is not null then 1.0::double else 0.0 end), 6) as recall_at_5,
round(avg(coalesce(1.0::double / r, 0.0::double)), 6) as mrr from r""",
    "hamming_within_10": _NEAR + "select query_id, view, vec_id, distance, round(1 - distance / 64.0::double, 4) as similarity from near",
    "nearest_records": _BEST + "select * from best",
    "view_recall": _BEST + """select view, count(*) as n, round(avg(case when vec_id = query_id then 1.0::double else 0 end), 6) as recall_at_1, round(avg(case when distance < 999 then distance end), 6) as mean_distance,
        round(avg(case when vec_id <> query_id then 1.0::double else 0 end), 6) as false_match from best group by view""",
    "false_matches": _BEST + """select view, case when b.vec_id is null then 'none' when b.vec_id = query_id then 'right' when l.label = o.label then 'near' else 'harmful' end as kind, count(*) as n
        from best b left join embeddings l on l.vec_id = b.vec_id join embeddings o on o.vec_id = query_id group by 1, 2""",
    "distance_sweep": _BEST + "select view, most, round(avg(case when distance <= most then 1.0::double else 0 end), 6) as share from best, (select unnest([0, 2, 4, 6, 8, 10, 12]) as most) m group by view, most",
    "similarity_sweep": _TOP + ", f as (select cosine, same from t where rank = 1) select threshold, count_if(same and cosine >= threshold) as kept, count_if(same) as right_total, count_if(not same and cosine >= threshold) as leaked from f, (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])::double as threshold) m group by threshold",
    "separation": _TOP + """select query_id, max(cosine) as top1, round(max(cosine) - max(case when rank = 10 then cosine end), 4) as lead, round((max(cosine) - avg(cosine)) / (stddev_pop(cosine) + 1e-9), 4) as z from t where rank <= 200 group by query_id""",
    "low_information_hashes": f"""with h as (select vec_id, {_HASH} as h from embeddings)
select vec_id, list_reduce(list_prepend('', list_transform(range(16), lambda k: substr('0123456789abcdef', 1 + (substr(h, k * 4 + 1, 1)::int * 8 + substr(h, k * 4 + 2, 1)::int * 4 + substr(h, k * 4 + 3, 1)::int * 2 + substr(h, k * 4 + 4, 1)::int), 1))), lambda a, b: a || b) as hash,
length(replace(h, '0', '')) < 12 as abstains from h""",
}
