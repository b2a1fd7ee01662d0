"""Near-duplicate vectors (operator 11): cross-polytope hashing after fast Hadamard rotations, probed buckets, verified pairs.

A rotation changes signs at random and applies the Walsh-Hadamard transform, three times; the vector's hash is the number of
the largest coordinate and its sign. A table joins several of them; a vector is put into its own bucket and into those of the
next likely hashes, in order of how little is missing to them. How many hashes, probes and tables there are follows from the number
of vectors and the dimension: buckets exceed vectors 32 times, and a pair at the threshold is missed with a probability
below ``MISS``, which is estimated on random pairs at the threshold, not on the data.

Equal vectors are one node with a weight. Keys of buckets are hashed to 48 bits, and only those that several nodes have
are emitted; of buckets with the same members one is looked at. A bucket's nodes are compared by matrix products, block by block
where there are more than ``BLOCK``; a pair counts in the least bucket that both have, so each is counted once, and pairs
are never emitted: a block gives each node's number of links and its local component. All links are exact: no cosine below
the threshold is one.

Vectors that are null, empty, zero, or hold null or non-finite components, link with nothing, nor do vectors of different lengths.
Rows that repeat a vec_id are vectors of their own; a null vec_id is never the least, and where all of a component are null
its id is null; vectors of any length are taken whole; an empty table gives no rows; other columns, whatever they are
called, are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST, MISS = 0.95, 1e-4
#: Buckets of a table for each vector; nodes of a block; rows of small buckets that share a call.
SPARSE, BLOCK, CALL = 32, 2048, 8192
#: Coordinates of a rotation that probes choose from, and how many of a table's hashes a probe changes at most.
NEXT, CHANGES = 3, 2


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows whose length is a power of two."""
    n, size = x.shape
    h = 1
    while h < size:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, size)
        h *= 2
    return x / np.sqrt(size)


@functools.lru_cache(maxsize=4096)
def signs(size: int, number: int) -> np.ndarray:
    """Three rows of random signs, the same on every machine."""
    bits = common.mix64(np.arange(3 * size, dtype=np.uint64) + np.uint64((number + 1) << 24)) & np.uint64(1)
    return (1.0 - 2.0 * bits.astype(np.float64)).reshape(3, size)


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    for s in signs(x.shape[1], number):
        x = hadamard(x * s)
    return x


def padded(dim: int) -> int:
    """A power of two from the dimension on, and at least 16: few coordinates have few different rotations."""
    return 1 << max(4, int(dim - 1).bit_length())


@functools.lru_cache(maxsize=64)
def changes(hashes: int, choices: int) -> np.ndarray:
    """Which coordinate, from the largest down, each of a table's hashes takes, for its own bucket and all probes."""
    return np.array([c for c in itertools.product(range(choices), repeat=hashes) if sum(map(bool, c)) <= CHANGES])


def bucket_keys(x: np.ndarray, hashes: int, probes: int, tables: int) -> np.ndarray:
    """The 48-bit keys of ``tables * probes`` buckets of each row of unit vectors."""
    size = padded(x.shape[1])
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    combos = changes(hashes, NEXT)
    out = np.empty((len(x), tables * probes), np.uint64)
    for t in range(tables):
        codes, misses = np.zeros((len(x), len(combos)), np.uint64), np.zeros((len(x), len(combos)))
        for k in range(hashes):
            y = rotated(x, t * hashes + k)
            top = np.argpartition(-np.abs(y), NEXT - 1, axis=1)[:, :NEXT]
            value = np.take_along_axis(y, top, 1)
            order = np.argsort(-np.abs(value), axis=1, kind="stable")
            top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
            face = (2 * top + (value < 0)).astype(np.uint64)
            lack = (np.abs(value[:, :1]) - np.abs(value)) ** 2
            with np.errstate(over="ignore"):
                codes = codes * np.uint64(2 * size) + face[:, combos[:, k]]
            misses += lack[:, combos[:, k]]
        best = np.argsort(misses, axis=1, kind="stable")[:, :probes]
        with np.errstate(over="ignore"):
            keys = common.mix64(np.take_along_axis(codes, best, 1) + common.mix64(np.array([t + 1], np.uint64)))
        out[:, t * probes : (t + 1) * probes] = keys & np.uint64(0xFFFFFFFFFFFF)
    return out


@functools.lru_cache(maxsize=64)
def tuned(dim: int, hashes: int, least: float, miss: float) -> tuple[int, int, int]:
    """``(hashes, probes, tables)`` with the least work, a rotation as two keys, that miss a pair at the threshold with a probability
    below ``miss``."""
    rng = np.random.default_rng(dim)
    x, z = rng.normal(size=(2, 2000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = least * x + np.sqrt(1 - least * least) * z
    best: tuple | None = None
    for probes in (1, 2, 4, 8, 16, 32):
        if probes > len(changes(hashes, NEXT)):
            break
        a, b = bucket_keys(x, hashes, probes, 1), bucket_keys(y, hashes, probes, 1)
        met = sum((a == b[:, k : k + 1]).any(axis=1) for k in range(probes)) > 0
        share = min(max(met.mean() - 2 * (0.25 / len(x)) ** 0.5, 0.01), 0.999)  # two standard errors on the safe side
        tables = int(np.ceil(np.log(miss) / np.log(1 - share)))
        work = tables * (probes + 2 * hashes)
        if best is None or work < best[0]:
            best = (work, (hashes, probes, tables))
    return best[1]


def setting(dim: int, n: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int, int]:
    """Hashes a table, probes and tables for ``n`` vectors of a length."""
    faces = 2 * padded(dim)
    hashes = 1
    while faces**hashes < SPARSE * n and hashes < 8:
        hashes += 1
    return tuned(dim, hashes, least, miss)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square is too large or too small."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and unit vectors of an Arrow list column without nulls, for each length of vectors."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        some = column if len(at) == len(column) else column.take(pa.array(at))
        yield at, unit(some.flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim))


def rows_at_once(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def compared(part: pd.DataFrame, settings: dict[int, tuple[int, int, int]], least: float) -> pd.DataFrame:
    """``(node, n, root)`` of the rows ``(key, node, m, v, own, side)`` of some buckets: how many vectors each node links to in the pairs
    that count here, and the least node of its local component; of a pair of blocks only pairs across them."""
    part = part.sort_values(["key", "node"], kind="stable")
    keys, nodes, weights, own, cross = (part[c].to_numpy() for c in ("key", "node", "m", "own", "cross"))
    vectors, lengths, out = part["v"].to_list(), np.array([len(v) for v in part["v"]]), []
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
    for begin, end in zip(cut, [*cut[1:], len(keys)]):
        for dim in np.unique(lengths[begin:end]).tolist():
            at = begin + np.flatnonzero(lengths[begin:end] == dim)
            if len(at) < 2:
                continue
            x = unit(np.stack([vectors[k] for k in at]))
            linked = x @ x.T >= least
            np.fill_diagonal(linked, False)
            if cross[begin]:
                linked &= own[at][:, None] != own[at][None, :]
            some = np.flatnonzero(linked.any(axis=1))
            if not len(some):
                continue
            at, x, linked = at[some], x[some], linked[np.ix_(some, some)]
            counts = linked & ~met_before(bucket_keys(x, *settings[dim]), np.uint64(keys[begin]), linked)
            label = np.arange(len(at))
            while True:  # the least reachable place, halved by pointers
                nearer = np.minimum(label, np.where(linked, label[None, :], len(at)).min(axis=1))
                nearer = nearer[nearer]
                if (nearer == label).all():
                    break
                label = nearer
            out.append(pd.DataFrame({"node": nodes[at], "n": (counts * weights[at][None, :]).sum(axis=1), "root": nodes[at][label]}))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("node", "n", "root")})


def met_before(keys: np.ndarray, key: np.uint64, wanted: np.ndarray, few: int = 50_000) -> np.ndarray:
    """Which of the ``wanted`` pairs of rows share a key that is less than ``key``; the most frequent keys settle most pairs, the ``few``
    that are left are looked at one by one."""
    row, column = np.nonzero(keys < key)
    codes, code, often = np.unique(keys[row, column], return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    order = order[: int((often > 1).sum())]
    place = np.full(len(codes), -1)
    place[order] = np.arange(len(order))
    place, out = place[code], np.zeros((len(keys), len(keys)), bool)
    begin, wide = 0, 64
    while begin < len(order):
        open_ = wanted & ~out
        left = int(open_.sum())
        if not left:
            break
        if left <= few:
            i, j = np.nonzero(open_)
            for k in range(0, left, 2048):
                a, b = keys[i[k : k + 2048]], keys[j[k : k + 2048]]
                out[i[k : k + 2048], j[k : k + 2048]] = ((a[:, :, None] == b[:, None, :]) & (a < key)[:, :, None]).any(axis=(1, 2))
            break
        mine = (place >= begin) & (place < begin + wide)
        has = np.zeros((len(keys), min(wide, len(order) - begin)), np.float32)
        has[row[mine], place[mine] - begin] = 1
        out |= has @ has.T > 0
        begin, wide = begin + wide, min(2048, 4 * wide)
    return out


def linked_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, miss: float = MISS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each row."""
    spark = rows.sparkSession
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    keyed = rows.select(F.col(id_col).alias("vec_id"), v.alias("v"), *[F.when(sound, F.xxhash64(v, F.lit(k))).alias(f"h{k}") for k in (1, 2)])
    distinct = keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("m"), F.min("vec_id").alias("least_id"))
    nodes = common.materialize(distinct.withColumn("node", F.monotonically_increasing_id()))
    settings = {r.dim: setting(r.dim, r.n, least, miss) for r in nodes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row a length

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in rows_at_once(batches):
            for _, x in by_length(b.column(0)):
                yield bucket_keys(x, *settings[x.shape[1]]).ravel()

    several = common.repeated_hashes(nodes.select("v"), hashes, spark)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_at_once(batches):
            node = b.column(0).to_numpy()
            for at, x in by_length(b.column(1)):
                keys = bucket_keys(x, *settings[x.shape[1]])
                row, k = np.nonzero(several.contains(keys.ravel()).reshape(keys.shape))
                yield pa.RecordBatch.from_arrays([pa.array(node[at][row]), pa.array(keys[row, k].astype(np.int64))], names=["node", "key"])

    met = common.materialize(nodes.select("node", "v").mapInArrow(shared, "node long, key long").distinct())
    members = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    chosen = met.groupBy("key").agg(members.alias("s")).where("s.n > 1").groupBy("s").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("s.n") / BLOCK).cast("int").alias("k"))
    dealt = met.join(chosen, "key").join(nodes.select("node", "v", "m"), "node").withColumn("own", F.pmod(F.xxhash64("node"), "k").cast("int"))
    calls = max(1, met.count() // CALL)
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    call = F.when(F.col("k") == 1, F.pmod(F.xxhash64("key", F.lit(3)), F.lit(calls))).otherwise(F.col("key"))
    dealt = dealt.select(call.alias("call"), (F.col("k") == 1).alias("small"), F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "key", "node", "m", "v", "own", (F.col("own") != F.col("o")).alias("cross"))
    found = common.materialize(dealt.groupBy("call", "small", "i", "j").applyInPandas(lambda part: compared(part, settings, least), "node long, n long, root long"))

    degrees = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = common.components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("h1", "h2", "node", "m", "least_id").join(degrees, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = known.join(ids, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op11_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
