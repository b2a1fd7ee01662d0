"""Shared helpers: scratch tables in the cluster's shared folder, text batches, hashing, components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.graph import components as components
from ..scratch import materialize as materialize
from ..scratch import release as release
from ..scratch import shared_dir as shared_dir

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Ranks of the hubs that nodes are compared with; a round for each pair of ranks, each of which leaves out what is joined already.
HUBS = ((1, 2),)


def local_path(uri: str) -> str:
    """The mounted path of a shared folder, for files that workers map into memory."""
    if uri.startswith("file:"):
        path = uri[5:]
        return "/" + path.lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: memory-mapped arrays need a shared folder that is mounted on all machines")
    return uri


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_store: dict = {}


def stored(key, make):
    """What this worker keeps between batches: one thing at a time, so that nothing of a stage stays when the next one begins."""
    if key not in _store:
        _store.clear()
        _store[key] = make()
    return _store[key]


def forget() -> None:
    """Let go of what this worker has kept for an earlier stage; for stages that keep nothing themselves."""
    _store.clear()


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``rows`` rows and ``most`` bytes of strings; a longer row comes alone."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            end = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))
            end = max(at + 1, min(at + rows, end))
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many more underscores as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Write a .npy file so that a repeated task leaves one whole file."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, values)
    os.replace(part, f"{folder}/{name}.npy")


def buckets_for(spark: SparkSession) -> int:
    """A power of two near the session's number of shuffle partitions, which is chosen by the size of the data."""
    return 1 << max(2, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def emit_hashes(found: Iterator[np.ndarray], bits: int, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Rows ``(bucket, keys, many)`` of a task's 48-bit hashes, packed by bucket: each once, with a bit that tells
    whether the task has met it more than once. Memory stays within ``most`` hashes."""

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        cut = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(48 - bits))
        raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        rows = [(b, raw[i:j].tobytes(), np.packbits(n[i:j] > 1).tobytes()) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if j > i]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "keys", "many"])

    held, n = [], 0
    for h in found:
        if len(h):
            held.append(h & np.uint64(0xFFFFFFFFFFFF))
            n += len(h)
        if n > most:
            yield pack(held)
            held, n = [], 0
    if held:
        yield pack(held)


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class HashShards:
    """Sorted 48-bit hashes in files of the shared folder, one per bucket, mapped into memory by workers."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self._open = folder, bits, None

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "bits": self.bits, "_open": None}

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes are there; queries are sorted first so that reads go through the files in order."""
        if self._open is None:
            self._open = {}
        keys, back = np.unique(hashes & np.uint64(0xFFFFFFFFFFFF), return_inverse=True)
        hit = np.zeros(len(keys), bool)
        cut = np.searchsorted(keys, np.arange((1 << self.bits) + 1, dtype=np.uint64) << np.uint64(48 - self.bits))
        for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if i == j:
                continue
            if b not in self._open:
                path = f"{self.folder}/{b:06d}.npy"
                self._open[b] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, np.uint64)
            if len(there := self._open[b]):
                at = np.minimum(np.searchsorted(there, keys[i:j]), len(there) - 1)
                hit[i:j] = there[at] == keys[i:j]
        return hit[back]


def repeated_hashes(rows: DataFrame, hashes_of, spark: SparkSession) -> HashShards:
    """Which 48-bit hashes occur at least twice among all that ``hashes_of(record batches)`` yields.

    A task sends each hash once, six bytes and a bit, so a hash that fills a third of the input costs one entry a task.
    """
    bits = buckets_for(spark).bit_length() - 1
    shards = HashShards(local_path(shared_dir(spark)), bits)
    folder = shards.folder

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit_hashes(hashes_of(batches), bits)

    def meet(key, group):
        import pandas as pd

        keys = np.concatenate([unpack48(x) for x in group["keys"]])
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[: len(k) // 6] for k, m in zip(group["keys"], group["many"])])
        order = np.argsort(keys, kind="stable")
        keys, many = keys[order], many[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(first, len(keys))) + np.add.reduceat(many.astype(np.int64), first)
        write_array(folder, f"{key[0]:06d}", keys[first][n > 1])
        return pd.DataFrame({"bucket": [key[0]], "n": [int((n > 1).sum())]})

    sent = rows.mapInArrow(send, "bucket int, keys binary, many binary")
    sent.groupBy("bucket").applyInPandas(meet, "bucket int, n long").agg(F.sum("n")).collect()
    return shards


def likely(shares: np.ndarray, size: int, least: float) -> np.ndarray:
    """Whether shares of equal bytes of sketches of some size leave a similarity of ``least`` open (five standard errors)."""
    return shares >= least - 5 * (least * (1 - least) / size) ** 0.5


def rows_of(column: pa.Array) -> np.ndarray:
    """Binaries of one length as a matrix of bytes."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def likely_pairs(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sketches, of ``(node, sketch)``, leave a similarity of ``least`` open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = rows_of(b.column(2)), rows_of(b.column(3))
                yield b.select(["a", "b"]).filter(pa.array(likely((x == y).mean(axis=1), x.shape[1], least)))

    met = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
    met = met.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    return met.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def verified_pairs(pairs: DataFrame, texts, alike, block: int = 256) -> DataFrame:
    """Those of the written, distinct ``pairs(a, b)`` whose texts are alike.

    ``texts(nodes)`` gives ``(node, text)`` of the nodes; ``alike(pivots, texts, of)`` tells which texts are like the pivot
    of their number ``of``. A text travels once for each pair, with the pivot's once for about ``block`` of its partners, so
    a pivot with very many partners is dealt over many calls; small ones share a call.
    """
    import pandas as pd

    known = materialize(texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(block)).alias("k"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), "k").alias("salt"))
    members = dealt.join(known.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    pivots = dealt.select("a", "salt").distinct().join(known.withColumnRenamed("node", "a"), "a").select("a", "salt", F.col("a").alias("b"), "text")
    calls = max(1, pairs.count() // block)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(other=part["a"] != part["b"]).sort_values(["a", "salt", "other"])
        other = part["other"].to_numpy()
        of = np.cumsum(~other)[other] - 1
        some = part[other]
        good = alike(part["text"][~other].tolist(), some["text"].tolist(), of) if len(some) else np.zeros(0, bool)
        return some.loc[good, ["a", "b"]]

    both = members.union(pivots).withColumn("call", F.pmod(F.xxhash64("a", "salt"), F.lit(calls)))
    out = materialize(both.groupBy("call").applyInPandas(compare, "a long, b long"))
    release(known)
    return out


def open_pairs(keyed: DataFrame, roots: DataFrame, sketches: DataFrame, least: float, nodes_only: bool = False, block: int = 2048) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of different classes that share a key and whose sketches leave ``least`` open; or the nodes ``(a, a)``
    of such pairs.

    Only keys whose nodes are of several classes take part. Their sketches, not their texts, are compared in tasks, block by
    block where a key has more than ``block`` nodes.
    """
    import pandas as pd

    own = keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stats = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / F.lit(block)).cast("int").alias("k"))
    dealt = own.join(stats.where("lo != hi").select("key", "k"), "key").join(sketches, "node")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), "k").cast("int"))
    if not nodes_only:  # a pair comes from the least key that its nodes share
        dealt = dealt.join(keyed.groupBy("node").agg(F.collect_list("key").alias("keys")), "node")
    else:
        dealt = dealt.withColumn("keys", F.array().cast("array<long>"))
    copies = dealt.select("key", "node", "root", "sketch", "keys", "k", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 8
    call = F.when(F.col("k") == 1, F.pmod(F.xxhash64("key", F.lit(3)), F.lit(n))).otherwise(F.col("key"))
    copies = copies.select(call.alias("call"), (F.col("k") == 1).alias("small"), F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "key", "own", "node", "root", "sketch", "keys")

    def compare(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "node"])
        keys, nodes, roots_, blocks = (part[c].to_numpy() for c in ("key", "node", "root", "own"))
        sketch, out = np.frombuffer(b"".join(part["sketch"]), np.uint8).reshape(len(part), -1), []
        held = list(map(set, part["keys"]))
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
        for begin, end in zip(cut, [*cut[1:], len(keys)]):
            found: list[tuple[np.ndarray, ...]] = []
            for i in range(begin, end - 1):
                js = i + 1 + np.flatnonzero(roots_[i + 1 : end] != roots_[i])
                if key[2] != key[3]:
                    js = js[blocks[js] != blocks[i]]
                if len(js):
                    good = likely((sketch[js] == sketch[i]).mean(axis=1), sketch.shape[1], least)
                    found.append((np.full(good.sum(), i), js[good]))
            if found:
                i, j = (np.concatenate(x) for x in zip(*found))
                if nodes_only:
                    i = j = np.unique(np.concatenate([i, j]))
                else:
                    least_key = np.array([min(held[x] & held[y]) == keys[begin] for x, y in zip(i.tolist(), j.tolist())], bool)
                    i, j = i[least_key], j[least_key]
                out += zip(nodes[i].tolist(), nodes[j].tolist())
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return copies.groupBy("call", "small", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def shared_keys(keyed: DataFrame) -> DataFrame:
    """``(node, key, degree)`` of the keys with several nodes; a node's degree sums the numbers of nodes of its keys."""
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(keyed.join(several, "key"))
    out = materialize(met.join(met.groupBy("node").agg(F.sum("n").alias("degree")), "node").select("node", "key", "degree"))
    release(met)
    return out


def hubs_of(shared: DataFrame) -> DataFrame:
    """``(a, b, rank)``: the nodes ``a`` of highest degree of the keys of each node ``b``, from the highest degree down."""
    firsts = shared.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("o"))).alias("f")).select("key", (-F.col("f.o")).alias("a"), F.col("f.degree").alias("d"))
    pairs = shared.join(firsts, "key").where("node != a").select("a", F.col("node").alias("b"), "d").distinct()
    return pairs.select("a", "b", F.row_number().over(W.partitionBy("b").orderBy(F.desc("d"), "a")).alias("rank"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose nodes are of different components."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    return pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def linked(keyed: DataFrame, sketches: DataFrame, texts, alike, finer, least: float, known: DataFrame | None = None) -> DataFrame:
    """Components ``(node, root)`` of nodes that share a key of ``keyed(node, key)`` and are alike.

    A key's hub is its node of highest degree. Each node is compared with the highest of its keys' hubs, then, as far as it is
    not in their components yet, with the next ones; the components of these links (and of the ``known(a, b)``) close most
    keys. In the others all nodes of components that are still apart are compared, by ``finer`` sketches, which only they get:
    ``finer(texts)`` maps strings to rows of bytes. Pairs whose sketches rule the similarity out are not looked at further; all
    others are verified on the texts.
    """
    shared = shared_keys(keyed)
    hubs = materialize(hubs_of(shared))
    roots = links = done = None

    def meet(pairs: DataFrame) -> None:
        nonlocal roots, links, done
        if pairs.isEmpty() and roots is not None:
            return
        new = verified_pairs(pairs, texts, alike)
        links = new if links is None else links.union(new)
        done = pairs if done is None else done.union(pairs)
        roots = components(links if known is None else links.union(known))

    for least_rank, most_rank in HUBS:
        pairs = hubs.where(F.col("rank").between(least_rank, most_rank)).select("a", "b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        meet(materialize(likely_pairs(pairs if roots is None else apart(pairs, roots), sketches, least)))
    own = shared.select("node", "key")
    rest = materialize(open_pairs(own, roots, sketches, least, True).select(F.col("a").alias("node")))
    if not rest.isEmpty():
        fine = materialize(texts(rest).mapInArrow(lambda batches: sketched(batches, finer), "node long, sketch binary").dropDuplicates(["node"]))
        meet(materialize(open_pairs(own.join(rest, "node", "left_semi"), roots, fine, least).join(done, ["a", "b"], "left_anti")))
        release(fine)
    release(shared, hubs, rest)
    return roots


def sketched(batches: Iterator[pa.RecordBatch], finer) -> Iterator[pa.RecordBatch]:
    """``(node, sketch)`` of ``(node, text)``."""
    for b in slices(batches, 2000):
        rows = finer(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in rows], pa.binary())], names=["node", "sketch"])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(a.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.int64).view(np.uint64))


class PairFiles:
    """Pairs of longs in files of the shared folder, sorted by hash and mapped into memory by workers; looked up exactly."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self._open = folder, bits, {}

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "bits": self.bits, "_open": {}}

    def load(self, bucket: int) -> list[np.ndarray] | None:
        if bucket not in self._open:
            paths = [f"{self.folder}/{x}-{bucket:06d}.npy" for x in "hab"]
            self._open[bucket] = [np.load(p, mmap_mode="r") for p in paths] if os.path.exists(paths[0]) else None
        return self._open[bucket]

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair in its bucket's file, -1 if it isn't there."""
        h, out = pair_hash(a, b), np.full(len(a), -1)
        order = np.argsort(h)
        buckets = (h[order] >> np.uint64(64 - self.bits)).astype(np.int64)
        cut = np.searchsorted(buckets, np.arange((1 << self.bits) + 1)).tolist()
        for k in np.unique(buckets).tolist():
            if files := self.load(k):
                rows = order[cut[k] : cut[k + 1]]
                at = np.searchsorted(files[0], h[rows])
                while len(rows):  # pairs of equal hashes follow each other
                    at_ = np.minimum(at, len(files[0]) - 1)
                    same = (at < len(files[0])) & (files[0][at_] == h[rows])
                    hit = same & (files[1][at_] == a[rows]) & (files[2][at_] == b[rows])
                    out[rows[hit]] = at_[hit]
                    rows, at = rows[same & ~hit], at[same & ~hit] + 1
        return out


def write_pairs(folder: str, bucket: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Write a bucket's distinct pairs; gives the order in which they stand."""
    h = pair_hash(a, b)
    order = np.lexsort((b, a, h))
    for name, x in zip("bah", (b, a, h)):  # the file that is looked for comes last
        write_array(folder, f"{name}-{bucket:06d}", x[order])
    return order


def pair_files(pairs: DataFrame) -> PairFiles:
    """The distinct ``pairs(a, b)`` of longs in files, one for each bucket of their hashes."""
    import pandas as pd

    bits = buckets_for(pairs.sparkSession).bit_length() - 1
    files = PairFiles(local_path(shared_dir(pairs.sparkSession)), bits)
    folder = files.folder

    def keyed(parts: Iterator) -> Iterator:
        for p in parts:
            yield p.assign(bucket=(pair_hash(p["a"].to_numpy(), p["b"].to_numpy()) >> np.uint64(64 - bits)).astype(np.int32))

    def write(key, group):
        group = group.drop_duplicates()
        write_pairs(folder, int(key[0]), group["a"].to_numpy(), group["b"].to_numpy())
        return pd.DataFrame({"n": [len(group)]})

    pairs.select("a", "b").mapInPandas(keyed, "a long, b long, bucket int").groupBy("bucket").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return files
