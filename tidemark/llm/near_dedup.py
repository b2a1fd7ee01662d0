"""Near-duplicate documents by BagMinHash signatures of word-shingle bags (operator 4).

A text is the bag of its five-word shingles (lower case, split at white space; a shorter text is one shingle). Each
shingle with count w runs Poisson processes over the weight interval (0, w], cut at 0, 1, 2, 4, 8 ...: points have a
time, a signature position and a weight coordinate, and those above w are dropped, so equal parts of two bags share
their points. The least time at each position makes a signature whose positions agree with probability equal to the
weighted Jaccard similarity. Signatures are banded; documents that share a band form candidate groups, and members of
a group are compared block by block with the exact bag similarity. Classes are connected components of the links.

Null, empty and blank texts hold no shingle and stay alone; equal texts share a class; rows that repeat a doc_id share
its class; a null doc_id has a null class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
SIZE = BANDS * ROWS
#: Positions of the sketches of texts that coarser ones leave open.
FINE = 1024
GOLD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """A hash for each shingle of the text, in order."""
    h = word_hashes(text.lower().split())
    n = max(1, len(h) - words + 1) if len(h) else 0
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(min(words, len(h))):
            out = out * GOLD + h[k : k + n]
    return common.mix64(out)


def signature(keys: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The BagMinHash signature of distinct ``keys`` with integer ``counts``: the least time at each position."""
    least = np.full(size, np.inf)
    streams, low, width, most = [], [], [], []
    lo, hi = 0, 1
    with np.errstate(over="ignore"):
        while len(rows := np.flatnonzero(counts > lo)):
            streams.append(common.mix64(keys[rows] + np.uint64(hi) * GOLD))
            low.append(np.full(len(rows), lo, float))
            width.append(np.full(len(rows), hi - lo, float))
            most.append(counts[rows].astype(float))
            lo, hi = hi, hi * 2
        s, low, width, most = (np.concatenate(x) for x in (streams, low, width, most))
        time, step = np.zeros(len(s)), 1
        while len(s):
            each = max(1, 2 * size // len(s))
            at = np.arange(step, step + each, dtype=np.uint64)
            step += each
            key = common.mix64(s[:, None] + at[None, :] * GOLD)
            other = common.mix64(key ^ np.uint64(0xD6E8FEB86659FD93))
            # whole numbers, so that sums don't depend on how many points are taken at a time
            gap = np.ceil(-np.log(((key >> np.uint64(11)).astype(float) + 1) / 2.0**53) / width[:, None] * 2.0**36)
            times = time[:, None] + np.cumsum(gap, axis=1)
            weight = low[:, None] + (other >> np.uint64(32)).astype(float) / 2.0**32 * width[:, None]
            good = (times < least.max()) & (weight <= most[:, None])
            np.minimum.at(least, ((other & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)[good], times[good])
            time = times[:, -1]
            on = time < least.max()
            s, low, width, most, time = s[on], low[on], width[on], most[on], time[on]
    return least


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text), return_counts=True)


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, h1, h2, bands, sketch)``: a 128-bit hash of the text, its band keys, none for a text without words, and a byte
    for each position of its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        band = np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD
        for b in common.slices(batches, 500):
            h1, h2, keys, sketch = [], [], [], []
            for t in common.texts_of(b.column(1)):
                x = xxhash.xxh3_128_intdigest(t)
                h1.append((x >> 64) - (1 << 63))
                h2.append((x & (1 << 64) - 1) - (1 << 63))
                k, n = bag(t)
                if len(k):
                    bits = signature(k, n).view(np.uint64)
                    sketch.append(common.mix64(bits).astype(np.uint8).tobytes())
                    bits = bits.reshape(BANDS, ROWS)
                    with np.errstate(over="ignore"):
                        h = band.copy()
                        for c in range(ROWS):
                            h = common.mix64(h * GOLD + bits[:, c])
                    keys.append(h.view(np.int64))
                else:
                    keys.append([])
                    sketch.append(None)
            columns = [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "h1", "h2", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id long, h1 long, h2 long, bands array<long>, sketch binary")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def alike(pivots: list[str], texts: list[str], of: np.ndarray, *, least: float = SIMILARITY, counted: bool = True) -> np.ndarray:
    """Which of the texts, all with words, are like the pivot of their number: exact similarity of bags, or of sets."""

    def joined(some: list[str], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bags = [bag(t) for t in some]
        keys, n = np.concatenate([k for k, _ in bags]), np.array([len(k) for k, _ in bags])
        with np.errstate(over="ignore"):
            keys = common.mix64(keys + np.repeat(groups, n).astype(np.uint64) * GOLD)
        counts = np.concatenate([c for _, c in bags]) if counted else np.ones(len(keys), np.int64)
        return keys, counts, np.cumsum(n) - n

    k, c, at = joined(pivots, np.arange(len(pivots)))
    wholes = np.add.reduceat(c, at)
    order = np.argsort(k)
    k, c = k[order], c[order]
    mine, counts, begins = joined(texts, of)
    place = np.minimum(np.searchsorted(k, mine), len(k) - 1)
    both = np.add.reduceat(np.where(k[place] == mine, np.minimum(c[place], counts), 0), begins)
    return both >= least * (wholes[of] + np.add.reduceat(counts, begins) - both) - 1e-9


def finer(texts: list[str]) -> np.ndarray:
    """Sketches of ``FINE`` positions of texts with words."""
    return np.stack([common.mix64(signature(*bag(t), FINE).view(np.uint64)).astype(np.uint8) for t in texts])


def some_texts(rows: DataFrame):
    """A function that gives those of ``rows(node, text)`` whose node is asked for; only these are shuffled later."""

    def of(nodes: DataFrame) -> DataFrame:
        asked = common.pair_files(nodes.select(F.col("node").alias("a"), F.lit(0).cast("long").alias("b")))

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield b.filter(pa.array(asked.find(ids, np.zeros_like(ids)) >= 0))

        return rows.mapInArrow(held, "node long, text string")

    return of


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id)`` for every row, the class named by its least doc_id."""
    rows = docs.selectExpr(f"cast({id_col} as long) doc_id", f"coalesce({text_col}, '') text")
    told = rows.where("doc_id is not null")
    sketch = common.materialize(sketches(told))
    whole = sketch.where("sketch is not null")
    firsts = whole.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    same = whole.select("doc_id", "h1", "h2").join(firsts, ["h1", "h2"]).where("doc_id != first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    lead = common.materialize(whole.join(firsts.select(F.col("first").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi").select(F.col("doc_id").alias("node"), "bands", "sketch"))
    classes = common.linked(lead.select("node", F.explode("bands").alias("key")), lead.select("node", "sketch"), some_texts(told.withColumnRenamed("doc_id", "node")), alike, finer, SIMILARITY, same)
    out = rows.select("doc_id").join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
