"""An interpolated modified Kneser-Ney model of words, counted in Spark and kept as sorted hash arrays (operator 5).

One pass packs each task's counts of words (64-bit hashes) and of word pairs (48 bits of each) by the bucket of the pair's
second word. A bucket's task merges them, counts in how many contexts each word was seen, and writes sorted arrays to the shared
folder; what it has learned about first words goes on, packed, to the buckets of those. Workers map the arrays into
memory to score; a batch's queries are sorted, so that reads go through the arrays in order. The model grows with the
corpus and never goes through the driver, which sees sums only.

Words are runs of bytes other than white space, A-Z in lower case; each text ends with an end token. Null texts count as
empty (the end alone); a null doc_id is learned from; repeated rows score alike; without training rows all words are
unknown; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MASK = np.uint64(0xFFFFFFFFFFFF)
END, BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in ("\x00end ", "\x00begin "))  # no word holds a space
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Hashes that a task holds before it packs them.
HELD = 2_000_000


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mix64(context * GOLD + word)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, contexts, n)``: hashes of all tokens, of what precedes each, and the number of tokens of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # A-Z and ASCII white space only
    told = split.flatten().dictionary_encode()
    number = told.indices.to_numpy()
    distinct = told.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    full = np.fromiter(map(bool, distinct), bool, len(distinct))[number]  # white space at the ends leaves empty strings
    found = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
    n = np.diff(found) + 1
    words = np.full(int(n.sum()), END, np.uint64)
    inside = np.ones(len(words), bool)
    inside[np.cumsum(n) - 1] = False
    words[inside] = hashes[number[full]]
    contexts = np.concatenate([[BEGIN], words[:-1]])
    contexts[np.cumsum(n) - n] = BEGIN
    return words, contexts, n


def pack48(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more from the numbers of entries counted 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05 * (k + 1)), (k + 1) * 0.95) for k, d in enumerate(raw))])


@dataclass
class Model:
    """Where the arrays are, and the sums."""

    folder: str
    bits: int
    n_tokens: int
    n_words: int
    n_pairs: int
    pair_discounts: list[float]
    word_discounts: list[float]
    word_spread: float


def train(docs: DataFrame) -> Model:
    """Count ``docs(text)``."""
    spark = docs.sparkSession
    bits = common.buckets_for(spark).bit_length() - 1
    folder = common.local_path(common.shared_dir(spark))
    edges = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(48 - bits)
    names = ["bucket", "words", "counts", "seconds", "firsts", "pair_counts"]
    kinds = (pa.int32(), *[pa.binary()] * 5)

    def pack(held: list[tuple]) -> pa.RecordBatch:
        words, contexts = (np.concatenate(x) for x in zip(*held))
        w, c = np.unique(words, return_counts=True)
        order = np.argsort(w & MASK, kind="stable")
        w, c, words, contexts = w[order], c[order], words & MASK, contexts & MASK
        order = np.lexsort((contexts, words))
        v, u = words[order], contexts[order]
        new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (u[1:] != u[:-1])]))
        v, u, n = v[new], u[new], np.diff(np.append(new, len(v)))
        a, b = np.searchsorted(w & MASK, edges).tolist(), np.searchsorted(v, edges).tolist()
        rows = [(k, w[a[k] : a[k + 1]].astype("<u8").tobytes(), c[a[k] : a[k + 1]].astype("<u4").tobytes(), pack48(v[b[k] : b[k + 1]]), pack48(u[b[k] : b[k + 1]]), n[b[k] : b[k + 1]].astype("<u4").tobytes()) for k in range(1 << bits) if a[k + 1] > a[k]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in common.slices(batches, 4000):
            words, contexts, _ = tokens(b.column(0))
            held.append((words, contexts))
            n += len(words)
            if n > HELD:
                yield pack(held)
                held, n = [], 0
        if held:
            yield pack(held)

    def joined(parts: pd.Series) -> bytes:
        return b"".join(parts)

    def merge(key, group: pd.DataFrame) -> pd.DataFrame:
        w, c = np.frombuffer(joined(group["words"]), "<u8"), np.frombuffer(joined(group["counts"]), "<u4")
        w, at = np.unique(w, return_inverse=True)
        c = np.bincount(at, c).astype(np.int64)
        order = np.argsort(w & MASK, kind="stable")
        w, c = w[order], c[order]
        v, u, n = common.unpack48(joined(group["seconds"])), common.unpack48(joined(group["firsts"])), np.frombuffer(joined(group["pair_counts"]), "<u4")
        order = np.lexsort((u, v))
        v, u, n = v[order], u[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (u[1:] != u[:-1])]))
        v, u, n = v[new], u[new], np.add.reduceat(n.astype(np.int64), new)
        spread = np.bincount(np.searchsorted(w & MASK, v), minlength=len(w))
        k = f"{key[0]:06d}"
        common.write_array(folder, f"word-end-{k}", w & MASK)
        common.write_array(folder, f"word-count-{k}", c)
        common.write_array(folder, f"word-spread-{k}", spread.astype(np.uint32))
        common.write_array(folder, f"word-{k}", w)
        keys = pair_key(u, v)
        order = np.argsort(keys)
        common.write_array(folder, f"pair-{k}", keys[order])
        common.write_array(folder, f"pair-count-{k}", np.minimum(n[order], 0xFFFF).astype(np.uint16) if n.max(initial=0) <= 0xFFFF else n[order].astype(np.uint32))
        first, at = np.unique(u, return_inverse=True)
        seen = np.stack([np.bincount(at, n == 1), np.bincount(at, n == 2), np.bincount(at, n >= 3), np.bincount(at, n)], axis=1).astype("<u8")
        cut = np.searchsorted(first, edges).tolist()
        rows = [(b, pack48(first[i:j]), seen[i:j].tobytes(), None) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]
        sums = [int(c.sum()), len(w), *((n == i).sum() for i in (1, 2, 3, 4)), *((spread == i).sum() for i in (1, 2, 3, 4)), int((spread >= 3).sum()), int(spread.sum())]
        return pd.DataFrame([*rows, (-1, None, None, [int(x) for x in sums])], columns=["bucket", "firsts", "seen", "sums"])

    def contexts(key, group: pd.DataFrame) -> pd.DataFrame:
        u, at = np.unique(common.unpack48(joined(group["firsts"])), return_inverse=True)
        seen = np.frombuffer(joined(group["seen"]), "<u8").reshape(-1, 4)
        out = np.stack([np.bincount(at, seen[:, i]) for i in range(4)], axis=1).astype(np.int64)
        common.write_array(folder, f"first-{key[0]:06d}", u)
        common.write_array(folder, f"first-seen-{key[0]:06d}", out)
        return pd.DataFrame({"n": [len(u)]})

    counted = docs.mapInArrow(count, "bucket int, words binary, counts binary, seconds binary, firsts binary, pair_counts binary")
    merged = common.materialize(counted.groupBy("bucket").applyInPandas(merge, "bucket int, firsts binary, seen binary, sums array<long>"))
    merged.where("bucket >= 0").groupBy("bucket").applyInPandas(contexts, "n long").agg(F.sum("n")).collect()
    sums = np.zeros(12, np.int64)
    got = merged.where("bucket < 0").select(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(12)]).first()
    if got[0] is not None:
        sums = np.array(list(got), np.int64)
    d2, d1 = discounts(sums[2:6]), discounts(sums[6:10])
    left = d1[1] * sums[6] + d1[2] * sums[7] + d1[3] * sums[10]
    return Model(folder, bits, int(sums[0]), int(sums[1]), int(sums[11]), d2.tolist(), d1.tolist(), float(left))


class Arrays:
    """The model's arrays, mapped into memory when first used."""

    def __init__(self, model: Model):
        self.m, self.open = model, {}

    def array(self, name: str, bucket: int) -> np.ndarray | None:
        if (name, bucket) not in self.open:
            path = f"{self.m.folder}/{name}-{bucket:06d}.npy"
            self.open[name, bucket] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[name, bucket]

    def look(self, table: str, buckets: np.ndarray, keys: np.ndarray, values: dict[str, int]) -> list[np.ndarray]:
        """The values (name: columns) stored for keys, 0 for others; buckets are in order and keys sorted within them."""
        out = [np.zeros((len(keys), n), np.int64) for n in values.values()]
        cut = np.searchsorted(buckets, np.arange((1 << self.m.bits) + 1)).tolist()
        for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])):
            if j > i and (there := self.array(table, b)) is not None and len(there):
                at = np.minimum(np.searchsorted(there, keys[i:j]), len(there) - 1)
                hit = np.flatnonzero(there[at] == keys[i:j])
                if not len(hit):
                    continue
                for o, name in zip(out, values):
                    o[i + hit] = self.array(name, b)[at[hit]].reshape(len(hit), -1)
        return out

    def words(self, w: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """The values of words of 64 bits, sorted by their last 48 bits, which the files are sorted by; 0 for others."""
        out, last = [np.zeros(len(w), np.int64) for _ in names], w & MASK
        cut = np.searchsorted((last >> np.uint64(48 - self.m.bits)).astype(np.int64), np.arange((1 << self.m.bits) + 1)).tolist()
        for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])):
            if j > i and (there := self.array("word", b)) is not None:
                ends, rows = self.array("word-end", b), np.arange(i, j)
                at = np.searchsorted(ends, last[rows])
                while len(rows):  # words that share 48 bits follow each other
                    k = np.minimum(at, len(ends) - 1)
                    same = (at < len(ends)) & (ends[k] == last[rows])
                    hit = same & (there[k] == w[rows])
                    for o, name in zip(out, names):
                        o[rows[hit]] = self.array(name, b)[k[hit]]
                    rows, at = rows[same & ~hit], at[same & ~hit] + 1
        return out

    def score(self, texts: pa.Array) -> list[tuple[int, int, float, float]]:
        """``(n_tokens, n_known, base_score, score)`` of each text."""
        m = self.m
        words, contexts, n = tokens(texts)
        shift = np.uint64(48 - m.bits)
        w, at = np.unique(words, return_inverse=True)
        order = np.argsort(w & MASK, kind="stable")
        count, spread = np.zeros((2, len(w)), np.int64)
        count[order], spread[order] = self.words(w[order], ("word-count", "word-spread"))
        d1, d2 = np.array(m.word_discounts), np.array(m.pair_discounts)
        uniform = 1 / (m.n_words + 1)
        low = (np.maximum(spread - d1[np.minimum(spread, 3)], 0) + m.word_spread * uniform) / m.n_pairs if m.n_pairs else np.full(len(w), uniform)
        words, contexts = words & MASK, contexts & MASK
        u, of = np.unique(contexts, return_inverse=True)
        (seen,) = self.look("first", (u >> shift).astype(np.int64), u, {"first-seen": 4})
        total = seen[:, 3]
        left = np.where(total > 0, seen[:, :3] @ d2[1:] / np.maximum(total, 1), 1.0)
        keys, buckets = pair_key(contexts, words), (words >> shift).astype(np.int64)
        order = np.lexsort((keys, buckets))
        (pairs,) = self.look("pair", buckets[order], keys[order], {"pair-count": 1})
        c = np.zeros(len(words), np.int64)
        c[order] = pairs[:, 0]
        p = np.maximum(c - d2[np.minimum(c, 3)], 0) / np.maximum(total, 1)[of] + left[of] * low[at]
        base = np.log10((count + 1.0) / (m.n_tokens + 1 * (m.n_words + 1)))[at]
        begins = np.cumsum(n) - n
        known = np.add.reduceat((count > 0)[at].astype(np.int64), begins)
        return list(zip(n.tolist(), known.tolist(), np.add.reduceat(base, begins).tolist(), np.add.reduceat(np.log10(p), begins).tolist()))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", held_out: str = "false") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``; scores are log10 probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = common.stored(("arrays", model.folder), lambda: Arrays(model))
        for b in common.slices(batches, 4000):
            got = list(zip(*arrays.score(b.column(2))))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            n, known, base, s = (pa.array(x, t) for x, t in zip(got, kinds))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, known, pa.array([model.n_tokens] * b.num_rows, pa.int64()), base, s], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.selectExpr(f"cast({id_col} as long) doc_id", f"{held_out} held_out", f"{text_col} text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = "coalesce(pmod(crc32(cast(cast(doc_id as long) as string)), 7) = 2, false)"
    return score(docs, train(docs.where(f"not {held}").select("text")), held_out=held)
