"""Best-fit packing of documents into sequences by length patterns (operator 2).

Spark tokenises each text once and keeps only the lengths of its pieces. The histogram of lengths, at most ``capacity``
numbers whatever the input, goes to the driver, which enumerates full patterns of two to four lengths, fits their repeat
counts to the histogram by non-negative least squares, rounds down, and packs what is left best-fit decreasing. Pairs are
enumerated for all lengths, triples for the 48 lengths that hold the most tokens, fours for every fourth of these by length;
other lengths reach their places through pairs and the best-fit step, so no piece is left out. The plan is a table of intervals: pieces of one length, numbered in Spark by salted ranks, fall into its slots.

Null texts count as empty (a single end token); repeated rows, also of one doc_id, each get a place; an empty table
gives no rows. Other columns of the input are left out, so their names cannot clash.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

MODEL = "word_bpe_49k.json"
CAPACITY = 2048
#: Bytes of words that a worker keeps; beyond this the store is begun anew.
KEPT = 4 << 20
#: Stands between words as one token, so that their ids are told apart without offsets.
MARK = "\x01"


class WordIds:
    """Token ids of texts under a tokenizer that drops white space: ids of a text are those of its words.

    Words are told apart and numbered by Arrow for each batch; only the batch's distinct words are looked up.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.begins, self.ids, self.size = [np.zeros(2, np.int64)], [np.zeros(0, np.uint32)], 0

    def ids_of(self, block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and where each word's end."""
        got = self.tokenizer.encode_batch_fast([f" {MARK} ".join(block)], add_special_tokens=False)[0]
        ids = np.array(got.ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark[0])
        if len(self.mark) == 1 and len(marks) == len(block) - 1:  # no word holds the mark
            return np.delete(ids, marks), np.append(marks - np.arange(len(marks)), len(ids) - len(marks))
        got = self.tokenizer.encode(" ".join(block), add_special_tokens=False)
        begins = np.array([o[0] for o in got.offsets], np.int64)
        return np.array(got.ids, np.uint32), np.searchsorted(begins, np.cumsum([len(w) + 1 for w in block]))

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 500):
            block = words[at : at + 500]
            ids, ends = self.ids_of(block)
            self.begins.append(self.begins[-1][-1] + ends)
            self.ids.append(ids)
            self.number.update(zip(block, range(len(self.number), len(self.number) + len(block))))
            self.size += sum(map(len, block)) + len(block)
        self.begins, self.ids = [np.concatenate(self.begins)], [np.concatenate(self.ids)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin and the last one's end; null is empty."""
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        if len(words) == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        told = words.flatten().dictionary_encode()
        distinct = told.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.number]
        if new:
            if self.size > KEPT:
                self.reset()
                new = [w for w in distinct if w]
            self.learn(new)
        begins, ids = self.begins[0], self.ids[0]
        word = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[told.indices.to_numpy()]
        n = begins[word + 1] - begins[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat(begins[word] - ends[:-1], n) + np.arange(ends[-1])]
        return out, ends[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])]


def encoder(file: str) -> WordIds:
    return common.stored(("words", file), lambda: WordIds(file))


def pieces(docs: DataFrame, file: str, capacity: int = CAPACITY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each text's ids and a final 0, cut only where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for b in common.slices(batches, 5000):
            rows = []
            ids, begins = enc.encode(b.column(1))
            raw = memoryview(ids.astype("<u4").tobytes())
            for i, at, end in zip(b.column(0).to_pylist(), begins[:-1].tolist(), begins[1:].tolist()):
                n = end - at + 1  # with the 0 at the end
                for k, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    crc = zlib.crc32(raw[4 * (at + start) : 4 * min(at + start + length, end)])
                    rows.append((i, k, start, length, zlib.crc32(b"\0\0\0\0", crc) if start + length == n else crc))
            out = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.selectExpr(f"cast({id_col} as long) doc_id", f"{text_col} text").mapInArrow(run, schema)


def patterns(hist: np.ndarray, capacity: int, heavy: int = 48) -> list[tuple[int, ...]]:
    """Length patterns that fill a sequence exactly: all pairs, and triples and fours led by the heaviest lengths."""
    have = np.flatnonzero(hist).tolist()
    there = set(have)
    out = [(capacity,)] if capacity in there else []
    out += [(capacity - a, a) for a in have if 2 * a <= capacity and capacity - a in there]
    top = sorted(sorted(have, key=lambda n: (-hist[n] * n, n))[:heavy])
    triples = {tuple(sorted((a, b, capacity - a - b), reverse=True)) for a in top for b in top if a + b < capacity and capacity - a - b in there}
    few = top[:: max(1, len(top) // 12)]
    fours = {tuple(sorted((a, b, c, capacity - a - b - c), reverse=True)) for a in few for b in few for c in few if a + b + c < capacity and capacity - a - b - c in there}
    return list(dict.fromkeys(out + sorted(triples) + sorted(fours)))


def fit(hist: np.ndarray, found: list[tuple[int, ...]], sweeps: int = 40) -> np.ndarray:
    """Non-negative least squares of the patterns' repeat counts against the histogram, by coordinate descent."""
    rest, x = hist.astype(float), np.zeros(len(found))
    columns = [(np.array(sorted(set(p))), np.array([p.count(n) for n in sorted(set(p))], float)) for p in found]
    for _ in range(sweeps):
        moved = 0.0
        for k, (at, m) in enumerate(columns):
            step = max(-x[k], float(m @ rest[at]) / float(m @ m))
            if step:
                x[k] += step
                rest[at] -= step * m
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``(pattern, repeats)`` that use each length exactly ``hist[length]`` times."""
    rest, out = hist.astype(np.int64).copy(), []
    found = patterns(rest, capacity)
    for p, x in zip(found, fit(rest, found)):
        need = Counter(p)
        n = min(int(x), *(int(rest[k]) // m for k, m in need.items()))
        if n > 0:
            out.append((p, n))
            for k, m in need.items():
                rest[k] -= n * m
    # The rest best-fit decreasing, whole groups of equal sequences at a time.
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # room -> [(pattern, repeats)]
    for length in range(capacity, 0, -1):
        left = int(rest[length])
        while left:
            room = next((r for r in range(length, capacity) if groups.get(r)), None)
            if room is None:
                each = capacity // length
                full, part = divmod(left, each)
                if full:
                    groups[capacity - each * length].append(((length,) * each, full))
                if part:
                    groups[capacity - part * length].append(((length,) * part, 1))
                left = 0
                continue
            pattern, n = groups[room].pop()
            each = min(room // length, left)
            take = min(n, left // each)
            if take < n:
                groups[room].append((pattern, n - take))
            groups[room - each * length].append((pattern + (length,) * each, take))
            left -= take * each
    return out + [x for r in sorted(groups) for x in groups[r]]


def intervals(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, repeats' slots, first sequence and offsets of each plan entry that uses the length."""
    rows, used, base = defaultdict(list), Counter(), 0
    for pattern, n in planned:
        offsets = defaultdict(list)
        at = 0
        for k in pattern:
            offsets[k].append(at)
            at += k
        for k, o in offsets.items():
            rows[k].append((used[k], len(o), base, o))
            used[k] += n * len(o)
        base += n
    out = {}
    for k, r in rows.items():
        table = np.zeros((len(r), max(x[1] for x in r)), np.int64)
        for i, x in enumerate(r):
            table[i, : x[1]] = x[3]
        out[k] = (*(np.array([x[i] for x in r], np.int64) for i in range(3)), table)
    return out


def numbered(rows: DataFrame, key: str, order: list[str], per_group: int = 20_000) -> DataFrame:
    """Add ``rank``, from 0 without gaps within ``key``: ranks within salted groups plus the groups' offsets."""
    salts = max(1, rows.count() // per_group)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy(key, "_salt").orderBy(*order))
    ranked = salted.withColumn("_within", within)
    return ranked.join(offsets, [key, "_salt"]).withColumn("rank", F.col("_within") - 1 + F.col("_before")).drop("_salt", "_within", "_before")


def pack(docs: DataFrame, file: str, capacity: int = CAPACITY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all texts with ``sequence_id`` and ``offset``; sequences have no gaps."""
    cut = common.materialize(pieces(docs, file, capacity, id_col=id_col, text_col=text_col))
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        hist[length] = n
    table = intervals(plan(hist, capacity))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            sequence, offset = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            lengths, ranks = p["length"].to_numpy(), p["rank"].to_numpy()
            for k in np.unique(lengths):
                first, slots, base, offsets = table[int(k)]
                rows = np.flatnonzero(lengths == k)
                e = np.searchsorted(first, ranks[rows], "right") - 1
                repeat, slot = np.divmod(ranks[rows] - first[e], slots[e])
                sequence[rows], offset[rows] = base[e] + repeat, offsets[e, slot]
            yield p.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    ranked = numbered(cut, "length", ["doc_id", "piece", "ids_crc32"])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, schema)


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir), public_tokenizers.path(MODEL))
