"""Quality rules with language-specific perplexity bands of a character n-gram model (operator 8).

The model is an interpolated modified Kneser-Ney model of ``ORDER`` characters for each language. Tasks count distinct
n-grams; Spark sums them, derives continuation counts, discounts and interpolated probabilities order by order with
joins, and writes probabilities and back-off weights as sorted hash arrays, which workers map into memory. A text is
rejected if its log-perplexity per character lies outside its language's band, whose ends are the quartiles widened by
``WIDTH`` times their distance (at least ``FLOOR``). Model and quartiles are over all texts of the language that pass the
base rules, each distinct text once.

Null texts count as empty, a null language is a language of its own; empty texts fail the base rules; equal rows get
equal results; an empty table gives no rows. Code points
beyond 16 bits share the 6400 places of the private range. Other columns are left out.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 4
#: The band: quartiles plus and minus this many interquartile distances, of at least FLOOR (log10 per character).
WIDTH, FLOOR = 3.0, 0.02
BEGIN, END = 2, 3
GOLD = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = "#*$%&|<>"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed ``ORDER``-grams that end in each character and in the end mark, and their number for each text."""
    pad = chr(BEGIN) * (ORDER - 1)
    raw = "".join([f"{pad}{t}{chr(END)}" for t in texts]).encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(raw, np.uint32).astype(np.uint64)
    c = np.where(c > 0xFFFF, np.uint64(0xE000) + c % np.uint64(6400), c)
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
    at = np.arange(int(n.sum())) + np.repeat(begins - (np.cumsum(n) - n), n)
    g = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        g = (g << np.uint64(16)) | c[at + k]
    return g, n


def keys_of(lang: str, kind: int, g: np.ndarray) -> np.ndarray:
    """64-bit keys of a language's n-grams; ``kind`` tells order and table apart."""
    salt = np.uint64(xxhash.xxh3_64_intdigest(f"{lang}\x00{kind}"))
    with np.errstate(over="ignore"):
        return common.mix64(common.mix64(g * GOLD) + salt)


def language(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def count_grams(rows: DataFrame) -> DataFrame:
    """``(lang, g, n)`` of ``rows(lang, text)``: each task sends a gram once, however frequent it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return g, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def send(lang: str) -> pa.RecordBatch:
            g, n = merged(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "g", "n"])

        for b in common.slices(batches, 400):
            by = defaultdict(list)
            for lang, t in zip(b.column(0).to_pylist(), common.texts_of(b.column(1))):
                by[lang].append(t)
            for lang, texts in by.items():
                held[lang].append(np.unique(grams(texts)[0], return_counts=True))
                if len(held[lang]) > 30:
                    held[lang] = [merged(held[lang])]
            if sum(len(p[0]) for parts in held.values() for p in parts) > 4_000_000:
                for lang in list(held):
                    yield send(lang)
        for lang in list(held):
            yield send(lang)

    return rows.mapInArrow(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def discount(n: Column) -> Column:
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def with_discounts(level: DataFrame) -> DataFrame:
    """Add the language's discounts d1, d2, d3 to ``(lang, g, n)``."""
    c = level.groupBy("lang").agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    d = []
    for k in (1, 2, 3):
        raw = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        d.append(F.least(F.greatest(F.coalesce(raw, F.lit(k / 2)), F.lit(0.05 * k)), F.lit(0.95 * k)).alias(f"d{k}"))
    return level.join(F.broadcast(c.select("lang", *d)), "lang")  # one row a language


def model_rows(counts: DataFrame) -> list[DataFrame]:
    """``(lang, kind, g, value)``: probabilities (kind 2k for order k) and back-off weights (2k + 1, by context)."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        low = F.col("g").bitwiseAND(F.lit((1 << (16 * k)) - 1))
        levels[k] = common.materialize(levels[k + 1].groupBy("lang", low.alias("g")).agg(F.count("*").alias("n")))
    out, lower = [], None
    for k in range(1, ORDER + 1):
        level = with_discounts(levels[k]).withColumn("ctx", F.shiftrightunsigned("g", 16))
        left = F.sum(discount(F.col("n")))
        ctx = level.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), (left / F.sum("n")).alias("left"), F.count("*").alias("v"))
        own = level.join(ctx, ["lang", "ctx"]).withColumn("high", F.greatest(F.lit(0.0), F.col("n") - discount(F.col("n"))) / F.col("total"))
        if k == 1:
            p = own.select("lang", "g", (F.col("high") + F.col("left") / (F.col("v") + 1)).alias("p"))
            out.append(ctx.select("lang", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("g"), (F.col("left") / (F.col("v") + 1)).alias("value")))
        else:
            low = F.col("g").bitwiseAND(F.lit((1 << (16 * (k - 1))) - 1))
            p = own.withColumn("low", low).join(lower.select("lang", F.col("g").alias("low"), F.col("p").alias("lp")), ["lang", "low"])
            p = p.select("lang", "g", (F.col("high") + F.col("left") * F.col("lp")).alias("p"))
            out.append(ctx.select("lang", F.lit(2 * k + 1).alias("kind"), F.col("ctx").alias("g"), F.col("left").alias("value")))
        lower = common.materialize(p)
        out.append(lower.select("lang", F.lit(2 * k).alias("kind"), "g", F.col("p").alias("value")))
    return out


class CharModel:
    """The arrays of a model, in buckets by key."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.open = folder, bits, None

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "bits": self.bits, "open": None}

    def look(self, lang: str, kind: int, g: np.ndarray) -> np.ndarray:
        """Stored values, NaN for others."""
        self.open = {} if self.open is None else self.open
        keys = keys_of(lang, kind, g)
        order = np.argsort(keys)
        q, out = keys[order], np.full(len(keys), np.nan)
        cut = np.searchsorted((q >> np.uint64(64 - self.bits)).astype(np.int64), np.arange((1 << self.bits) + 1)).tolist()
        for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])):
            if i == j:
                continue
            if b not in self.open:
                path = f"{self.folder}/keys-{b:06d}.npy"
                self.open[b] = [np.load(p, mmap_mode="r") for p in (path, path.replace("keys-", "values-"))] if os.path.exists(path) else None
            if self.open[b]:
                there, values = self.open[b]
                at = np.minimum(np.searchsorted(there, q[i:j]), len(there) - 1)
                out[order[i:j]] = np.where(there[at] == q[i:j], values[at], np.nan)
        return out

    def log_probabilities(self, lang: str, g: np.ndarray) -> np.ndarray:
        """log10 of the interpolated probability of each distinct gram's last character."""
        p, weight, todo = np.full(len(g), np.nan), np.ones(len(g)), np.arange(len(g))
        for k in range(ORDER, 0, -1):
            part = g[todo] & np.uint64((1 << (16 * k)) - 1)
            found = self.look(lang, 2 * k, part)
            p[todo] = found * weight[todo]
            rest = np.isnan(found)
            todo, part = todo[rest], part[rest]
            if k > 1 and len(todo):
                left = self.look(lang, 2 * k + 1, part >> np.uint64(16))
                weight[todo] *= np.where(np.isnan(left), 1.0, left)
        if len(todo):
            floor = self.look(lang, 1, np.zeros(1, np.uint64))[0]
            p[todo] = weight[todo] * (1e-6 if np.isnan(floor) else floor)
        return np.log10(p)


def train(rows: DataFrame) -> CharModel:
    """A model of ``rows(lang, text)``."""
    spark = rows.sparkSession
    bits = common.buckets_for(spark).bit_length() - 1
    model = CharModel(common.local_path(common.shared_dir(spark)), bits)
    folder, shift = model.folder, np.uint64(64 - bits)
    tables = model_rows(common.materialize(count_grams(rows)))
    everything = tables[0]
    for t in tables[1:]:
        everything = everything.union(t)

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            key = np.zeros(len(p), np.uint64)
            for (lang, kind), at in p.groupby(["lang", "kind"]).indices.items():
                key[at] = keys_of(lang, int(kind), p["g"].to_numpy()[at].astype(np.int64).view(np.uint64))
            yield pd.DataFrame({"bucket": (key >> shift).astype(np.int32), "key": key.view(np.int64), "value": p["value"]})

    def write(key, group: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(group["key"].to_numpy().view(np.uint64))
        common.write_array(folder, f"values-{key[0]:06d}", group["value"].to_numpy()[order])
        common.write_array(folder, f"keys-{key[0]:06d}", group["key"].to_numpy().view(np.uint64)[order])
        return pd.DataFrame({"n": [len(group)]})

    everything.mapInPandas(keyed, "bucket int, key long, value double").groupBy("bucket").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return model


def rules(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    n, covered = len(words), 0
    if n > 3:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        with np.errstate(over="ignore"):
            w = common.mix64((h[:-2] * GOLD + h[1:-1]) * GOLD + h[2:])
        _, at, count = np.unique(w, return_inverse=True, return_counts=True)
        twice = count[at] > 1
        mark = np.zeros(n, bool)
        for k in range(3):
            mark[k : n - 2 + k] |= twice
        covered = int(mark.sum())
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), covered


def text_hash(lang: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=xxhash.xxh32_intdigest(lang))


def fails(n_words, n_repeat_words):
    """The base rules, on numbers or columns."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str], np.ndarray]]:
    """Languages, texts and hashes of the rows ``(lang, text)`` that pass the base rules."""
    for b in common.slices(batches, 400):
        some = [(lang, t) for lang, t in zip(b.column(0).to_pylist(), common.texts_of(b.column(1))) if not fails(*rules(t)[::4])]
        yield [x for x, _ in some], [t for _, t in some], np.array([text_hash(*x) for x in some], np.uint64)


def learned(rows: DataFrame) -> DataFrame:
    """``(lang, text)``: each distinct text of a language that passes the base rules once. Only texts with copies are shuffled."""
    repeated = common.repeated_hashes(rows, lambda batches: (h for _, _, h in passing(batches)), rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts, h in passing(batches):
            twice = repeated.contains(h)
            columns = [pa.array(langs, pa.string()), pa.array(texts, pa.string()), pa.array(h.view(np.int64)), pa.array(twice)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "text", "h", "twice"])

    found = rows.mapInArrow(run, "lang string, text string, h long, twice boolean")
    copies = found.where("twice").groupBy("lang", "h").agg(F.first("text").alias("text"))
    return found.where("not twice").select("lang", "text").union(copies.select("lang", "text"))


def measured(rows: DataFrame, model: CharModel) -> DataFrame:
    """The base measures and the log-perplexity per character of ``rows(lang, doc_id, text)``."""
    names = ["lang", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 400):
            langs, texts = b.column(0).to_pylist(), common.texts_of(b.column(2))
            by, lp = defaultdict(list), np.zeros(len(texts))
            for i, lang in enumerate(langs):
                by[lang].append(i)
            for lang, at in by.items():
                g, n = grams([texts[i] for i in at])
                distinct, back = np.unique(g, return_inverse=True)
                lp[at] = -np.add.reduceat(model.log_probabilities(lang, distinct)[back], np.cumsum(n) - n) / n
            got = list(zip(*map(rules, texts)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in got), pa.array(lp), pa.array(np.array([text_hash(*x) for x in zip(langs, texts)], np.uint64).view(np.int64))], names=names)

    return rows.select("lang", "doc_id", "text").mapInArrow(run, "lang string, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double, h long")


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base measures, ``base_failed``, ``log_perplexity``, the language's band and ``kept`` for every row."""
    rows = docs.select(language(lang_col).alias("lang"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = common.materialize(measured(rows, train(learned(rows.select("lang", "text")))))
    q = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000)
    failed = fails(F.col("n_words"), F.col("n_repeat_words"))
    distinct = scored.where(~failed).groupBy("lang", "h").agg(F.min("log_perplexity").alias("log_perplexity"))
    bands = distinct.groupBy("lang").agg(q.alias("q"))
    reach = WIDTH * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(FLOOR))
    bands = bands.select("lang", (F.col("q")[0] - reach).alias("lower"), (F.col("q")[1] + reach).alias("upper"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    out = scored.join(F.broadcast(bands), "lang", "left").withColumn("base_failed", failed)  # one row a language
    return out.withColumn("kept", ~F.col("base_failed") & inside).drop("lang", "h")


def op8_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")
