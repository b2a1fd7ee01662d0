"""Repeated paragraphs across documents by MinHash banding (operator 10).

Paragraphs are lines, compared whole, and the sentences in them: lines are cut after ``.``, ``!`` or ``?`` before white
space, so a passage that was set into the middle of a line still holds whole units. A unit of at least ``LEAST`` words is
compared with those of its level, as sets of five-word shingles. A unit of fewer words has at most three shingles, so no
other set but the same one can reach a similarity of 0.8: shorter sentences are alike if their words are equal, which
settles shorter lines too. The number of bands of ``ROWS`` hashes follows from the recall asked for at that similarity.
Units of equal words are told by a hash and met first; only the first of each kind is banded, and kept if a band key of it
occurs twice anywhere (packed counting, then a look-up in mapped files). Units that share a key are candidates, verified by
the exact Jaccard similarity (see ``common.linked``); components of the links are classes. Of each class the first unit
(least document, then place) stays, of sentences the first whose line stays. Places number the sentences; a line that goes
takes all its sentences with it.

White space is that of ASCII. Null, empty and blank texts have no paragraphs; rows that repeat a doc_id count as one document and each get its result;
a null doc_id gets a result without removals; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .near_dedup import GOLD, alike, word_hashes

WORDS, SIMILARITY, LEAST = 5, 0.8, 8
#: Hashes of a band, and the share of pairs at the least similarity that must share a band.
ROWS, RECALL = 3, 0.998


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The least number of bands that reaches the recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


BANDS = bands_for(SIMILARITY, RECALL, ROWS)
SPACE = "[ \\t\\x0b\\f\\r]+"
CUT = re.compile(f"((?<=[.!?]){SPACE}|\\n+)")
#: Bytes of a sketch, by which candidates are ruled out.
SKETCH, FINE = 128, 1024
_factors = common.mix64(np.arange(31, 31 + FINE, dtype=np.uint64) * GOLD) | np.uint64(1)


def units(text: str) -> list[tuple[str, str]]:
    """The paragraphs of a text, each with what follows it; joined they give the text again."""
    parts = CUT.split(text)
    parts.append("")
    return list(zip(parts[0::2], parts[1::2]))


def normal(texts: pa.Array) -> pa.Array:
    """The words in lower case with one space between them."""
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), "[ \\t\\n\\x0b\\f\\r]+", " "), " ")


def numbers(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(np.int64)


class Units:
    """The units of some texts, level by level: 0 for sentences, 1 for lines of at least ``least`` words. Of each: the number of
    its text, its places (the first one in ``place``), its words as a normal string and their number."""

    def __init__(self, texts: pa.Array, least: int):
        t = pc.replace_substring(pc.fill_null(texts, ""), "\x1f", "\x1e")
        t = pc.replace_substring_regex(pc.replace_substring_regex(t, "\\n+", "\n"), f"([.!?]){SPACE}", "\\1\x1f")
        lines = pc.split_pattern(t, "\n")
        each = pc.split_pattern(lines.flatten(), "\x1f")
        n_lines, n_each = numbers(pc.list_value_length(lines)), numbers(pc.list_value_length(each))
        line_text = np.repeat(np.arange(len(t)), n_lines)
        line = np.repeat(np.arange(len(n_each)), n_each)
        of = line_text[line]
        begins = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(t)))])[:-1]
        place = np.arange(len(of)) - begins[of]
        words = normal(each.flatten())
        full = numbers(pc.binary_length(words)) > 0
        words = words.filter(pa.array(full))
        of, place, line = of[full], place[full], line[full]
        whole = normal(pc.replace_substring(lines.flatten(), "\x1f", " "))
        count = numbers(pc.count_substring(whole, " ")) + 1
        long = np.flatnonzero((count >= least) & (numbers(pc.binary_length(whole)) > 0))
        ends = np.cumsum(np.bincount(line, minlength=len(n_each)))
        first = np.concatenate([[0], ends])[:-1]
        inside = np.isin(line, long)
        self.text, self.place = [of, line_text[long]], [place, place[first[long]]]
        self.words = [words, whole.take(pa.array(long))]
        self.count = [numbers(pc.count_substring(words, " ")) + 1, count[long]]
        one, many = np.arange(len(place) + 1), np.concatenate([[0], np.cumsum((ends - first)[long])])
        self.places = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, pa.int32())) for o, v in ((one, place), (many, place[inside]))]


def code(place, level):
    return 2 * place + level


def least_hashes(units: pa.Array, n_hashes: int) -> np.ndarray:
    """The least hashes of the shingles of units of at least five words, given as normal strings; a row each."""
    if not len(units):
        return np.zeros((0, n_hashes), np.uint64)
    words = pc.split_pattern(units, " ")
    told = words.flatten().dictionary_encode()
    h, sizes = word_hashes(told.dictionary.to_pylist())[told.indices.to_numpy()], numbers(pc.list_value_length(words))
    n = len(h) - WORDS + 1
    with np.errstate(over="ignore"):
        s = np.zeros(n, np.uint64)
        for k in range(WORDS):
            s = s * GOLD + h[k : k + n]
        begins = np.cumsum(sizes) - sizes
        kept = np.ones(n, bool)
        for k in range(1, WORDS):
            ends = begins + sizes - k
            kept[ends[ends < n]] = False
        s = common.mix64(s[kept])
        counts = sizes - WORDS + 1
        at = np.cumsum(counts) - counts
        out = np.empty((len(units), n_hashes), np.uint64)
        for k, f in enumerate(_factors[:n_hashes]):
            out[:, k] = np.minimum.reduceat(s * f, at)
        return out


def band_keys(units: pa.Array, level: int) -> np.ndarray:
    least = least_hashes(units, BANDS * ROWS)
    with np.errstate(over="ignore"):
        keys = np.zeros((len(units), 1), np.uint64) + np.uint64(level) * GOLD + np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            keys = common.mix64(keys * GOLD + least[:, k::ROWS])
    return keys


def unit_rows(rows: DataFrame, least: int) -> DataFrame:
    """``(doc_id, places, level, unit, short, words)`` of every unit: ``unit`` hashes its words and its level, ``short`` holds more
    of a short one's hash, as its words are not compared later. Lines with fewer words are settled by their sentences."""
    names = ["doc_id", "places", "level", "unit", "short", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 5000):
            found = Units(b.column(1), least)
            for level in (0, 1):
                n = found.count[level]
                x = [xxhash.xxh3_128_intdigest(w, seed=level) for w in found.words[level].to_pylist()]
                unit = np.fromiter((h >> 64 for h in x), np.uint64, len(x)).view(np.int64)
                short = np.where(n >= least, 0, np.fromiter((h & 0xFFFFFFFFFFFF for h in x), np.int64, len(x)))
                ids = b.column(0).take(pa.array(found.text[level]))
                yield pa.RecordBatch.from_arrays([ids, found.places[level], pa.array(np.full(len(x), level, np.int32)), pa.array(unit), pa.array(short), pa.array(n.astype(np.int32))], names=names)

    return rows.mapInArrow(run, "doc_id long, places array<int>, level int, unit long, short long, words int")


def near_units(rows: DataFrame, kinds: DataFrame, least: int) -> DataFrame:
    """Classes ``(node, root)`` of the kinds of units, which ``kinds(unit, level, words, first)`` lists with their first ones."""
    leads = common.pair_files(kinds.where(F.col("words") >= least).select(F.col("first.doc_id").alias("a"), code(F.col("first.places")[0].cast("long"), F.col("level")).alias("b")))

    def units_of(b: pa.RecordBatch, wanted: common.PairFiles) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
        """For each level: documents, codes, normal strings and nodes of the wanted units of a batch."""
        ids, found = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), Units(b.column(1), least)
        for level in (0, 1):
            long = np.flatnonzero(found.count[level] >= least)
            owner, codes = ids[found.text[level][long]], code(found.place[level][long], level)
            at = np.flatnonzero(wanted.find(owner, codes) >= 0)
            words = found.words[level].take(pa.array(long[at]))
            nodes = np.fromiter((xxhash.xxh3_128_intdigest(w, seed=level) >> 64 for w in words.to_pylist()), np.uint64, len(words)).view(np.int64)
            yield level, owner[at], codes[at], words, pa.array(nodes)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 5000):
            for level, owner, codes, words, nodes in units_of(b, leads):
                keys = band_keys(words, level).astype("<u8")
                raw = keys.view(np.uint8).reshape(len(words), BANDS, 8)[:, :, :6].tobytes()
                cut = [raw[i : i + 6 * BANDS] for i in range(0, len(raw), 6 * BANDS)]
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(codes), nodes, pa.array(cut, pa.binary())], names=["doc_id", "code", "node", "keys"])

    def every_key(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield common.unpack48(b"".join(b.column(0).to_pylist()))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = common.unpack48(b"".join(b.column(3).to_pylist())).reshape(b.num_rows, BANDS)
            hits = repeated.contains(keys.ravel()).reshape(keys.shape)
            at = np.flatnonzero(hits.any(axis=1))
            shared = pa.array([keys[i][hits[i]].view(np.int64) for i in at.tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in range(3)), shared], names=["doc_id", "code", "node", "keys"])

    banded = common.materialize(rows.mapInArrow(band, "doc_id long, code long, node long, keys binary"))
    repeated = common.repeated_hashes(banded.select("keys"), every_key, rows.sparkSession)
    near = common.materialize(banded.mapInArrow(held, "doc_id long, code long, node long, keys array<long>"))
    common.release(banded)
    asked = common.pair_files(near.select(F.col("doc_id").alias("a"), F.col("code").alias("b")))
    documents = common.pair_files(near.select(F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b")).distinct())

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in common.slices(iter([b.filter(pa.array(documents.find(ids, np.zeros_like(ids)) >= 0))]), 5000):
                for _, _, _, words, nodes in units_of(part, asked):
                    sketch = common.mix64(least_hashes(words, SKETCH)).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([nodes, words, pa.array([x.tobytes() for x in sketch], pa.binary())], names=["node", "text", "sketch"])

    known = common.materialize(rows.mapInArrow(texts, "node long, text string, sketch binary").dropDuplicates(["node"]))  # repeated rows

    def texts_of(nodes: DataFrame) -> DataFrame:
        return known.select("node", "text").join(nodes, "node", "left_semi")

    keyed = near.select("node", F.explode("keys").alias("key")).distinct()
    return common.linked(keyed, known.select("node", "sketch"), texts_of, functools.partial(alike, counted=False), lambda units: common.mix64(least_hashes(pa.array(units, pa.string()), FINE)).astype(np.uint8), SIMILARITY)


def paragraph_classes(docs: DataFrame, least: int = LEAST, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, place, class_id, removed)`` of each sentence that has a like one somewhere, or whose line has."""
    rows = docs.selectExpr(f"cast({id_col} as long) doc_id", f"{text_col} text").where(f"{id_col} is not null")
    found = common.materialize(unit_rows(rows, least))
    kind, where = ["level", "unit", "short"], F.struct("doc_id", "places")
    kinds = common.materialize(found.groupBy(*kind).agg(F.min(where).alias("first"), F.max(where).alias("last"), F.max("words").alias("words")))
    classes = near_units(rows, kinds, least)
    named = kinds.join(classes.select(F.col("node").alias("unit"), "root"), "unit", "left").withColumn("class_id", F.coalesce("root", "unit"))
    own = ["level", "class_id", "short"]  # a short sentence is told by its words beside their hash, a longer one has 0 here
    firsts = named.groupBy(*own).agg(F.min("first").alias("first_of_class"), F.max("last").alias("last_of_class")).where("first_of_class != last_of_class")
    live = common.materialize(named.join(firsts, own).select(*kind, "class_id", "first_of_class"))
    common.release(kinds)
    met = common.materialize(found.drop("words").join(live, kind).select("doc_id", "places", "level", "class_id", "short", (where != F.col("first_of_class")).alias("later")))
    common.release(found, live)
    whole = met.where("level = 1").select("doc_id", F.explode("places").alias("place"), "class_id", F.col("later").alias("removed"))
    gone = whole.where("removed").select("doc_id", "place", F.lit(True).alias("gone")).distinct()
    single = met.where("level = 0").select("doc_id", F.col("places")[0].alias("place"), "class_id", "short")
    single = common.materialize(single.join(gone, ["doc_id", "place"], "left").withColumn("gone", F.coalesce("gone", F.lit(False))))
    kept = single.groupBy("class_id", "short").agg(F.min(F.struct("gone", "doc_id", "place")).alias("kept"))
    single = single.join(kept, ["class_id", "short"]).select("doc_id", "place", "class_id", (F.struct("gone", "doc_id", "place") != F.col("kept")).alias("removed"))
    return whole.union(single)


def by_document(classes: DataFrame) -> DataFrame:
    gone = F.when(F.col("removed"), F.col("place"))
    sets = classes.groupBy("doc_id").agg(F.collect_set("place").alias("p"), F.collect_set(gone).alias("g"), F.collect_set("class_id").alias("c"))
    return sets.select("doc_id", F.size("p").cast("long").alias("n_repeated"), F.size("g").cast("long").alias("n_removed"), F.sort_array("g").alias("removed_places"), F.sort_array("c").alias("class_ids"))


def remove_paragraphs(docs: DataFrame, least: int = LEAST, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with ``kept_text``, its text without the paragraphs to be removed."""
    found = by_document(paragraph_classes(docs, least, id_col=id_col, text_col=text_col)).where("n_removed > 0")
    docs = docs.drop("kept_text")
    doc, places = common.fresh(docs, "_doc", "_places")
    joined = docs.join(found.select(F.col("doc_id").alias(doc), F.col("removed_places").alias(places)), F.col(id_col).cast("long") == F.col(doc), "left")

    @F.pandas_udf("string")
    def cut(texts, places):
        return texts.combine(places, lambda t, p: t if p is None or t is None else "".join(u + s for k, (u, s) in enumerate(units(t)) if k not in set(p)))

    return joined.withColumn("kept_text", F.when(F.col(places).isNull(), F.col(text_col)).otherwise(cut(text_col, places))).drop(doc, places)


def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: paragraphs with a like one elsewhere, how many of them go, their places and classes."""
    docs = common.documents(spark, sf_dir)
    found = by_document(paragraph_classes(docs))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_repeated", "n_removed")), *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("removed_places", "array<int>"), ("class_ids", "array<long>"))))
