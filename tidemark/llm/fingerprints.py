"""I-Match fingerprints with randomised lexicon subsets (operator 1), in DataFrame operations only.

The lexicon holds the terms (runs of letters and digits, lower case) whose document frequency lies between ``LOW`` and
``HIGH`` of all distinct texts: a band of inverse document frequency. With at most N * m term occurrences in N texts of m
distinct terms on average, the lexicon has at most m / LOW terms, whatever N; so it goes into the plan as one constant, a
hash table of arrays. A text's fingerprint hashes its sorted distinct lexicon terms, cut down by randomised subsets of
the lexicon: each of the 16 subsets takes a term by a few bits of its hash. The subsets' rate halves from class to class, and a text
uses the class in which a subset keeps about one of its terms and the next finer one, so that texts of any length have
informative subsets. The same is done with all terms of the text. Two fingerprints' likeness is the share of equal subset
hashes in the classes that both use, among subsets that keep a term of either: the lexicon's classes if both texts have
terms of it, else those of all terms. The band follows the number of distinct texts: of fewer than twenty it is what two
texts share.

Null texts count as empty; texts without any term are told by the hash of the whole text; texts are read whole; rows that repeat a
doc_id follow each other by text; null doc_ids come first; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

LOW, HIGH = 0.002, 0.1
SUBSETS = 16
BITS = 12
#: Texts with copies whose hashes, 16 bytes each, are broadcast.
FEW = 1_000_000


def term_hashes(text: Column) -> Column:
    """Hashes of the text's terms; they may repeat."""
    return F.transform(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: F.xxhash64(t))


def lexicon(docs: DataFrame, *, text_col: str = "text", low: float = LOW, high: float = HIGH, few: int = FEW) -> DataFrame:
    """``(h)``: the hashes of the terms of the band.

    Terms are counted over distinct texts, of which most have no copy: only the texts that have one are shuffled, as one of each
    in a task. Which these are is broadcast, 16 bytes a text, up to ``few`` of them; beyond, all texts are shuffled.
    """
    text = F.coalesce(text_col, F.lit(""))
    keys = [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")]
    copies = docs.groupBy(*keys).agg(F.count("*").alias("n")).groupBy(F.col("n") > 1).agg(F.count("*").alias("texts")).collect()  # two rows
    n, repeated = sum(r.texts for r in copies), sum(r.texts for r in copies if r[0])
    rows = docs.select(*keys, text.alias("text"))
    if repeated <= few:
        known = F.broadcast(docs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
        again = rows.join(known, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("text").alias("text"))
        texts = rows.join(known, ["h1", "h2"], "left_anti").select("text").union(again.select("text"))
    else:
        texts = rows.groupBy("h1", "h2").agg(F.first("text").alias("text")).select("text")
    terms = texts.select(F.explode(F.array_distinct(term_hashes(F.col("text")))).alias("h"))
    least = max(2.0, low * n)
    return terms.groupBy("h").agg(F.count("*").alias("df")).where((F.col("df") >= least) & (F.col("df") <= max(least, high * n)) & (F.col("h") != F.xxhash64(F.lit("")))).select("h")


def lexicon_table(hashes: list[int], bits: int = BITS) -> Column:
    """A constant: by the last bits of a hash, the array of the lexicon's hashes that end so."""
    table: list[list[str]] = [[] for _ in range(1 << bits)]
    for h in hashes:
        table[h & ((1 << bits) - 1)].append(str(h))
    return F.from_json(F.lit(json.dumps(table).replace('"', "")), "array<array<bigint>>")


def fingerprint(text: Column, table: Column, bits: int = BITS, subsets: int = SUBSETS) -> Column:
    """``class:hash,hash,...;class:hash,...`` of the lexicon's terms, if the text has any, and the same of all its terms, with a
    ``~`` before each class; ``-:hash`` of a text without terms. It depends on the text and the lexicon only."""
    mask = (1 << bits) - 1
    every = F.filter(F.array_distinct(term_hashes(text)), lambda h: h != F.xxhash64(F.lit("")))

    def in_lexicon(terms: Column) -> Column:
        return F.filter(terms, lambda h: F.array_contains(F.element_at(table, (h.bitwiseAND(F.lit(mask)) + 1).cast("int")), h))

    def low_bits(n: Column) -> Column:
        return (F.pow(F.lit(2.0), n) - 1).cast("long")

    def sampled(terms: Column, c: Column) -> Column:
        """The terms that any subset of class c takes: one pass over the text's terms."""
        wanted = low_bits(F.greatest(F.lit(0), c - 4))
        return F.filter(terms, lambda h: F.shiftrightunsigned(h, 12).bitwiseAND(wanted) == 0)

    def one_class(taken: Column, c: Column, mark: str) -> Column:
        part = low_bits(F.least(F.lit(4), c))

        def one(k: int) -> Column:
            kept = F.filter(taken, lambda h: F.shiftrightunsigned(h, 40).bitwiseAND(part) == F.lit(k).cast("long").bitwiseAND(part))
            return F.when(F.size(kept) == 0, F.lit("")).otherwise(F.substring(F.lower(F.hex(F.xxhash64(kept, F.lit(k)))), -8, 8))

        return F.concat(F.lit(mark), c.cast("string"), F.lit(":"), F.concat_ws(",", *[one(k) for k in range(subsets)]))

    def bound(value: Column, use) -> Column:
        """``use(value)``, with the value worked out once."""
        return F.transform(F.array(value), use)[0]

    def both_classes(terms: Column, mark: str) -> Column:
        c = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.size(terms), F.lit(1)))).cast("int"))
        some = F.struct(c.alias("c"), F.sort_array(sampled(terms, c)).alias("t"))
        return bound(some, lambda x: F.concat(one_class(x["t"], x["c"], mark), F.lit(";"), bound(sampled(x["t"], x["c"] + 1), lambda t: one_class(t, x["c"] + 1, mark))))

    def whole(terms: Column, some: Column) -> Column:
        known = F.when(F.size(some) > 0, F.concat(both_classes(some, ""), F.lit(";"))).otherwise(F.lit(""))
        return F.when(F.size(terms) == 0, F.concat(F.lit("-:"), F.lower(F.hex(F.xxhash64(text))))).otherwise(F.concat(known, both_classes(terms, "~")))

    return bound(every, lambda terms: bound(in_lexicon(terms), lambda some: whole(terms, some)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subset hashes of two fingerprints, 0 to 1, in the classes of the lexicon if both have them, else in the others."""
    lexical = ~a.startswith("~") & ~b.startswith("~")

    def classes(x: Column) -> Column:
        return F.transform(F.split(x, ";"), lambda c: F.struct(F.substring_index(c, ":", 1).alias("c"), F.split(F.substring_index(c, ":", -1), ",", -1).alias("h")))

    def compare(p: Column, q: Column) -> Column:
        pairs = F.zip_with(p["h"], q["h"], lambda x, y: F.when((x == "") & (y == ""), F.lit(None)).otherwise((x == y).cast("int")))
        return F.filter(pairs, lambda v: v.isNotNull())

    both = F.flatten(F.transform(classes(a), lambda p: F.flatten(F.transform(F.filter(classes(b), lambda q: (q["c"] == p["c"]) & (lexical != p["c"].startswith("~"))), lambda q: compare(p, q)))))
    share = F.try_divide(F.aggregate(both, F.lit(0).cast("double"), lambda s, v: s + v), F.size(both))
    return F.when(a == b, 1.0).otherwise(F.coalesce(share, F.lit(0.0)))


def place_among(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above the value, by two short searches; 0 for null."""
    if not bounds:
        return F.lit(0)
    each = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + each] for i in range(0, len(bounds), each)]
    group = F.size(F.filter(F.lit([g[0] for g in groups]), lambda b: value >= b))
    inside = F.size(F.filter(F.element_at(F.lit(groups), F.greatest(group, F.lit(1))), lambda b: value >= b))
    return F.when(value.isNull() | (group == 0), 0).otherwise((group - 1) * each + inside)


def with_next(docs: DataFrame, parts: int, own) -> DataFrame:
    """``docs(doc_id, text)`` with ``own(text)``, and ``next_text`` and ``next_own`` of the row that follows by doc_id, the first's after
    the last.

    Rows go to ranges of doc_id; each range also gets a copy of the next range's first row, so that the following text
    is always in the same task, and texts are shuffled once; what is derived from them isn't. The bounds, one a range, are
    in the plan.
    """
    rows = docs.select("doc_id", "text")
    bounds = rows.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))).first()[0] if parts > 1 else None
    ranged = rows.withColumn("part", place_among(F.col("doc_id"), sorted(set(bounds or []))))
    order = F.struct("doc_id", F.xxhash64("text"), "text")
    least = ranged.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("m")).collect()  # one row a range
    firsts = {r.part: r.m["doc_id"] for r in least}
    present = sorted(firsts)
    if not present:
        return rows.withColumns({"own": own(F.col("text")), "next_text": F.col("text"), "next_own": F.lit(None).cast("string")})
    to = {p: present[k - 1] for k, p in enumerate(present)}  # the first range's copy goes to the last
    size = present[-1] + 1
    which = F.element_at(F.lit([to.get(p, 0) for p in range(size)]), F.col("part") + 1)
    first = F.element_at(F.array(*[F.lit(firsts.get(p)).cast("long") for p in range(size)]) if None in firsts.values() else F.lit([firsts.get(p, 0) for p in range(size)]), F.col("part") + 1)
    copies = ranged.where(F.col("doc_id").eqNullSafe(first))
    copies = copies.groupBy("part").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("doc_id"), F.col("o.text").alias("text"), which.alias("part"))
    both = ranged.select("doc_id", "text", "part", F.lit(0).alias("copy")).union(copies.select("doc_id", "text", "part", F.lit(1)))
    both = both.repartition("part").withColumn("own", own(F.col("text")))
    ahead = W.partitionBy("part").orderBy("copy", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return both.withColumns({"next_text": F.lead("text").over(ahead), "next_own": F.lead("own").over(ahead)}).where("copy = 0").drop("part", "copy")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint beside those of its edited text and of the next text (see ``op1_imatch``)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    table = lexicon_table([r.h for r in lexicon(rows).collect()])  # bounded by the band
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paired = with_next(rows, parts, lambda text: fingerprint(text, table))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    made = paired.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("own").alias("fingerprint"), fingerprint(F.col("edited"), table).alias("edited_fingerprint"), "next_own")
    own = F.col("fingerprint")
    return made.withColumns({"near_edited": likeness(own, F.col("edited_fingerprint")), "near_next": likeness(own, F.col("next_own"))}).drop("next_own")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.documents(spark, sf_dir))
