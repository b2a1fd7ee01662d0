"""Divergence of sources (operator 13): a k-squared quadtree over the matrix of group and term counts.

The matrix has a row for each (lang, source) group and a column for each term that a language keeps. It is dealt into tiles of
row blocks by column blocks; a task gets two row blocks of one column block, builds the quadtree of their cells (each node
that isn't empty has four children: two halves of its rows by two of its columns; a bit says whether a child is empty) and
goes down it with both row blocks at once. Where both quadrants are empty all their pairs of groups have only zeros there: they are
priced at once by the width of the quadrant, since all zeros of a group have one probability. Only leaves, where one of
two groups counts the term, are priced one by one. Terms that have no cell in a tile's groups are priced the
same way, outside.

Counting is additive: tasks add up what they hold of (lang, source, term), at most ``HELD`` terms at a time, so a frequent term or a
large source costs one row a task. All arithmetic is by integers.

Null text, lang and source are ''; a text without terms still makes its group occur; texts of any length are read whole;
repeated rows count as often as they occur; equal values are ranked by the item's UTF-8 bytes; an empty table gives no rows;
other columns, whatever they are called, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

LEAST_DOCS, UNIT, TOP = 10, 1_000_000_000, 10
#: Groups of a row block and, about, terms of a column block: a tile's pairs of groups times its terms bound a task's memory.
ROWS, COLUMNS = 32, 2048
#: Terms that a task holds before it sends its counts.
HELD = 400_000
#: Bytes of a text: letters in lower case and all beyond ASCII stay, the others part terms.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII; only A-Z lose their case."""
    return text.translate(_TABLE).split()


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, source, term, n, docs)`` of ``(lang, source, text)``: how often and in how many texts; a null term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [[lang] * (len(terms) + 1), [source] * (len(terms) + 1), [None, *(t.decode() for t in terms)], [0, *n.values()], [0, *(docs[t] for t in terms)]]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for part in common.slices([batch], 2000):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), common.bytes_of(part.column(2))):
                key = (lang, source)
                if key not in held:
                    held[key] = (Counter(), Counter())
                n, docs = held[key]
                own = Counter(terms_of(text))
                size -= len(n)
                n.update(own)
                docs.update(own.keys())
                size += len(n)
                if size > HELD:
                    yield from send()
                    size = 0
    yield from send()


def counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)`` over all texts; each occurring group also has a row with a null term."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    sent = rows.mapInArrow(partial_counts, "lang string, source string, term string, n long, docs long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)), exactly, beyond what a long holds on the way; null if there are no terms."""
    return F.lit(1).cast("long") + F.call_function("div", (n + 2).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)"), (total + 2 * v).cast("decimal(19,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class Quadtree:
    """A k-squared tree of the cells (row, column) of a square matrix; nodes of a level are numbered in the order of their places.

    ``bits[l]`` has four bits for each node of level l, one for each child (upper left, upper right, lower left, lower right); a child's
    number is the count of set bits before it.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, depth: int):
        place = np.zeros(len(rows), np.int64)
        for b in range(depth):
            place |= (((rows >> b) & 1) << (2 * b + 1)) | (((columns >> b) & 1) << (2 * b))
        self.order = np.argsort(place, kind="stable")
        self.depth, self.bits, self.rank = depth, [], []
        above = np.zeros(1 if len(rows) else 0, np.int64)
        for level in range(1, depth + 1):
            here = np.unique(place >> (2 * (depth - level)))
            bits = np.zeros(4 * len(above), bool)
            bits[4 * np.searchsorted(above, here >> 2) + (here & 3)] = True
            self.bits.append(bits)
            self.rank.append(np.cumsum(bits) - 1)
            above = here

    def child(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The numbers of children of nodes; -1 for an empty one, or of an empty one."""
        if not len(self.bits[level]):
            return np.full(len(node), -1)
        at = 4 * np.maximum(node, 0) + quadrant
        return np.where((node >= 0) & self.bits[level][at], self.rank[level][at], -1)


def traverse(tree: Quadtree, other: Quadtree, p: np.ndarray, q: np.ndarray, p0: np.ndarray, q0: np.ndarray, width: int, same: bool) -> np.ndarray:
    """Sums of gaps of all pairs of rows of two trees over ``width`` columns, in a matrix; of one tree with itself above the diagonal.

    ``p`` and ``q`` have the values of the trees' cells, in their order; ``p0`` and ``q0`` what a row's zeros have.
    """
    side, depth = 1 << tree.depth, tree.depth
    n, m = len(p0), len(q0)
    zeros, total = np.zeros((n, m), np.int64), np.zeros((n, m), np.int64)
    a = b = i = j = np.zeros(1, np.int64)
    quadrants = np.array([(x, y, c) for x in (0, 1) for y in (0, 1) for c in (0, 1)])
    for level in range(depth):
        step, size = quadrants, len(a)
        di, dj, dc = (np.repeat(step[:, k], size) for k in range(3))
        na = tree.child(level, np.tile(a, 8), 2 * di + dc)
        nb = other.child(level, np.tile(b, 8), 2 * dj + dc)
        ni, nj = 2 * np.tile(i, 8) + di, 2 * np.tile(j, 8) + dj
        high = depth - level - 1
        there = ((ni << high) < n) & ((nj << high) < m)
        if same:
            there &= (ni < nj) | (high > 0) & (ni == nj)
        empty = there & (na < 0) & (nb < 0)
        span = 1 << high  # rows and columns of a quadrant
        for x, y, k in zip(*_counted(ni[empty], nj[empty])):
            zeros[x * span : (x + 1) * span, y * span : (y + 1) * span] += k * span
        live = there & ~empty
        a, b, i, j = na[live], nb[live], ni[live], nj[live]
    left = np.where(a >= 0, p[a] if len(p) else 0, p0[i])
    right = np.where(b >= 0, q[b] if len(q) else 0, q0[j])
    np.add.at(total, (i, j), (left - right) ** 2 // (left + right))
    blank = zeros - (side - width)  # columns beyond the last one are empty, too
    total += blank * ((p0[:, None] - q0[None, :]) ** 2 // (p0[:, None] + q0[None, :]))
    return total


def _counted(i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Distinct pairs and how often each occurs."""
    code, k = np.unique((i << 32) | j, return_counts=True)
    return (code >> 32).tolist(), (code & 0xFFFFFFFF).tolist(), k.tolist()


def tile(part: pd.DataFrame) -> pd.DataFrame:
    """``(g, h, f, width)`` of a tile: the sums of gaps of the pairs of its groups over the terms that it has cells of.

    ``part`` has the cells ``(g, low, zero, term, p)``, ``low`` where a cell is of the first of two row blocks, and for each group
    a row with a null term, whether or not it has cells.
    """
    real = part["term"].notna().to_numpy()
    terms, column = np.unique(part["term"].to_numpy()[real].astype(np.int64), return_inverse=True)
    often = np.argsort(np.argsort(-np.bincount(column, minlength=1), kind="stable"), kind="stable")  # empty quadrants lie together
    width, sides = len(terms), []
    same = bool(part["same"].iloc[0])
    for mine in (part["low"].to_numpy(), ~part["low"].to_numpy())[: 1 if same else 2]:
        groups, at = np.unique(part["g"].to_numpy()[mine], return_index=True)
        cells = part["p"].to_numpy()[real & mine].astype(np.int64)
        sides.append((groups, part["zero"].to_numpy()[mine][at], np.searchsorted(groups, part["g"].to_numpy()[real & mine]), often[column[mine[real]]], cells))
    if not width or not all(len(s[0]) for s in sides):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("g", "h", "f", "width")})
    depth = max(1, *(int(n - 1).bit_length() for n in (width, *(len(s[0]) for s in sides))))
    trees = [Quadtree(s[2], s[3], depth) for s in sides]
    (a, p0, *_, p), (b, q0, *_, q) = sides[0], sides[-1]
    f = traverse(trees[0], trees[-1], p[trees[0].order], q[trees[-1].order], p0, q0, width, same)
    x, y = np.nonzero(np.triu(np.ones(f.shape, bool), 1) if same else np.ones(f.shape, bool))
    return pd.DataFrame({"g": np.minimum(a[x], b[y]), "h": np.maximum(a[x], b[y]), "f": f[x, y], "width": width})


def divergence(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top: int = TOP, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: of each group its divergence from the other sources of its language (``pair``),
    and the ``top`` terms that it has more often than its language (``term``)."""
    counted = common.materialize(counts(docs))
    terms = counted.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = common.materialize(kept.select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("tid")))
    cells = terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    totals = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = counted.where("term is null").select("lang", "source")
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    known = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(blocks, "lang").join(totals, "lang", "left")
    v = F.coalesce("v", F.lit(0)).cast("long")
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    known = known.select("lang", "source", "blocks", "lang_total", block.alias("block"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), v.alias("v"), F.monotonically_increasing_id().alias("g"))
    known = common.materialize(known.withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v")))))
    valued = cells.join(known, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total"), F.col("v")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("v"))})
    valued = common.materialize(valued.select("g", "lang", "source", "term", "tid", "p", "q", "zero", "v", "block", "blocks"))

    n_columns = F.ceil(F.col("v") / columns).cast("int")
    one = valued.select("g", "lang", "zero", "block", "blocks", F.col("tid").alias("term"), "p", F.pmod(F.xxhash64("tid"), n_columns).cast("int").alias("c"))
    marks = known.where("v > 0").select("g", "lang", "zero", "block", "blocks", F.lit(None).cast("long").alias("term"), F.lit(None).cast("long").alias("p"), F.explode(F.sequence(F.lit(0), n_columns - 1)).alias("c"))
    met = one.union(marks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("lang", "c", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("low"), (F.col("block") == F.col("other")).alias("same"), "g", "zero", "term", "p")
    sums = met.groupBy("lang", "c", "i", "j").applyInPandas(tile, "g long, h long, f long, width long").groupBy("g", "h").agg(F.sum("f").alias("f"), F.sum("width").alias("width"))

    item = known.select("lang", F.col("source").alias("item"), F.col("g").alias("o"), F.col("zero").alias("other_zero"))
    pairs = known.select("lang", "source", "g", "zero", "v").join(item, "lang").where("g != o")
    pairs = pairs.withColumns({"lo": F.least("g", "o"), "hi": F.greatest("g", "o")}).join(sums.withColumnsRenamed({"g": "lo", "h": "hi"}), ["lo", "hi"], "left")
    blank = (F.col("v") - F.coalesce("width", F.lit(0))) * gap(F.col("zero"), F.col("other_zero"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("v") == 0, 0).otherwise(F.coalesce("f", F.lit(0)) + blank).cast("long").alias("value"))
    more = valued.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(more.withColumn("rank", rank).where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(common.documents(spark, sf_dir))


SQL = {
    "op13_source_divergence": rf"""with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r, coalesce(text, '') as text from documents),
t as (select lang, source, r, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
k as (select lang, term, count(*)::hugeint as n from t group by lang, term having count(distinct r) >= {LEAST_DOCS}),
l as (select lang, sum(n)::hugeint as total, count(*)::hugeint as v from k group by lang),
g as (select distinct lang, source from d),
c as (select t.lang, t.source, t.term, count(*)::hugeint as n from t join k on k.lang = t.lang and k.term = t.term group by all),
m as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from g left join c on c.lang = g.lang and c.source = g.source group by all),
p as (select m.lang, m.source, k.term, coalesce(c.n, 0) as n, 1 + ({UNIT} * (coalesce(c.n, 0) + 2)) // (m.total + 2 * l.v) as p, 1 + ({UNIT} * (k.n + 2)) // (l.total + 2 * l.v) as q
    from m join k on k.lang = m.lang join l on l.lang = m.lang left join c on c.lang = m.lang and c.source = m.source and c.term = k.term),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
    union all select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from p where n > 0 and p > q)
select lang, source, part, item, value, rank::int as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r) x where part = 'pair' or rank <= {TOP}"""
}
