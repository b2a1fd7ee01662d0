"""Merkle manifest of a dataset (operator 12): sibling-shift self-joins, level by level.

Each row is a leaf, numbered within its group. On every level a node asks for the computed indices of its siblings, the other
slots of its run of ``FAN`` nodes (for a fan of two the index with its last bit changed), by one equijoin of the level with
itself; what comes back is the node's part of a proof, and the rows of slot zero, which hold their whole run, emit the
parents. Groups with one node left are done; their subroots are the nodes of one more tree. A level has a sixteenth of the
nodes of the one below, and all joins are by (group, index), so a group that holds most rows is dealt like any other.

Leaves are numbered without a window over a group: rows are dealt to ranges of (group, id, digest), numbered inside ranges, and
shifted by the counts of the ranges before.

A null in any column is ``-``; a null group comes first, as does a null id inside its group; rows that repeat an id follow each
other by digest, equal rows in any order; texts of any length are one value; an empty table gives no rows; columns that
aren't named are not part of a leaf and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a node's siblings left and right of it add to a proof: their digests, one after the other.
STEP = "struct<l:binary,r:binary>"


def digest(values: list[Column]) -> Column:
    """Of a row: each value as its number of UTF-8 bytes, a colon and itself, a null as a dash."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def text_of(x: Column) -> Column:
    return F.lower(F.hex(x))


def parent_of(own: Column, left: Column, right: Column) -> Column:
    """The digest of a run, written as hexadecimal text, from one of its nodes and the others."""
    return F.unhex(F.sha2(F.concat(text_of(left), text_of(own), text_of(right)), 256))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``idx``, the place in group ``g`` by ``order`` from 0, and ``n``, the size of the group."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("g"), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = common.materialize(leaves.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("g", "part").agg(F.count("*").alias("m"))
    by_group = W.partitionBy("g")
    before = F.sum("m").over(by_group.orderBy("part")) - F.col("m")
    shifts = sizes.select("g", "part", before.alias("shift"), F.sum("m").over(by_group).alias("n"))
    inside = F.row_number().over(W.partitionBy("g", "part").orderBy(*keys[1:])) - 1
    out = common.materialize(ranged.withColumn("inside", inside).join(shifts, ["g", "part"]).withColumn("idx", F.col("inside") + F.col("shift")).drop("inside", "shift", "part"))
    common.release(ranged)
    return out


def with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """``nodes(g, idx, n, h)`` with ``step``: the digests of the others of their run, left and right of each.

    Each node looks for the computed indices of its siblings, as far as they exist, in the same table.
    """
    start = F.col("idx") - F.col("idx") % fan
    others = F.sequence(start, F.least(start + fan, F.col("n")) - 1)
    asks = nodes.select("g", "idx", F.explode(F.filter(others, lambda i: i != F.col("idx"))).alias("sibling"))
    met = asks.join(nodes.select("g", F.col("idx").alias("sibling"), "h"), ["g", "sibling"])
    run = met.groupBy("g", "idx").agg(F.array_sort(F.collect_list(F.struct("sibling", "h"))).alias("run"))

    def side(keep) -> Column:
        return F.concat(F.lit(b""), F.aggregate(F.filter("run", keep), F.lit(b""), lambda s, x: F.concat(s, x["h"])))

    sides = F.struct(side(lambda x: x["sibling"] < F.col("idx")).alias("l"), side(lambda x: x["sibling"] > F.col("idx")).alias("r"))
    parts = run.select("g", "idx", sides.alias("step"))
    alone = F.struct(F.lit(b"").alias("l"), F.lit(b"").alias("r"))
    return nodes.join(parts, ["g", "idx"], "left").withColumn("step", F.coalesce("step", alone))


def levels_above(leaves: DataFrame, fan: int) -> list[DataFrame]:
    """Written tables ``(g, idx, n, h, step)``, one a level, from the leaves, with all their columns, to the tops; ``n`` is the size of
    the level."""
    out, nodes = [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        out.append(common.materialize(with_siblings(nodes, fan)))
        if most <= 1:
            return out
        slot_zero = out[-1].where((F.col("n") > 1) & (F.col("idx") % fan == 0))
        nodes = slot_zero.select("g", F.floor(F.col("idx") / fan).alias("idx"), F.ceil(F.col("n") / fan).alias("n"), parent_of(F.col("h"), F.col("step.l"), F.col("step.r")).alias("h"))
        most = -(-most // fan)


def tops(levels: list[DataFrame]) -> DataFrame:
    """``(g, h)``: the last node of each group."""
    found = [level.where("n = 1").select("g", "h") for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def with_paths(levels: list[DataFrame], above: DataFrame, fan: int) -> DataFrame:
    """The lowest level with ``(top, root, path)``: ``path`` has the steps from the node up to the root.

    ``above(g, top, root, path)`` has what follows a group's top, which is joined once for each group, at the top.
    """
    paths = None
    for level in reversed(levels):
        own = [c for c in level.columns if c not in ("n", "step")]
        done = level.where("n = 1").join(above, "g").select(*own, "top", "root", "path")
        if paths is not None:
            up = paths.select("g", F.col("idx").alias("parent"), "top", "root", "path")
            rest = level.where("n > 1").withColumn("parent", F.floor(F.col("idx") / fan)).join(up, ["g", "parent"])
            done = rest.select(*own, "top", "root", F.concat(F.array("step"), F.col("path")).alias("path")).union(done)
        paths = done
    return paths


def manifest(docs: DataFrame, *, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", fan: int = FAN, tampered: Column | None = None, when: Column | None = None) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of each row.

    ``tampered`` stands for the text in the leaf that a proof is checked with, where ``when`` holds; without them, or
    elsewhere, the leaf itself is checked. ``columns`` names what a leaf digests, in this order; ``group_col`` is a string.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col)), F.lit(""))
    own = digest([F.col(c) for c in columns])
    other = own if tampered is None else digest([tampered if c == "text" else F.col(c) for c in columns])
    rows = docs.select(g.alias("g"), F.col(id_col).alias("doc_id"), own.alias("h"), (F.lit(None).cast("binary") if tampered is None else F.when(when, other)).alias("t"))
    leaves = numbered(rows, ["doc_id", "h"])
    levels = levels_above(leaves, fan)
    ends = numbered(tops(levels).select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), ["name"])
    high = levels_above(ends, fan)
    root = tops(high).select("g", F.col("h").alias("root"), F.col("h").alias("top"), F.array().cast(f"array<{STEP}>").alias("path"))
    upper = with_paths(high, root, fan)
    found = with_paths(levels, common.materialize(upper.select(F.col("name").alias("g"), F.col("h").alias("top"), "root", "path")), fan)
    siblings = F.aggregate("path", F.lit(b""), lambda s, x: F.concat(s, x["l"], x["r"]))
    folded = F.aggregate("path", F.coalesce("t", "h"), lambda x, s: parent_of(x, s["l"], s["r"]))
    return found.select(
        "doc_id", text_of(F.col("h")).alias("leaf"), text_of(F.col("top")).alias("subroot"), text_of(F.col("root")).alias("root"), F.sha2(text_of(siblings), 256).alias("proof_sha256"), text_of(folded).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    every_fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return manifest(common.documents(spark, sf_dir), tampered=F.translate("text", UPPER, LOWER), when=every_fifth)


def _sql(depth: int = 7) -> str:
    """The same with ``depth`` levels a tree written out, more than any table of fewer than 16 to that power rows needs."""

    def value(c: str, text: str) -> str:
        v = text if c == "text" else f"cast({c} as varchar)"
        return f"coalesce(strlen({v}) || ':' || {v}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(value(c, text) for c in COLUMNS) + ")"

    def tree(name: str, first: str) -> list[str]:
        """Levels of nodes (g, i, h, n), and of each the digests left and right of it in its run."""
        out = [f"{name}0 as (select *, count(*) over (partition by g) as n from ({first}))"]
        for k in range(depth):
            out.append(f"{name}{k + 1} as (select g, i // {FAN} as i, case when max(n) > 1 then sha256(string_agg(h, '' order by i)) else max(h) end as h, (max(n) + {FAN - 1}) // {FAN} as n from {name}{k} group by g, i // {FAN})")
            out.append(f"""{name}s{k} as (select x.g, x.i, x.n, coalesce(string_agg(y.h, '' order by y.i) filter (y.i < x.i), '') as l, coalesce(string_agg(y.h, '' order by y.i) filter (y.i > x.i), '') as r
            from {name}{k} x join {name}{k} y on x.g = y.g and x.i // {FAN} = y.i // {FAN} group by x.g, x.i, x.n)""")
        return out

    digits = "flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    # crc32 by its definition: each byte is added, then eight times the last bit goes out
    crc = f"list_reduce(list_prepend(4294967295::bigint, {digits}), lambda v, x: case when x >= 0 then xor(v, x) when v % 2 = 1 then xor(v // 2, 3988292384::bigint) else v // 2 end)"
    changed = leaf(f"translate(text, '{UPPER}', '{LOWER}')")
    steps = [
        f"d as (select doc_id, coalesce('=' || source, '') as g, {leaf('text')} as h, case when xor({crc}, 4294967295::bigint) % 5 = 0 then {changed} else {leaf('text')} end as t from documents)",
        "o as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as i from d)",
        *tree("a", "select g, i, h from o"),
        f"e as (select g as name, '' as g, h, row_number() over (order by g) - 1 as i from a{depth})",
        *tree("b", "select g, i, h from e"),
        "f0 as (select doc_id, g, i, h, '' as p, t as x from o)",
    ]
    fold = "f.p || s.l || s.r as p, case when s.n > 1 then sha256(s.l || f.x || s.r) else f.x end as x"
    for k in range(depth):
        steps.append(f"f{k + 1} as (select f.doc_id, f.g, f.i // {FAN} as i, f.h, {fold} from f{k} f join as{k} s on s.g = f.g and s.i = f.i)")
    steps.append(f"g0 as (select f.doc_id, f.h, e.h as top, e.i, f.p, f.x from f{depth} f join e on e.name = f.g)")
    for k in range(depth):
        steps.append(f"g{k + 1} as (select f.doc_id, f.h, f.top, f.i // {FAN} as i, {fold} from g{k} f join bs{k} s on s.i = f.i)")
    return "with " + ",\n".join(steps) + f"""
select g.doc_id, g.h as leaf, g.top as subroot, r.h as root, sha256(g.p) as proof_sha256, g.x as folded_root, g.x = r.h as verified from g{depth} g cross join (select h from b{depth}) r"""


SQL = {"op12_merkle_manifest": _sql()}
