"""Clusters by density: the hierarchy of mutual reachability, condensed, of which the clusters that last longest are kept.

``hierarchy`` and ``clusters`` work on tables of any size: each step is a join, a grouping or a sort.

* Points with equal vectors meet as one, their first, which knows how many they are. All other points of a vector hang on the tree of
  the first ones by an edge as long as their core distance, whose other end is known without looking at them.
* The minimum spanning tree is found in one pass over pairs of blocks of points. A block pair gives the spanning tree of its own
  distances; an edge that isn't in it is on a cycle of lesser ones, so the trees of all pairs hold one of the whole. What is
  left, fewer edges than points times blocks, is reduced by Boruvka's rounds of least edges of components.
* The hierarchy comes from contraction: edges that are the least at one of their ends are drawn together until none is left.
  The others, of which there are fewer than half, are a smaller tree of the same kind. An edge belongs to the way up from the
  first contracted vertex around it whose least edge is greater; on such a way edges follow each other by size.
* Sizes, clusters' tops and chosen ancestors are gathered along pointers, by doubling. Which clusters are kept is decided from
  the leaves up: leaves are raked, chains of single children are composed to one function of what lies below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .graph import components
from .order import farthest, followed, gathered, later, numbered

#: Points of a block; digits of distances; the least distance, so that equal points have a finite density.
BLOCK, DIGITS, LEAST = 1024, 6, 1e-6


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.maximum(np.round(np.sqrt(np.maximum(squares, 0)), DIGITS), LEAST)


def block_pairs(points: DataFrame) -> DataFrame:
    """``points(id, ..)`` dealt to blocks, each copied to all its pairs of blocks ``(i, j)``, with ``own`` its block."""
    blocks = max(1, -(-points.count() // BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    copies = points.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return copies.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def matrix(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["v"].to_list()).astype(float) if len(part) else np.zeros((0, 0))


def core_distances(points: DataFrame, samples: int) -> DataFrame:
    """``(id, core)`` of ``points(id, v, n)``, each of which stands for ``n`` equal ones: the distance to the ``samples - 1``-th nearest other
    point; to the farthest if there are fewer."""
    k = max(1, samples - 1)

    def nearest(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sides = [part[part["own"] == b].sort_values("id") for b in dict.fromkeys(key)]
        out = []
        for a, b in [(sides[0], sides[-1])] if len(sides) == 1 else [(sides[0], sides[1]), (sides[1], sides[0])]:
            if len(a) and len(b):
                d = distances(matrix(a), matrix(b))
                many = np.repeat(b["n"].to_numpy()[None, :], len(a), axis=0)
                if a is b:
                    np.fill_diagonal(d, LEAST)
                    many[np.diag_indices(len(a))] -= 1
                    d[many == 0] = np.inf
                some = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
                some = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, axis=1), axis=1), axis=1)
                upto = np.take_along_axis(many, some, axis=1).cumsum(axis=1)
                farther = np.column_stack([np.take_along_axis(d, some, axis=1), np.full(len(a), np.inf)])
                near = np.column_stack([farther[np.arange(len(a)), (upto <= t).sum(axis=1)] for t in range(k)])
                out.append(pd.DataFrame({"id": a["id"].to_numpy(), "near": near.tolist()}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "near": []})

    found = block_pairs(points).groupBy("i", "j").applyInPandas(nearest, "id long, near array<double>")
    every = F.slice(F.sort_array(F.filter(F.flatten(F.collect_list("near")), lambda x: x < float("inf"))), 1, k)
    return found.groupBy("id").agg(every.alias("near")).select("id", F.coalesce(F.element_at("near", -1), F.lit(LEAST)).alias("core"))


def least_tree(w: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Prim's spanning tree of a symmetric matrix of distances, infinite where there is no edge; of equal edges the first by its ends."""
    n = len(w)
    far = np.full(n, np.inf)
    via, code = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    out, at = np.zeros(n, bool), 0
    places = np.arange(n)
    for _ in range(n - 1):
        out[at] = True
        own = np.minimum(places, at) * n + np.maximum(places, at)
        better = ~out & ((w[at] < far) | ((w[at] == far) & (own < code)))
        far[better], via[better], code[better] = w[at][better], at, own[better]
        open_ = np.where(out, np.inf, far)
        least = open_.min()
        if not np.isfinite(least):
            return
        some = np.flatnonzero(open_ == least)
        at = int(some[np.argmin(code[some])])
        yield int(via[at]), at, float(least)


def spanning_tree(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b, w)``, a < b: the minimum spanning tree of ``points(id, v, n, core)`` by the greatest of both cores and the distance, of equal
    edges by their ends; and ``(id, to)`` of those with ``n > 1``: what all points equal to one hang on.

    Edges between equal points are as long as their core, none of theirs is shorter. So of a point's equal ones each but the
    first has a single edge in the whole tree, to the least point that is as near: of the others of that length, the greatest of a
    cycle is always another one. These are first points of their vectors.
    """

    def tree(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        ids, core, own, many, x = part["id"].to_numpy(), part["core"].to_numpy(), part["own"].to_numpy(), part["n"].to_numpy(), matrix(part)
        w = np.maximum(np.maximum(distances(x, x), core[:, None]), core[None, :])
        if key[0] != key[1]:
            w[own[:, None] == own[None, :]] = np.inf
        rows = [(ids[min(p, q)], ids[max(p, q)], d, False) for p, q, d in least_tree(w)]
        near = np.tril(w == core[:, None], -1) & (many > 1)[:, None]
        rows += [(ids[p], ids[near[p].argmax()], core[p], True) for p in np.flatnonzero(near.any(axis=1))]
        return pd.DataFrame(rows, columns=["a", "b", "w", "hangs"])

    met = materialize(block_pairs(points).groupBy("i", "j").applyInPandas(tree, "a long, b long, w double, hangs boolean"))
    found = met.where("hangs").groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to"))
    hangs = points.where("n > 1").select("id").join(found, "id", "left").select("id", F.coalesce("to", "id").alias("to"))
    edges = met.where("not hangs").select("a", "b", "w")
    if edges.count() < points.count():  # one block: a tree already
        return edges, hangs
    kept, open_ = None, edges.select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v"))
    while True:
        ends = open_.select(F.col("u").alias("x"), F.struct("w", "a", "b").alias("e"), "u", "v").union(open_.select("v", F.struct("w", "a", "b"), "u", "v"))
        chosen = ends.groupBy("x").agg(F.min(F.struct("e", "u", "v")).alias("m")).select("m.e.a", "m.e.b", "m.e.w", "m.u", "m.v").distinct()
        chosen = materialize(chosen)
        if chosen.isEmpty():
            return (kept if kept is not None else edges), hangs
        kept = chosen.select("a", "b", "w") if kept is None else kept.union(chosen.select("a", "b", "w"))
        roots = components(chosen.select(F.col("u").alias("a"), F.col("v").alias("b")))
        for c in ("u", "v"):
            open_ = open_.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(c, F.coalesce(f"r{c}", c)).drop(f"r{c}")
        open_ = materialize(open_.where("u != v"))


def hierarchy(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(e, parent, w)`` of the tree's edges, numbered by size, and ``(id, parent)`` of the points: what each is drawn together by next.

    The greatest edge has no parent. Of equal edges the first by its ends comes first.
    """
    edges = numbered(tree, ["w", "a", "b"], "e")
    now = edges.select("e", F.col("a").alias("u"), F.col("b").alias("v"))
    points, asking, chains = None, None, None
    while True:
        ends = now.select(F.col("u").alias("x"), "e").union(now.select("v", "e"))
        light = materialize(ends.groupBy("x").agg(F.min("e").alias("light")))
        if points is None:
            points = light.select(F.col("x").alias("id"), F.col("light").alias("parent"))
        else:  # edges drawn together earlier find the way that they are on, or look farther up
            met = asking.join(light, "x", "left")
            on = met.where("light is null or light > e").select("e", F.coalesce("light", F.lit(-1)).alias("above"), F.col("x").alias("side"))
            chains = on if chains is None else chains.union(on)
            asking = met.where("light is not null and light < e").select("e", "x")
        if now.isEmpty():
            break
        both = now.join(light.select(F.col("x").alias("u"), F.col("light").alias("lu")), "u").join(light.select(F.col("x").alias("v"), F.col("light").alias("lv")), "v")
        marked = materialize(both.withColumn("least", (F.col("e") == F.col("lu")) | (F.col("e") == F.col("lv"))))
        drawn = marked.where("least")
        up = components(drawn.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("node").alias("x"), F.col("root").alias("y"))
        here = drawn.select("e", F.col("u").alias("x"))
        asking = materialize((here if asking is None else here.union(asking)).join(up, "x").select("e", F.col("y").alias("x")))
        rest = marked.where("not least").select("e", "u", "v")
        for c in ("u", "v"):
            rest = rest.join(up.select(F.col("x").alias(c), F.col("y").alias(f"y{c}")), c).withColumn(c, F.col(f"y{c}")).drop(f"y{c}")
        now = materialize(rest)
    ways = numbered(chains, ["above", "side", "e"], "r")
    after = ways.select((F.col("r") - 1).alias("r"), F.col("e").alias("next"), F.col("above").alias("a2"), F.col("side").alias("s2"))
    follows = (F.col("a2") == F.col("above")) & (F.col("s2") == F.col("side"))
    parent = F.when(follows, F.col("next")).otherwise(F.when(F.col("above") >= 0, F.col("above")))
    parents = ways.join(after, "r", "left").select("e", parent.alias("parent"))
    return materialize(edges.select("e", "w").join(parents, "e")), materialize(points)


def condensed(tree: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The condensed hierarchy: ``(cluster, parent, stability)``, and ``(id, cluster)``, the cluster that each point falls out of.

    A cluster is named by the edge that holds it together. A split is one whose sides have at least ``least`` points each; else the
    smaller side falls out and the cluster goes on. A cluster's stability sums over its points for how long, in inverse
    distances, they stay.
    """
    edges, points = hierarchy(tree)
    own = edges.join(points.groupBy(F.col("parent").alias("e")).agg(F.count("*").alias("own")), "e", "left")
    sizes = gathered(own.select(F.col("e").alias("node"), "parent", F.coalesce("own", F.lit(0)).cast("long").alias("size")), "size").withColumnRenamed("node", "e")
    edges = materialize(edges.join(sizes, "e").withColumn("density", 1 / F.col("w")))
    sides = edges.where(F.col("parent").isNotNull() & (F.col("size") >= least)).groupBy(F.col("parent").alias("e")).agg(F.count("*").alias("large"))
    known = materialize(edges.join(sides, "e", "left").withColumn("splits", F.coalesce("large", F.lit(0)) == 2))
    above = known.select(F.col("e").alias("parent"), F.col("splits").alias("from_split"), F.col("density").alias("born"), F.col("size").alias("parent_size"))
    nodes = materialize(known.join(above, "parent", "left").withColumn("begins", F.col("parent").isNull() | F.coalesce("from_split", F.lit(False))))
    large = nodes.where((F.col("size") >= least) | F.col("parent").isNull())
    links = large.select(F.col("e").alias("node"), F.when(~F.col("begins"), F.col("parent")).alias("parent"), F.col("e").alias("top"))
    tops = followed(links, {"top": later}).select(F.col("node").alias("e"), "top")
    # sides that are too small hang on the first edge that is large enough
    small = nodes.where((F.col("size") < least) & F.col("parent").isNotNull())
    up = followed(small.select(F.col("e").alias("node"), F.when(F.col("parent_size") < least, F.col("parent")).alias("parent"), F.col("parent").alias("hangs")), {"hangs": later}).select(F.col("node").alias("parent"), "hangs")
    fallen = points.join(up, "parent", "left").select("id", F.coalesce("hangs", "parent").alias("e"))
    fallen = materialize(fallen.join(tops, "e").join(known.select("e", "density"), "e").select("id", F.col("top").alias("cluster"), "density"))
    clusters = nodes.where("begins").where((F.col("size") >= least) | F.col("parent").isNull())
    clusters = clusters.join(tops.select(F.col("e").alias("parent"), F.col("top").alias("above")), "parent", "left").select(F.col("e").alias("cluster"), F.col("above").alias("parent"), "size", F.coalesce("born", F.lit(0.0)).alias("born"))
    clusters = materialize(clusters)
    stays = fallen.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("density").alias("d"))
    goes = clusters.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum("size").alias("n"), F.sum(F.col("size") * F.col("born")).alias("d"))
    total = stays.union(goes).groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    out = clusters.join(total, "cluster").select("cluster", "parent", F.round(F.col("d") - F.col("n") * F.col("born"), DIGITS).alias("stability"))
    return materialize(out), fallen.select("id", "cluster")


def lasting(clusters: DataFrame) -> DataFrame:
    """``(cluster, kept)``: of ``clusters(cluster, parent, stability)`` those, below the root, that are at least as stable as the most that
    clusters below them add up to, and have no such one above.

    What a subtree is worth is the greater of its own stability and the sum of its children's worths: ``greatest(a, b + x)`` of the
    sum ``x`` that isn't known yet. Raking leaves adds to ``b``; a chain of single children is one such function of its end.
    """
    low = float("-inf")
    now = clusters.select(F.col("cluster").alias("node"), "parent", F.col("stability").alias("a"), F.lit(0.0).alias("b"), F.lit(low).alias("ga"), F.lit(0.0).alias("gb"))
    now, worths, waiting = materialize(now), [], []
    while not now.isEmpty():
        live = now.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
        told = materialize(now.join(live, "node", "left").withColumn("children", F.coalesce("children", F.lit(0))))
        leaves = told.where("children = 0").withColumn("worth", F.greatest("a", "b"))
        worths.append(materialize(leaves.select("node", "worth", "parent", F.greatest(F.col("ga"), F.col("gb") + F.col("worth")).alias("gives"))))
        gain = worths[-1].where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.sum("gives").alias("gain"), F.count("*").alias("raked"))
        rest = told.where("children > 0").join(gain, "node", "left").withColumns({"b": F.col("b") + F.coalesce("gain", F.lit(0.0)), "children": F.col("children") - F.coalesce("raked", F.lit(0))})
        rest = materialize(rest.select("node", "parent", "a", "b", "ga", "gb", "children"))
        # a node whose children are all raked is a leaf now; one with a single child left becomes a function of it
        single = rest.where("children = 1").select(F.col("node").alias("parent"), F.col("a").alias("pa"), F.col("b").alias("pb"))
        steps = rest.join(single, "parent", "left")
        chained = F.col("pa").isNotNull()
        way = F.struct(F.greatest(F.col("pa"), F.col("pb") + F.col("ga")).alias("x"), (F.col("pb") + F.col("gb")).alias("y"))
        links = materialize(steps.select("node", "parent", "children", "a", "b", "ga", "gb", F.when(chained, way).alias("f")))
        ends = links.where("children != 1")
        # each end climbs its chain: the composed function, and the place where the chain begins
        climbed = _climbed(links)
        now = materialize(ends.join(climbed, "node").select("node", F.col("top_parent").alias("parent"), "a", "b", F.col("top_ga").alias("ga"), F.col("top_gb").alias("gb")))
        waiting.append(_below(links))
    known = None
    for k in range(len(worths) - 1, -1, -1):
        own = worths[k].select("node", "worth")
        known = own if known is None else known.union(own)
        if k and waiting[k - 1] is not None:
            known = materialize(known)
            found = waiting[k - 1].join(known.withColumnRenamed("node", "end"), "end").select("node", F.greatest(F.col("x"), F.col("y") + F.col("worth")).alias("worth"))
            known = known.union(found)
    known = materialize(known)
    below = clusters.join(known.withColumnRenamed("node", "cluster"), "cluster").where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum("worth").alias("sum"))
    chosen = clusters.join(below, "cluster", "left").withColumn("chosen", F.col("parent").isNotNull() & (F.col("stability") >= F.coalesce("sum", F.lit(0.0)) - 1e-9))
    tops = followed(chosen.select(F.col("cluster").alias("node"), "parent", F.when(F.col("chosen"), F.col("cluster")).alias("top")), {"top": farthest})
    return tops.select(F.col("node").alias("cluster"), F.col("top").alias("kept"))


def _climbed(links: DataFrame) -> DataFrame:
    """For each node of ``links(node, parent, ga, gb, f)``: what it gives to the first node up its chain that isn't on it, and to which."""
    compose = lambda own, ahead: F.when(ahead.isNull(), own).otherwise(F.struct(F.greatest(ahead["x"], ahead["y"] + own["x"]).alias("x"), (ahead["y"] + own["y"]).alias("y")))
    # a link leads to the parent while that has a single child; beyond its last one the chain's first node gives by its own g
    way = links.select("node", F.when(F.col("f").isNotNull(), F.col("parent")).alias("parent"), "f", F.col("node").alias("top"))
    got = followed(way, {"f": compose, "top": later})
    first = links.select(F.col("node").alias("top"), F.col("parent").alias("top_parent"), F.col("ga").alias("g1"), F.col("gb").alias("g2"))
    out = got.join(first, "top")
    # top's worth is f of the node's; what top gives is g of its worth
    on = F.col("f").isNotNull()
    return out.select(
        "node", "top_parent", F.when(on, F.greatest(F.col("g1"), F.col("g2") + F.col("f.x"))).otherwise(F.col("g1")).alias("top_ga"), F.when(on, F.col("g2") + F.col("f.y")).otherwise(F.col("g2")).alias("top_gb")
    )


def _below(links: DataFrame) -> DataFrame:
    """``(node, end, x, y)``: the worth of a node with a single child as a function of the worth of the end of its chain."""
    single = links.where("children = 1")
    child = links.where("f is not null").select(F.col("parent").alias("node"), F.col("node").alias("child"), "f")
    joined = single.select("node").join(child, "node")
    goes_on = single.select(F.col("node").alias("child"), F.lit(True).alias("on"))
    compose = lambda own, ahead: F.struct(F.greatest(own["x"], own["y"] + ahead["x"]).alias("x"), (own["y"] + ahead["y"]).alias("y"))
    way = joined.join(goes_on, "child", "left").select("node", F.when(F.col("on"), F.col("child")).alias("parent"), "f", F.col("child").alias("end"))
    return followed(way, {"f": compose, "end": later}).select("node", "end", "f.x", "f.y")


def density_clusters(points: DataFrame, least: int = 2, samples: int | None = None) -> DataFrame:
    """``(id, cluster, noise)`` of ``points(id, v)`` with vectors of one length.

    ``cluster`` is the least id of the point's cluster; a point in none is noise, and a cluster of its own. ``samples`` is the number of
    points, itself included, that a core distance reaches to. Fewer than two points are noise; one cluster of all is none.
    """
    return density_clusters_of_kinds(points.select("id", F.col("v").alias("kind")), points.select(F.col("v").alias("kind"), "v").distinct(), least, samples)


def density_clusters_of_kinds(rows: DataFrame, vectors: DataFrame, least: int = 2, samples: int | None = None) -> DataFrame:
    """The same of ``rows(id, kind)``, whose vectors are in ``vectors(kind, v)``; only distinct vectors are compared."""
    vectors = materialize(vectors.select("kind", "v"))
    first = vectors.groupBy("v").agg(F.min("kind").alias("first"))
    points = numbered(rows.join(vectors.join(first, "v").select("kind", "first"), "kind").select("id", F.col("first").alias("kind")), ["id", "kind"], "at")
    if points.count() < 2:
        return points.select("id", F.col("id").alias("cluster"), F.lit(True).alias("noise"))
    heads = materialize(points.groupBy("kind").agg(F.min("at").alias("id"), F.count("*").alias("n")))
    compared = materialize(heads.join(vectors, "kind").select("id", "v", "n"))
    cored = materialize(compared.join(core_distances(compared, samples or least), "id"))
    tree, hangs = spanning_tree(cored)
    to = hangs.join(cored.select("id", "core"), "id").join(heads.select("id", "kind"), "id")
    copies = points.select("at", "kind").join(to, "kind").where("at != id").select(F.col("to").alias("a"), F.col("at").alias("b"), F.col("core").alias("w"))
    clusters, fallen = condensed(materialize(tree.union(copies)), least)
    found = materialize(fallen.join(lasting(clusters), "cluster").select(F.col("id").alias("at"), "kept").join(points.select("at", "id"), "at").select("id", "kept"))
    names = found.where("kept is not null").groupBy("kept").agg(F.min("id").alias("name"))
    return found.join(names, "kept", "left").select("id", F.coalesce("name", "id").alias("cluster"), F.col("name").isNull().alias("noise"))
