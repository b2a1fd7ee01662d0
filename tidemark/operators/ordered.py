"""Clusters that depend on the order of rows: each row joins the first cluster that its terms overlap with, which then grows."""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import materialize, release
from .order import numbered

#: Sets of terms that are guessed in one task.
KINDS = 8192
#: What a row of such a task is: a term of a kind's first row, of a change that is given, or of what a cluster holds.
FIRST, GIVEN, HELD = 0, 1, 2


def first_fit(rows: DataFrame, overlap: float = 0.5) -> DataFrame:
    """``(id, cluster)`` of ``rows(id, terms)`` taken by rising id; a cluster is called by its first row.

    A row joins the first cluster, in the order in which they began, that shares at least ``overlap`` of the smaller set of terms; the
    cluster's set grows by the row's terms. Else it begins a cluster of its own. Rows without terms do so, too. Rows of one id come
    one after the other, by their terms.

    Rows of one set of terms are a kind, called by the first of them. A cluster that a kind has joined has all of its terms and
    fits it from then on, so a kind's later rows only go to the same cluster or to lesser ones: all answers follow from the
    events at which a kind first joins a cluster, hardly more than there are kinds, however often each is repeated.

    Kinds are settled in windows of ``KINDS``, by the order of their first rows. One task folds a window's first rows over what is
    settled. That is a guess only, since kinds that were there before may change to clusters that grow meanwhile. Given a guess of
    all events, what each cluster held when a row came follows from the times at which its terms entered, and so does the row's
    answer, for all kinds at once. Answers are right up to the first that differs from the guess; the changes that were
    found take part in the next fold, until nothing differs.

    A kind and a cluster are compared only if one of them has, among its rarest terms, one that the other holds: if the kind is the
    smaller set, it shares one of its rarest terms beyond half, else the cluster, as it was in one of its states that were
    smaller than the largest kind. A frequent term so brings no pairs of its own.
    """
    terms = F.array_sort(F.array_distinct(F.coalesce("terms", F.array().cast("array<string>"))))
    plain = numbered(rows.select("id", terms.alias("terms")), ["id", "terms"], "at")  # rows of one id are told apart
    some = plain.where(F.size("terms") > 0)
    sets = materialize(some.groupBy("terms").agg(F.min("at").alias("kind")))
    repeats = materialize(some.join(sets, "terms").select("at", "kind"))
    each = sets.select("kind", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    order = W.partitionBy("kind").orderBy("df", "term")
    terms = materialize(each.join(each.groupBy("term").agg(F.count("*").alias("df")), "term").withColumn("place", F.row_number().over(order) - 1))
    most, begin, last = terms.agg(F.max("n"), F.min("kind"), F.max("kind")).first()
    if begin is None:
        return plain.select("id", F.col("id").alias("cluster"))
    settled, end = None, begin - 1
    while end < last:
        begin = end + 1
        end = terms.where((F.col("place") == 0) & (F.col("kind") >= begin)).select("kind").orderBy("kind").limit(KINDS).agg(F.max("kind")).first()[0]
        if end == last:
            end = repeats.agg(F.max("at")).first()[0]
        base = None if settled is None else materialize(_entered(settled, terms))
        changes = None
        while True:
            guess = materialize(_folded(terms, F.col("kind").between(begin, end), base, changes, overlap))
            events = guess if settled is None else settled.union(guess)
            found = materialize(_answers(terms, repeats, events, settled, begin, end, most, overlap))
            if _same(guess, found):
                break
            changes = found.where("since != kind")
            release(guess)
        settled = materialize(events)
    # clusters of a kind fall with time, so a row is in the least that its kind has joined so far
    joined = repeats.join(settled, "kind").where("since <= at").groupBy("at").agg(F.min("cluster").alias("first"))
    named = joined.join(plain.select(F.col("at").alias("first"), F.col("id").alias("cluster")), "first").select("at", "cluster")
    return plain.select("id", "at").join(named, "at", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def _entered(events: DataFrame, terms: DataFrame) -> DataFrame:
    """``(cluster, term, df, since)``: when each term entered a cluster."""
    return events.join(terms.select("kind", "term", "df"), "kind").groupBy("cluster", "term", "df").agg(F.min("since").alias("since"))


def _folded(terms: DataFrame, fresh: Column, base: DataFrame | None, changes: DataFrame | None, overlap: float) -> DataFrame:
    """The events of the ``fresh`` kinds' first rows, taken one by one over the ``base`` that clusters hold before, and ``changes`` as given."""
    own = terms.where(fresh).select(F.lit(FIRST).alias("what"), F.col("kind").alias("at"), F.lit(0).cast("long").alias("cluster"), "kind", "term", F.lit(0).cast("long").alias("size"))
    todo = own if changes is None else own.union(changes.join(terms, "kind").select(F.lit(GIVEN), "since", "cluster", "kind", "term", F.lit(0).cast("long")))
    sides = todo
    if base is not None:  # of what clusters hold only terms that are asked for, and how many there are
        held = base.join(todo.select("term").distinct(), "term", "left_semi").join(base.groupBy("cluster").agg(F.count("*").alias("size")), "cluster")
        sides = todo.union(held.select(F.lit(HELD), F.lit(0).cast("long"), "cluster", F.lit(0).cast("long"), "term", "size"))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        steps, size, holders, out = defaultdict(list), {}, defaultdict(set), []
        for what, at, cluster, kind, term, n in zip(*(part[c].tolist() for c in ("what", "at", "cluster", "kind", "term", "size"))):
            if what == HELD:
                size[cluster] = n
                holders[term].add(cluster)
            else:
                steps[at, what, cluster, kind].append(term)
        for at, what, cluster, kind in sorted(steps):
            own = steps[at, what, cluster, kind]
            if what == FIRST:
                shared = Counter(c for t in own for c in holders[t])
                cluster = min((c for c, n in shared.items() if n >= overlap * min(len(own), size[c])), default=kind)
            for t in own:
                if cluster not in holders[t]:
                    holders[t].add(cluster)
                    size[cluster] = size.get(cluster, 0) + 1
            out.append((kind, cluster, at))
        return pd.DataFrame(out, columns=["kind", "cluster", "since"])

    return sides.groupBy(F.lit(0).alias("all")).applyInPandas(fold, "kind long, cluster long, since long")


def _same(a: DataFrame, b: DataFrame) -> bool:
    sides = a.select("*", F.lit(1).alias("side")).union(b.select("*", F.lit(-1)))
    return sides.groupBy(*a.columns).agg(F.sum("side").alias("side")).where("side != 0").isEmpty()


def _answers(terms: DataFrame, repeats: DataFrame, events: DataFrame, settled: DataFrame | None, begin: int, end: int, most: int, overlap: float) -> DataFrame:
    """The events from row ``begin`` to ``end`` that follow if clusters grow by ``events``: of kinds that begin there and, of those before,
    changes to lesser clusters than the ``settled`` ones."""
    entered = materialize(_entered(events, terms))
    states = entered.groupBy("cluster").agg(F.slice(F.sort_array(F.collect_list(F.struct("since", "df", "term"))), 1, most).alias("s"))
    rare = states.select("cluster", F.explode(_rare_in_some_state(F.col("s"), overlap)).alias("x")).select("cluster", "x.term")
    asking = terms.where(F.col("kind") <= end).select("kind", "n", "term", "place")
    if settled is not None:
        asking = asking.join(settled.groupBy("kind").agg(F.min("cluster").alias("now")), "kind", "left")
    asking = asking.withColumn("now", F.coalesce("now", "kind") if settled is not None else F.col("kind"))  # only lesser ones can be answers
    probes = asking.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * overlap))
    by_kind = probes.join(entered, "term").where("cluster < now").select("kind", "cluster")
    by_cluster = asking.join(rare, "term").where("cluster < now").select("kind", "cluster")
    pairs = by_kind.union(by_cluster).distinct()
    shared = pairs.join(asking, "kind").join(entered.select("cluster", "term", "since"), ["cluster", "term"])
    shared = shared.groupBy("kind", "cluster", "n", "now").agg(F.sort_array(F.collect_list("since")).alias("shared"))
    met = shared.join(states.select("cluster", F.transform("s", lambda x: x["since"]).alias("times")), "cluster")
    spans = met.select("kind", "cluster", "now", F.explode(_fitting(F.col("shared"), F.col("times"), F.col("n"), overlap)).alias("x")).select("kind", "cluster", "now", "x.lo", "x.hi")
    spans = materialize(spans.where(F.col("hi").isNull() | (F.col("hi") >= begin)))
    first = spans.where((F.col("kind") >= begin) & (F.col("lo") < F.col("kind")) & (F.col("hi").isNull() | (F.col("hi") >= F.col("kind")))).groupBy("kind").agg(F.min("cluster").alias("least"))
    fresh = terms.where((F.col("place") == 0) & F.col("kind").between(begin, end)).select("kind").join(first, "kind", "left")
    fresh = materialize(fresh.select("kind", F.coalesce("least", "kind").alias("cluster"), F.col("kind").alias("since")))
    lesser = spans.join(fresh.select("kind", F.col("cluster").alias("own")), "kind", "left").where(F.col("cluster") < F.coalesce("own", "now"))
    later = lesser.join(repeats.where(F.col("at").between(begin, end)), "kind").where("at > kind and at > lo and (hi is null or at <= hi)")
    later = later.groupBy("kind", "cluster").agg(F.min("at").alias("since"))
    before = F.min("cluster").over(W.partitionBy("kind").orderBy("since", "cluster").rowsBetween(W.unboundedPreceding, -1))
    lower = later.withColumn("before", before).where("before is null or cluster < before").select("kind", "cluster", "since")
    return fresh.union(lower)


def _fitting(shared: Column, times: Column, n: Column, overlap: float) -> Column:
    """The spans ``(lo, hi)`` of rows, above ``lo`` and up to ``hi``, or on without an end, at which a set of ``n`` terms fits a cluster: ``shared``
    are the times at which their common terms entered, ``times`` those of its first terms, as far as it may be the smaller one."""
    marks = F.array_sort(F.array_distinct(F.concat(shared, times)))

    def fits(a: Column) -> Column:
        upto = lambda some: F.size(F.filter(some, lambda t: t <= a))
        return upto(shared) >= overlap * F.least(n, upto(times))

    told = F.transform(marks, lambda a: F.struct(a.alias("a"), fits(a).alias("fits")))

    def turns(told: Column) -> Column:
        """Where fitting begins and ends, in turn."""
        return F.filter(told, lambda x, i: x["fits"] != F.when(i > 0, F.get(told, i - 1)["fits"]).otherwise(False))

    places = F.transform(turns(told), lambda x: x["a"])
    # every other one begins a span, which the next one ends
    begins = F.filter(places, lambda a, i: i % 2 == 0)
    ends = F.filter(places, lambda a, i: i % 2 == 1)
    return F.transform(begins, lambda a, i: F.struct(a.alias("lo"), F.get(ends, i).alias("hi")))


def _rare_in_some_state(s: Column, overlap: float) -> Column:
    """Of terms ``(since, df, term)`` in the order in which they entered: those that were among the rarest beyond the share that must
    overlap, in one of the states that followed."""

    def rare(x: Column, i: Column) -> Column:
        def state(j: Column) -> Column:
            before = F.filter(F.slice(s, 1, j), lambda y: F.struct(y["df"], y["term"]) < F.struct(x["df"], x["term"]))
            return F.size(before) <= j - F.ceil(j * overlap)

        return F.exists(F.sequence(i + 1, F.size(s)), state)

    marked = F.transform(s, lambda x, i: F.struct(x["term"].alias("term"), x["since"].alias("since"), rare(x, i).alias("rare")))
    return F.filter(marked, lambda x: x["rare"])
