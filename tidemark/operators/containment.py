"""Which of many terms occur inside which texts, also inside words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 3


def grams(x: Column, size: int) -> Column:
    """All distinct substrings of a length."""
    places = F.sequence(F.lit(1), F.greatest(F.length(x) - (size - 1), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(places, lambda i: F.substring(x, i, F.lit(size))), lambda g: F.length(g) == size))


def contained(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(id, term)`` of all ``texts(id, text)`` and distinct ``terms(term)`` where the text holds the term; exact.

    Texts are indexed by their substrings of up to three letters. A term is looked up by the rarest of its own substrings
    in the texts, one only, and what is found there is verified; a term with a substring that no text has isn't looked up at
    all. Nothing is broadcast, since substrings are many times what Spark judges them by, and texts travel only to their candidates. Null and empty terms and null
    texts are left out.
    """
    terms = terms.where("term <> ''").distinct()
    sizes = sorted(r.n for r in terms.select(F.least(F.length("term"), F.lit(LONGEST)).alias("n")).distinct().collect())  # at most three rows
    if not sizes:
        return texts.select("id", F.lit("").alias("term")).where("false")
    every = F.concat(*[grams(F.col("text"), n) for n in sizes])
    index = texts.where("text is not null").select("id", F.explode(every).alias("gram"))
    own = F.filter(F.concat(*[F.when(F.least(F.length("term"), F.lit(LONGEST)) == n, grams(F.col("term"), n)).otherwise(F.array().cast("array<string>")) for n in sizes]), lambda g: g != "")
    asked = terms.select("term", F.explode(own).alias("gram"))
    often = index.join(asked.select("gram").distinct().hint("merge"), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    rarest = asked.join(often.hint("merge"), "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).where("r.df > 0")
    met = index.join(rarest.select("term", F.col("r.gram").alias("gram")).hint("merge"), "gram").select("id", "term")
    return met.join(texts.hint("merge"), "id").where(F.contains("text", "term")).select("id", "term")
