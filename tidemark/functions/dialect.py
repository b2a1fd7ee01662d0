"""Expressions that are written once and read by Spark SQL and by DuckDB, which checks them."""

from __future__ import annotations

import re
import re._parser as parser
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lookup:
    """Columns that a table has for a row: what they are called, which columns the row is looked up by, and how, in each engine.

    ``joined`` adds the columns to a DataFrame; ``tables`` and ``join`` are the common table expressions over a query's name, and the
    query that adds the columns to it.
    """

    columns: tuple[str, ...]
    reads: tuple[str, ...]
    joined: Callable[[DataFrame], DataFrame] | None
    tables: Callable[[str], str]
    join: Callable[[str], str]


Steps = list[dict[str, str] | Lookup]


class Dialect:
    """How each engine spells what they spell differently."""

    def __init__(self, spark: bool):
        self.spark = spark

    def pattern(self, p: str) -> str:
        return f"r'{p}'" if self.spark else f"'{p}'"

    def like(self, x: str, p: str) -> str:
        return f"regexp_like({x}, {self.pattern(p)})" if self.spark else f"regexp_matches({x}, '{p}')"

    def replace(self, x: str, p: str, by: str) -> str:
        """``by`` names groups as ``$1``."""
        return f"regexp_replace({x}, {self.pattern(p)}, '{by}')" if self.spark else f"regexp_replace({x}, '{p}', '{by.replace('$', chr(92))}', 'g')"

    def extract(self, x: str, p: str, group: int = 0) -> str:
        """The first match's group, empty without a match."""
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def every(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, {group})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def at(self, array: str, index: str) -> str:
        """The item at an index from 0."""
        return f"element_at({array}, cast({index} + 1 as int))" if self.spark else f"list_extract({array}, {index} + 1)"

    def size(self, array: str) -> str:
        return f"cast(size({array}) as bigint)" if self.spark else f"len({array})"

    def each(self, array: str, name: str, e: str) -> str:
        return f"transform({array}, {name} -> {e})" if self.spark else f"list_transform({array}, lambda {name}: {e})"

    def kept(self, array: str, name: str, e: str) -> str:
        return f"filter({array}, {name} -> {e})" if self.spark else f"list_filter({array}, lambda {name}: {e})"

    def some(self, array: str, name: str, e: str) -> str:
        return f"exists({array}, {name} -> {e})" if self.spark else f"(len(list_filter({array}, lambda {name}: {e})) > 0)"

    def distinct(self, array: str) -> str:
        return f"array_sort(array_distinct({array}))" if self.spark else f"list_sort(list_distinct({array}))"

    def lowest(self, array: str) -> str:
        return f"array_min({array})" if self.spark else f"list_min({array})"

    def place(self, array: str, x: str) -> str:
        """The place of an item from 1, 0 where it isn't there."""
        return f"array_position({array}, {x})" if self.spark else f"coalesce(list_position({array}, {x}), 0)"

    def has(self, array: str, x: str) -> str:
        return f"array_contains({array}, {x})" if self.spark else f"list_contains({array}, {x})"

    def joined(self, array: str, by: str) -> str:
        return f"concat_ws('{by}', {array})" if self.spark else f"array_to_string({array}, '{by}')"

    def shared(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})" if self.spark else f"list_intersect({a}, {b})"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.pattern(p)})" if self.spark else f"regexp_split_to_array({x}, '{p}')"

    def contains(self, x: str, y: str) -> str:
        return f"contains({x}, {y})"

    def exploded(self, columns: str, array: str, name: str, source: str) -> str:
        """A query with one row for each item; rows without items are left out."""
        return f"select {columns}, explode({array}) as {name} from {source}" if self.spark else f"select {columns}, unnest({array}) as {name} from {source}"


    def several(self, key: str, items: list[dict[str, str]], source: str, where: str = "true") -> str:
        """A query with a row for each item of each row, which is read once."""
        pack = (lambda x: "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in x.items()) + ")") if self.spark else (lambda x: "struct_pack(" + ", ".join(f"{n} := {e}" for n, e in x.items()) + ")")
        names = ", ".join(f"item.{n} as {n}" for n in items[0])
        inner = self.exploded(key, self.array(*map(pack, items)), "item", source)
        return f"select * from (select {key}, {names} from ({inner}) several_items) several where {where}"


SPARK, DUCKDB = Dialect(True), Dialect(False)


def number(x: float) -> str:
    """A double in both engines; without an exponent they read decimals."""
    return f"{x!r}e0"


def rounded(x: str, places: int = 4) -> str:
    """Ties of products of decimals round up, on whichever side of the tie their doubles lie."""
    return f"round({x} + 1e-9, {places})"


def interpolated(x: str, knots: list[tuple[float, float]]) -> str:
    """Piecewise-linear between knots, clamped at the ends."""
    whens = [f"when {x} is null then null when {x} <= {number(knots[0][0])} then {number(knots[0][1])}"]
    whens += [f"when {x} <= {number(b)} then {number(c)} + ({x} - {number(a)}) * {number((d - c) / (b - a))}" for (a, c), (b, d) in zip(knots, knots[1:])]
    return rounded(f"(case {' '.join(whens)} else {number(knots[-1][1])} end)")


def necessary(pattern: str, least: int = 3) -> frozenset[str] | None:
    """Literals of which every match of a pattern holds at least one, as long ones as there are; none if that can't be told."""

    def of(parsed) -> frozenset[str] | None:
        found, run = [], ""
        for kind, value in [*parsed, (None, None)]:
            if kind is parser.LITERAL and "'" != chr(value):
                run += chr(value)
                continue
            if len(run) >= least:
                found.append(frozenset({run}))
            run = ""
            if kind is parser.SUBPATTERN:
                found.append(of(value[-1]))
            elif kind is parser.MAX_REPEAT and value[0] >= 1:
                found.append(of(value[-1]))
            elif kind is parser.BRANCH:
                branches = [of(b) for b in value[1]]
                found.append(None if None in branches else frozenset().union(*branches))
        return max((f for f in found if f), key=lambda f: (min(map(len, f)), -len(f)), default=None)

    return of(parser.parse(pattern))


def names_in(sql: str) -> set[str]:
    """All names in an expression or query, in lower case; text in quotes has none."""
    return {n.lower() for n in re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", " ", sql))}


def needed(steps: Steps, wanted: Iterable[str]) -> list[tuple[dict[str, str] | Lookup, set[str]]]:
    """The steps without what ``wanted`` doesn't depend on, each with the names that are still read after it."""
    live, out = {n.lower() for n in wanted}, []
    for step in reversed(steps):
        after = set(live)
        if isinstance(step, Lookup):
            if live & set(step.columns):
                live |= set(step.reads)
                out.append((step, after))
            continue
        kept = {n: e for n, e in step.items() if n in live}
        if kept:
            for e in kept.values():
                live |= names_in(e)
            out.append((kept, after))
    return out[::-1]


def stepped(df: DataFrame, steps: Steps, wanted: Iterable[str] | None = None) -> DataFrame:
    """Add each step's columns; with ``wanted`` only what these depend on is worked out, and only these and ``df``'s own stay.

    Each step ends in a generator, so that a filter on its columns doesn't copy their expressions.
    """
    plan = needed(steps, wanted) if wanted is not None else [(step, None) for step in steps]
    for step, after in plan:
        if isinstance(step, Lookup):
            df = step.joined(df)
        else:
            df = df.selectExpr("*", *[f"{e} as {name}" for name, e in step.items()])
        kept = [c for c in df.columns if after is None or c.lower() in after]
        df = df.select(*kept) if isinstance(step, Lookup) else df.select(F.inline(F.array(F.struct(*kept))))
    return df


def stepped_ctes(base: str, steps: Steps, name: str, prefix: str = "s") -> str:
    """The common table expressions of the same steps over the query ``base``; the last one is called ``name``."""
    parts = [f"{prefix}0 as ({base})"]
    for k, step in enumerate(steps):
        last = f"{prefix}{k}"
        if isinstance(step, Lookup):
            parts += [step.tables(last), f"{prefix}{k + 1} as ({step.join(last)})"]
        else:
            parts.append(f"{prefix}{k + 1} as (select *, {', '.join(f'{e} as {n}' for n, e in step.items())} from {last})")
    return f"{', '.join(parts)}, {name} as (select * from {prefix}{len(steps)})"


def stepped_sql(base: str, steps: Steps, name: str = "posts") -> str:
    return f"with {stepped_ctes(base, steps, name)} "
