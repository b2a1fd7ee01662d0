"""Unicode forms: case folding, compatibility decomposition with marks in canonical order, and without marks.

Built-in functions have none of these. The standard library has them for whole texts, so Python runs in the tasks, on Arrow
batches; as expressions over single characters they took a hundred times as long. All code points count, those beyond 16 bits, too.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SURROGATES = range(0xD800, 0xE000)
URL, MENTION, SPACE = re.compile(r"https?://\S+|www\.\S+"), re.compile(r"@\w+"), re.compile(r"\s+")
DOTTED = str.maketrans("ıİI", "iii")


@functools.cache
def marks() -> re.Pattern:
    """Runs of characters that combine with the one before."""
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c)) + "]+")


def unmarked(t: str) -> str:
    return t if t.isascii() else marks().sub("", t)


def compared(t: str) -> str:
    t = MENTION.sub(" <kullanici> ", URL.sub(" <url> ", t.casefold()))
    return SPACE.sub(" ", unmarked(unicodedata.normalize("NFKD", t)).translate(DOTTED)).strip()


def _each(change):
    """``change(text)`` of each text of a column, null of null."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else change(t) for t in texts], dtype=object)

    return run


_casefold, _nfkd, _unmarked, _compared = map(_each, (str.casefold, functools.partial(unicodedata.normalize, "NFKD"), unmarked, compared))


def casefold(x: Column) -> Column:
    return _casefold(x)


def nfkd(x: Column) -> Column:
    """The compatibility decomposition: characters may become several, and marks that follow each other stand in canonical order."""
    return _nfkd(x)


def without_marks(x: Column) -> Column:
    return _unmarked(x)


def comparable(x: Column) -> Column:
    """A text as it is compared: case folded, links and names masked, decomposed without marks, every I dotted, white space as one."""
    return _compared(x)
