"""Column helpers: lists of factors and alerts kept in order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def texts(values: Iterable[str]) -> Column:
    """An array of literal texts; an empty one has a type too."""
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def present(*items: Column) -> Column:
    """The items that aren't null, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


#: Stands for a text that isn't there.
ABSENT = "\0"


def present_texts(*items: Column) -> Column:
    """The texts that aren't null, in order, as in present, but compiled: no function is called for each item."""
    return F.array_remove(F.array(*(F.coalesce(i, F.lit(ABSENT)) for i in items)), ABSENT)


def contains_any(column: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found |= F.contains(column, F.lit(word))
    return F.coalesce(found, F.lit(False))


def words_in(column: Column, words: Iterable[str]) -> Column:
    """The words that the column contains, in the words' order."""
    text = F.coalesce(column, F.lit(""))
    return present_texts(*(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words))


def first_of(column: Column, cases: Iterable[tuple[Iterable[str], object]], otherwise: object) -> Column:
    """The value of the first case any of whose words the column contains."""
    out = None
    for words, value in cases:
        hit = contains_any(column, words)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, texts([]))
