"""Normalizers of source spellings: Column in, Column out, all inside the JVM.

Three-valued throughout: null means that a source did not say, and is never turned to false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .payload import quoted


def lookup(table: dict[str, str], key: Column) -> Column:
    """A constant map's value, or null."""
    return F.try_element_at(F.expr(f"map({', '.join(quoted(x) for pair in table.items() for x in pair)})"), key)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def present(c: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(stripped(c) != "", F.lit(False))


def norm_token(c: Column) -> Column:
    return F.nullif(F.translate(F.upper(stripped(c)), "- ", "__"), F.lit(""))


def salary_period(c: Column) -> Column:
    return lookup(vocab.PERIODS, norm_token(c))


def salary_disclosed(c: Column) -> Column:
    t = norm_token(c)
    return F.when(t.isin(*vocab.EMPLOYER_SET), True).when(t.isin(*vocab.ESTIMATE_SET), False)


def language_base(c: Column) -> Column:
    base = F.lower(F.split_part(F.translate(stripped(c), "_", "-"), F.lit("-"), F.lit(1)))
    return F.when(base.rlike("^[a-z]{2,3}$"), base)


def epoch_ms(c: Column) -> Column:
    low, high = vocab.EPOCH_MS
    return F.when(c.between(low, high), F.timestamp_millis(c))


def by_precedence(values: Column, table: dict[str, str], order: Sequence[str]) -> Column:
    """values: an array of spellings. The first token of order that any of them means; their order does not matter."""
    mapped = F.transform(values, lambda v: lookup(table, norm_token(v)))
    return F.try_element_at(F.filter(F.expr(f"array({', '.join(map(quoted, order))})"), lambda p: F.array_contains(mapped, p)), F.lit(1))


def unknown_values(values: Column, table: dict[str, str]) -> Column:
    """The spellings that are neither mapped nor known to mean nothing."""
    return F.filter(values, lambda v: norm_token(v).isNotNull() & lookup(table, norm_token(v)).isNull() & ~norm_token(v).isin(*vocab.SILENT))


def employment_type(values: Column) -> Column:
    return by_precedence(values, vocab.EMPLOYMENT, vocab.EMPLOYMENT_ORDER)


def workplace_type(values: Column) -> Column:
    return by_precedence(values, vocab.WORKPLACE, vocab.WORKPLACE_ORDER)


def joined_labels(values: Column) -> Column:
    """Labels in their order, blanks dropped, joined by "; "; null if none."""
    return F.nullif(F.array_join(F.filter(F.transform(values, stripped), lambda v: v != ""), "; "), F.lit(""))


def first_text(values: Column) -> Column:
    return F.try_element_at(F.filter(values, present), F.lit(1))
