"""Column expressions with the catalogue's meaning of years, matches, blanks and ranks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_number(year: Column) -> Column:
    """The leading digits of a year held as text; 0 where there are none."""
    return F.coalesce(F.regexp_extract(year, r"^\s*(\d{1,9})", 1).try_cast("int"), F.lit(0))


def contains(column: Column, query: str) -> Column:
    """Case-insensitive literal substring match: % and _ in the query are ordinary signs."""
    return F.lower(column).contains(query.lower())


def any_contains(columns: Sequence[Column], query: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(contains(c, query), F.lit(False)) for c in columns])


def all_tokens(columns: Sequence[Column], query: str, most: int = 12) -> Column:
    """Every token of the query (up to ``most``) must be in one of the columns."""
    return reduce(lambda a, b: a & b, [any_contains(columns, t) for t in query.split()[:most]], F.lit(True))


def blank_to_null(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def enum_rank(column: Column, values: Sequence[str]) -> Column:
    """Place of a value in a list from 1; 0, so first, for a value that the list lacks."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), column), F.lit(0)).cast("int")


def priority(column: Column, ranks: dict[str, int], other: int = 0) -> Column:
    out = F
    for value, rank in ranks.items():
        out = out.when(column == value, rank)
    return out.otherwise(other)


def words(text: Column, least: int = 3) -> Column:
    """Lower-case runs of at least ``least`` letters a-z, in order, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{%d,}" % least), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def normal_doi(doi: Column) -> Column:
    """Lower case, without resolver or scheme; null unless it has the form 10.prefix/suffix."""
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/\S+$"), bare)


def identity_key(title: Column) -> Column:
    """Letters and digits of a title in lower case: equal keys are one title."""
    return F.regexp_replace(F.lower(title), "[^a-z0-9.]", "")


def within(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """Whether two numbers agree within an absolute or a relative tolerance of the second, whichever is wider."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.abs(b) * relative)


def spreadsheet_safe(text: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(text.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
