"""Parsing of text values with missing-value markers and mixed layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veleta.fixed_values import MISSING_NUMBERS, MISSING_TEXTS, MONTHS
from veleta.functions.texts import let


def is_missing_text(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(MISSING_TEXTS)


def usable_text(text: Column) -> Column:
    """Trimmed text, or null for a missing-value marker."""
    return F.when(~is_missing_text(text), F.trim(text))


def parse_number(text: Column) -> Column:
    """Double, or null for markers and unparseable text; -888 counts as a number."""
    number = let(F.lower(F.trim(text)), lambda t: F.when(~t.isin(MISSING_TEXTS), t.try_cast("double")))
    return let(number, lambda n: F.when(~F.isnan(n) & ~n.isin(MISSING_NUMBERS), n))


_CLOCK = r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?"
_ISO = rf"^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}([ T]{_CLOCK} ?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)?$"
_DAY_FIRST = r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})"
_NAMED = r"^([0-9]{1,2})[ -]([A-Za-z]+)[ -]([0-9]{4})"


def parse_timestamp(text: Column) -> Column:
    """Time in UTC without a zone; null when no layout fits.

    A date is year first, or day before month, or has an English month name; fields may have one digit. A time of day may
    follow, with seconds, a fraction, and after year-first dates a zone. Times without a zone are in UTC.
    """
    trimmed = F.trim(text)
    name = F.lower(F.regexp_extract(trimmed, _NAMED, 2))
    month = F.coalesce(*[F.when((name == m) | (name == m[:3]), F.lit(str(i + 1))) for i, m in enumerate(MONTHS)])
    named = F.concat(
        F.regexp_extract(trimmed, _NAMED, 3), F.lit("-"), month, F.lit("-"), F.regexp_extract(trimmed, _NAMED, 1),
        F.regexp_replace(trimmed, _NAMED, ""),
    )
    iso = F.when(trimmed.rlike(_NAMED), named).otherwise(F.regexp_replace(trimmed, _DAY_FIRST, "$3-$2-$1"))
    return let(iso, lambda i: F.when(i.rlike(_ISO), i)).try_cast("timestamp").cast("timestamp_ntz")


def parse_epoch(text: Column) -> Column:
    """Epoch milliseconds (> 1e11) or seconds (> 1e8), to the second.

    In a number no digit stands before one of - / : as in dates. Casting these would throw an exception per row.
    """
    number = F.when(~text.rlike("[0-9][-/:]"), F.trim(text).try_cast("double"))
    seconds = let(number, lambda n: F.when(n > 1e11, n / 1000.0).when(n > 1e8, n))
    return F.timestamp_seconds(F.floor(seconds)).cast("timestamp_ntz")


def present_name(raw: Column, names: Sequence[str]) -> Column:
    """The first of the names that is a key of the map: an intersection keeps the order of its first array."""
    return F.get(F.array_intersect(F.array(*map(F.lit, names)), F.map_keys(raw)), F.lit(0))


def first_present(raw: Column, names: Sequence[str]) -> Column:
    """Value of the first name that is a key of the map, whatever the value."""
    return raw[present_name(raw, names)]


def number_of(raw: Column, names: Sequence[str]) -> Column:
    """Number under the first name present; the map is searched once."""
    return let(first_present(raw, names), parse_number)


def first_usable(raw: Column, names: Sequence[str]) -> Column:
    """First value that is not a missing-value marker."""
    return F.coalesce(*[usable_text(raw[n]) for n in names])
