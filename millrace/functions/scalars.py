"""Scalar functions of the pipelines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(line: Column, separator: str = ",") -> Column:
    """The parts of a line; no quoting, empty parts stay."""
    return F.split(line, "[" + separator + "]" if len(separator) == 1 and separator not in "^\\]" else separator, -1)


def field_or_empty(parts: Column, index: int) -> Column:
    """Part ``index`` (from 0), or an empty string where the line has fewer."""
    return F.coalesce(F.get(parts, F.lit(index)), F.lit(""))


def parse_decimal(text: Column, precision: int = 18, scale: int = 2) -> Column:
    """A decimal, or null: blanks around, a sign and thousands separators are allowed, exponents are not."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"^[+-]?[0-9][0-9,]*(\.[0-9]*)?$|^[+-]?\.[0-9]+$"), F.regexp_replace(plain, ",", "").try_cast(f"decimal({precision},{scale})"))


def parse_int(text: Column) -> Column:
    """A 32-bit integer, or null."""
    return F.when(F.trim(text).rlike("^[+-]?[0-9]+$"), F.trim(text).try_cast("int"))


def round_half_even(value: Column, scale: int = 2) -> Column:
    return F.bround(value, scale)


def is_blank(text: Column) -> Column:
    """Null, empty or white space only (any Unicode white space)."""
    return text.isNull() | text.rlike(r"^[\s\p{Z}\x85]*$")


def format_parameters(parameters: Column) -> Column:
    """``k=v, k=v`` by key, or ``(none)``."""
    pairs = F.transform(F.array_sort(F.map_entries(parameters)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(parameters.isNull() | (F.size(parameters) == 0), F.lit("(none)")).otherwise(F.array_join(pairs, ", "))


def canonical_parameters(parameters: Column) -> Column:
    """JSON with sorted keys."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(parameters)))), F.lit("{}"))


def format_time(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))


def format_duration(start: Column, end: Column) -> Column:
    """``HH:MM:SS`` with hours beyond 24 where needed, or ``-`` while there is no end."""
    seconds = F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000).cast("long")
    return F.when(start.isNull() | end.isNull(), F.lit("-")).otherwise(F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long"), seconds % 60))


def page_url(base: Column, page: Column) -> Column:
    """``base?page=n``, or ``base&page=n`` where the base has a query already."""
    return F.concat(base, F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("page="), page.cast("string"))


def exit_name(status: Column) -> Column:
    return F.upper(status)
