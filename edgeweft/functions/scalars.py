"""Expressions over columns; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of the products of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def abs_differences(a: Column, b: Column) -> Column:
    """Elementwise absolute differences of two arrays."""
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def scaled(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(factor))


def array_sum(a: Column) -> Column:
    return F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda t, x: t + x)


def cumulative(a: Column) -> Column:
    """Running sums of an array."""
    start = F.struct(F.lit(0.0).alias("t"), F.array().cast("array<double>").alias("out"))
    step = lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.array_append(acc["out"], acc["t"] + x).alias("out"))
    return F.aggregate(a.cast("array<double>"), start, step, lambda acc: acc["out"])


def arg_max(a: Column) -> Column:
    """First position, from 0, of the largest element."""
    return F.array_position(a, F.array_max(a)) - 1


def arg_min(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)) - 1


def capped_intersection(a: Column, b: Column, cap: int) -> Column:
    """Number of common elements, at most ``cap``."""
    return F.least(F.size(F.array_intersect(a, b)), F.lit(cap))


def contains_all(a: Column, b: Column) -> Column:
    """Whether array a holds all elements of array b."""
    return F.size(F.array_except(b, a)) == 0


def sorted_map(m: Column, descending: bool = False) -> Column:
    """Entries of a map as an array of (value, key), sorted by value."""
    return F.sort_array(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key"))), not descending)


def base_name(file: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(file, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def label_id(text: Column) -> Column:
    """The id of a label line: the digits after the last dash, or the whole."""
    return F.element_at(F.split(F.trim(text), "-"), -1).try_cast("bigint")


def size_number(text: Column) -> Column:
    """Number of a size like 3.5K, 12M or 1G; plain numbers stay, anything else is null."""
    number = F.regexp_extract(F.trim(text), r"^([0-9.]+)\s*([KMGkmg]?)B?$", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(F.trim(text), r"^([0-9.]+)\s*([KMGkmg]?)B?$", 2))
    return number * F.when(unit == "K", 1024.0).when(unit == "M", 1024.0**2).when(unit == "G", 1024.0**3).otherwise(1.0)


def rounded_text(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def flexible_timestamp(text: Column) -> Column:
    """Timestamp of the formats that run statistics use; null for others."""
    formats = ("yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats])


def same_text(a: Column, b: Column) -> Column:
    """Equality without case."""
    return F.lower(a) == F.lower(b)


def or_none(x: Column) -> Column:
    """-1 for null, as files hold it."""
    return F.coalesce(x, F.lit(-1))


def renamed(x: Column, names: dict[str, str]) -> Column:
    """Values replaced by their display names; others stay."""
    if not names:
        return x
    mapping = F.create_map(*[F.lit(y) for pair in names.items() for y in pair])
    return F.coalesce(mapping[x], x)
