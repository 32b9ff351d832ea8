"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_div(value: Column, by: int) -> Column:
    """Whole-number division rounding down, exact for every BIGINT."""
    return (value - F.pmod(value, F.lit(by))).cast("bigint") / F.lit(by)


def bucket(value: Column, by: int) -> Column:
    return floor_div(value, by).cast("bigint")


def nearest_rank(count: Column, fraction: float) -> Column:
    """Position of a percentile: half-even rounding of fraction * n, within 1..n."""
    return F.greatest(F.lit(1), F.least(count, F.bround(F.lit(float(fraction)) * count, 0).cast("bigint")))


def nearest_rank_of(values: Column, fraction: float) -> Column:
    """The percentile of an array of numbers; NULL where it is empty."""
    ordered = F.array_sort(values)
    size = F.size(values).cast("bigint")
    return F.when(size > 0, F.element_at(ordered, nearest_rank(size, fraction).cast("int")))


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, NULL where whole is 0."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def hour_key(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd-HH")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    name = f"_ew_{wanted}"
    while name.lower() in taken:
        name += "_"
    return name


def uuid_key(identifier: Column) -> Column:
    """Bytes that are equal exactly where two identifiers are the same.

    A UUID counts as the same in either case, with or without hyphens, braces, blanks around it or a urn prefix. Any other
    text stands for itself without the blanks around it; its key is longer than 16 bytes, so it never meets a UUID's.
    NULL and blank text give NULL: no identity.
    """
    text = F.regexp_replace(identifier, r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"^(urn:uuid:)?\{?|\}$", ""), "-", "")
    plain = F.replace(identifier, F.lit("-"), F.lit(""))  # the usual form, without a pattern; anything but hex digits gives NULL
    other = F.when(bare.rlike("^[0-9a-f]{32}$"), F.unhex(bare)).when(F.length(text) > 0, F.concat(F.unhex(F.lit("00" * 17)), F.encode(text, "utf-8")))
    return F.coalesce(F.when(F.length(plain) == 32, F.unhex(plain)), other)
