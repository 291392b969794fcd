"""Scalar column functions that the operators share. All are built-in expressions: they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arguments may be names or columns.
Name = Column | str


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quantised(x: Name, digits: int = 6) -> Column:
    """Rounded half up on doubles, in the same way in any engine with IEEE arithmetic."""
    scale = float(10**digits)
    return (F.floor(col(x).cast("double") * scale + 0.5).cast("double") / scale).cast("double")


def clean_name(x: Name) -> Column:
    """Lower case, trimmed, runs of white space made one space."""
    return F.lower(F.trim(F.regexp_replace(col(x), r"\s+", " ")))


def not_blank(x: Name) -> Column:
    """Neither null, blank nor the text "nan"."""
    return col(x).isNotNull() & (F.trim(col(x)) != "") & (F.lower(F.trim(col(x))) != "nan")


def epoch_seconds(ts: Name) -> Column:
    """Seconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    t = col(ts)
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))


def lenient_epoch(x: Name) -> Column:
    """Text to epoch seconds; 0 where it is no time."""
    return F.coalesce(epoch_seconds(F.try_to_timestamp(col(x)).cast("timestamp_ntz")), F.lit(0).cast("bigint"))


def draw(seed: int, *keys: Name) -> Column:
    """A hashed draw: orders and samples rows alike on any partitioning, and in plain SQL."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def draw_int(seed: int, *keys: Name) -> Column:
    """The first 32 bits of a hashed draw."""
    return F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("bigint")


def json_list(x: Name) -> Column:
    """A JSON list of strings; empty where the text is no list."""
    return F.coalesce(F.from_json(col(x), "array<string>"), F.array().cast("array<string>"))


def split_list(x: Name, by: str = ",") -> Column:
    """Non-empty trimmed parts of a joined list."""
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), by), lambda x: F.trim(x)), lambda y: y != "")


def sorted_tags(x: Name) -> Column:
    """Distinct tags in case-insensitive order, ties in binary order."""
    keyed = F.transform(F.array_distinct(col(x)), lambda t: F.struct(F.lower(t).alias("k"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda s: s["t"])


def description(x: Name, is_list: bool) -> Column:
    """A description given as text or as a list of texts."""
    if is_list:
        return F.trim(F.array_join(F.filter(F.transform(col(x), lambda x: F.trim(x)), lambda y: y.isNotNull() & (y != "")), " "))
    return F.trim(F.coalesce(col(x), F.lit("")))


def joined_text(*columns: Name, by: str = " ") -> Column:
    """Columns joined; nulls and blanks are left out."""
    return F.trim(F.concat_ws(by, *[F.nullif(F.trim(col(c)), F.lit("")) for c in columns]))


def clipped(x: Name, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def decimals(x: Name, n: int = 12) -> Column:
    return F.format_string(f"%.{n}f", col(x).cast("double"))


def scientific(x: Name) -> Column:
    return F.format_string("%.6e", col(x).cast("double"))


def finite(x: Name, other: float) -> Column:
    """The value, or `other` for null and NaN."""
    return F.coalesce(F.nanvl(col(x).cast("double"), F.lit(other)), F.lit(other))
