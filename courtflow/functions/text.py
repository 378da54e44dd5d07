"""Display texts as Column functions, and the fixed labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of the dimension tables.
SHOT_TYPES = ("forehand", "backhand", "forehand-volley", "backhand-volley", "overhead", "serve")
PATTERNS = ("net", "mid", "back", "staggered", "split")
ENDINGS = ("winner", "forced", "unforced")


def clock(seconds: Column) -> Column:
    """m:ss of a time in seconds, cut down to whole ones."""
    whole = F.floor(F.greatest(seconds, F.lit(0.0)))
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def percent(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def file_name(title: Column) -> Column:
    """Letters and digits of a title, lower-cased, joined by single dashes."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), F.lit("-"))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def signed(value: Column, unit: str, digits: int = 0) -> Column:
    """A difference with its sign and unit."""
    rounded = F.floor(F.abs(value) * 10**digits + 0.5) / 10**digits
    shown = rounded.cast("bigint").cast("string") if digits == 0 else F.format_string(f"%.{digits}f", rounded)
    return F.concat(F.when(value < 0, "-").otherwise("+"), shown, F.lit(unit))
