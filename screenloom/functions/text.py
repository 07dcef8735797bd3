"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(c: Column) -> Column:
    """Null to ``''``, runs of white space to one space, no space at the ends."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def readable_resource_name(c: Column) -> Column:
    """The last part of a resource id, with spaces for underscores."""
    return F.trim(F.replace(F.substring_index(c, "/", -1), F.lit("_"), F.lit(" ")))


def icon_norm(c: Column) -> Column:
    """An icon label without the words and signs that don't tell icons apart."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "图标", "")
    return F.trim(F.translate(F.regexp_replace(bare, "icon", ""), "：， -_。.", ":,"))


def escape_name(c: Column) -> Column:
    """A name as it stands between quotes in a snapshot."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
