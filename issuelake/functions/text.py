"""Text expressions: words, tokens, identifiers, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Pieces between white space; 0 for null, empty and blank."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t\r\n]+"), lambda x: x != "")), F.lit(0))


def split_identifiers(text: Column) -> Column:
    """Underscores, hyphens and camel-case borders become blanks; collapsed, in lower case."""
    spaced = F.regexp_replace(F.translate(text, "_-", "  "), "([a-z])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(spaced, "[ \t\r\n]+", " ")))


def plain_path(path: Column) -> Column:
    """Forward slashes and no leading ./"""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")


def leaf(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def ends_with_path(long: Column, short: Column) -> Column:
    """Equal, or `long` ends with a slash and `short`."""
    return (long == short) | long.endswith(F.concat(F.lit("/"), short))


def mentioned_paths(text: Column) -> Column:
    """Paths to source files mentioned in a text, in the order of their first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+(?:/[A-Za-z0-9_]+)+\.(?:py|js|ts|go|rs|java|c)"), F.lit(0)))


def token_estimate(text: Column) -> Column:
    """Characters div 4, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def iso_time(text: Column) -> Column:
    """A timestamp from the notations in use, null where none fits."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def uuid5(name: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """The version 5 UUID of a name; the default namespace is that of addresses."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8).cast("bigint")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def line_range(text: Column, default_to: int = 30) -> Column:
    """A struct (first, last) from 'a-b'; 'a' is one line; anything else is 1 to default_to."""
    a, b = F.regexp_extract(text, r"^ *(\d+) *(?:- *(\d+))? *$", 1), F.regexp_extract(text, r"^ *(\d+) *(?:- *(\d+))? *$", 2)
    fits = F.coalesce(a != "", F.lit(False))
    first = F.when(fits, a.try_cast("int")).otherwise(1)
    last = F.when(fits & (b != ""), b.try_cast("int")).when(fits, a.try_cast("int")).otherwise(default_to)
    return F.struct(first.alias("first"), last.alias("last"))


def filled(*parts: Column) -> Column:
    """The first part that is neither null nor empty."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts])
