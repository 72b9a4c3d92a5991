"""Text helpers for tags and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import number


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def street_name(tags: Column, locale: str = "en") -> Column:
    """The localized name, else the name, else the reference; blank if none or marked nameless."""
    given = [F.nullif(trimmed(tags[key]), F.lit("")) for key in (f"name:{locale}", "name", "ref")]
    return F.when(tags["noname"] == "yes", F.lit("")).otherwise(F.coalesce(*given, F.lit("")))


def slug(text: Column, dashes: bool = False) -> Column:
    """An identifier: lower case, runs of white space to one underscore, no other signs.

    With ``dashes`` a dash becomes an underscore, too.
    """
    t = F.regexp_replace(F.lower(trimmed(text)), r"\s+", "_")
    t = F.replace(t, F.lit("-"), F.lit("_")) if dashes else t
    return F.regexp_replace(t, "[^a-z0-9_]", "")


def numbers(text: Column) -> Column:
    """Comma-separated numbers as an array."""
    return F.transform(F.split(text, ","), number)


def south_west_north_east(bbox: Column) -> Column:
    """A west-south-east-north box in the order of tag queries."""
    return F.array(bbox[1], bbox[0], bbox[3], bbox[2])


def spliced(text: Column, at: int, length: int, put: str = "") -> Column:
    """``length`` characters from ``at`` on (0 is the first) replaced by ``put``."""
    return F.concat(F.substring(text, 1, at), F.lit(put), F.substring(text, F.lit(at + length + 1), F.char_length(text)))


def url_encoded(text: Column) -> Column:
    """A text as part of an address: letters, digits and ``-_.!~*'()`` stay, a blank is ``%20``."""
    out = F.url_encode(text)
    for code, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def has_ending(text: Column, *endings: str) -> Column:
    """Whether a file's name ends with one of the endings."""
    return F.exists(F.array(*map(F.lit, endings)), lambda e: F.endswith(text, e))


def build_stamp(today: Column) -> Column:
    """The day before, as digits."""
    return F.date_format(F.date_sub(today, 1), "yyyyMMdd")
