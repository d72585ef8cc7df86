"""Text expressions, all of them built-in functions of the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = "[A-Za-z0-9]+"
PAGE_ROOT = "https://en.wikipedia.org/wiki/"
ABSTRACT_CHARS = 600


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased after they are found.

    Lower-casing first would let letters like U+212A turn into ASCII ones.
    """
    return F.transform(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), lambda w: F.lower(w))


def words(text: str) -> list[str]:
    """tokens for a string on the driver."""
    return [w.lower() for w in re.findall(_RUN, text)]


def searchable(title: Column, text: Column) -> Column:
    """One position space for title and text."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))


def cleaned(text: Column) -> Column:
    """Runs of Unicode white space (with \\x1c to \\x1f) as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def abstract(opening: Column, text: Column, size: int = ABSTRACT_CHARS) -> Column:
    """The opening, or where that is missing or empty the text: cleaned, then cut to size code points."""
    return F.substring(cleaned(F.coalesce(F.nullif(opening, F.lit("")), text)), 1, size)


def page_url(title: Column) -> Column:
    return F.concat(F.lit(PAGE_ROOT), F.replace(title, F.lit(" "), F.lit("_")))
