"""Text helpers on columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators 1C to 1F, which Python's
# str.strip() also removes.
_SPACE = r"[\s\x1c-\x1f]"
_NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"


def strip(value: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(value, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def is_blank(value: Column) -> Column:
    """True for NULL, empty and white space only."""
    return ~F.coalesce(value.rlike(_NOT_SPACE), F.lit(False))


def not_blank(value: Column) -> Column:
    return F.coalesce(value.rlike(_NOT_SPACE), F.lit(False))


def truncate(value: Column, limit: int | None) -> Column:
    """First ``limit`` characters; all of them for None."""
    return value if limit is None else F.substring(value, 1, limit)


def shorten(value: Column, limit: int) -> Column:
    """Longer values are cut and get three dots, others stay as they are."""
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("..."))).otherwise(value)


def label(value: Column, limit: int) -> Column:
    """Cut to ``limit`` characters and always add three dots."""
    return F.concat(F.substring(F.coalesce(value, F.lit("")), 1, limit), F.lit("..."))


def title_key(title: Column) -> Column:
    """What titles are compared by: letters and digits in lower case, all else one space; NULL if none."""
    kept = F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))
    return F.nullif(kept, F.lit(""))


def safe_title(title: Column) -> Column:
    """Title as a file name: letters, digits, space, ``-`` and ``_`` survive,
    spaces become underscores, at most 50 characters."""
    kept = F.rtrim(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", ""))
    return F.substring(F.replace(kept, F.lit(" "), F.lit("_")), 1, 50)


def fill_template(template: str, **values: Column) -> Column:
    """A ``{name}`` template as one concat of literals and columns.

    The template is cut up on the driver, so a filled-in value that itself holds
    braces is never looked at again. ``{{`` and ``}}`` stand for single braces.
    A name with no column raises KeyError; a NULL value fills in as nothing.
    """
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")
