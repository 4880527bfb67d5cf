"""Text functions of the transformation language, as builders of columns.

Every one is null for a null text unless it says otherwise. Patterns are searched
anywhere in the text; the common subset of Python's and Java's syntax is meant.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strftime directives and the pattern letters that mean the same.
DATE_DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a",
    "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "j": "DDD",
}
LENIENT = {"m": "M", "d": "d", "H": "H", "M": "m", "S": "s", "I": "h"}


def date_pattern(strftime: str, lenient: bool = False) -> str:
    """A strftime format as a pattern of Spark's; lenient accepts one digit where two are usual."""
    out = []
    for directive, plain in re.findall(r"%(.)|([^%]+)", strftime):
        if plain:
            out.append(re.sub(r"([A-Za-z]+)", r"'\1'", plain.replace("'", "''")))
        elif directive == "%":
            out.append("%")
        elif directive in DATE_DIRECTIVES:
            out.append((lenient and LENIENT.get(directive)) or DATE_DIRECTIVES[directive])
        else:
            raise ValueError(f"%{directive} isn't supported in a date format")
    return "".join(out)


def _pattern(pattern: str, match_case: bool) -> str:
    re.compile(pattern)
    return pattern if match_case else "(?i)" + pattern


def concat(first: Column, second: Column, *more: Column) -> Column:
    return F.concat(first, second, *more)


def trim(s: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+$", "")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+", "")


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def length(s: Column) -> Column:
    return F.length(s).cast("bigint")


def extract(s: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match."""
    groups = re.compile(pattern).groups
    if not 1 <= group <= groups:
        raise ValueError(f"the pattern has {groups} groups, {group} is asked for")
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def starts_with(s: Column, start: str) -> Column:
    return s.startswith(start)


def ends_with(s: Column, end: str) -> Column:
    return s.endswith(end)


def get(s: Column, index: int) -> Column:
    """One character, counted from 0, or from the end if negative; null outside."""
    inside = F.length(s) > index if index >= 0 else F.length(s) >= -index
    return F.when(inside, F.substring(s, index + 1 if index >= 0 else index, 1))


def contains(s: Column, pattern: str, match_case: bool = True) -> Column:
    return s.rlike(_pattern(pattern, match_case))


def replace(s: Column, pattern: str, by: str, match_case: bool = True) -> Column:
    r"""All matches replaced; ``\1`` in ``by`` is the first group."""
    java = re.sub(r"\\g<(\d+)>|\\(\d)", lambda m: "${" + (m[1] or m[2]) + "}", by.replace("$", "\\$"))
    return F.regexp_replace(s, _pattern(pattern, match_case), re.sub(r"\$\{(\d+)\}", r"$\1", java))


def repeat(s: Column, times: int) -> Column:
    return F.repeat(s, times)


def pad(s: Column, width: int, side: str) -> Column:
    """Blanks at ``side`` (left, right, both) up to ``width``; longer texts stay whole."""
    if side not in ("left", "right", "both"):
        raise ValueError("side is left, right or both")
    missing = F.lit(width) - F.length(s)
    if side == "both":
        # an odd blank goes to the left of an odd width, to the right of an even one
        before = F.floor((missing + (width % 2)) / 2).cast("int")
        padded = F.concat(F.repeat(F.lit(" "), before), s, F.repeat(F.lit(" "), missing - before))
    else:
        padded = F.lpad(s, width, " ") if side == "left" else F.rpad(s, width, " ")
    return F.when(missing <= 0, s).otherwise(padded)


def count(s: Column, pattern: str) -> Column:
    """Matches in each text, without overlap."""
    return F.regexp_count(s, F.lit(pattern)).cast("bigint")


def substring(s: Column, start: int, size: int | None = None) -> Column:
    if start < 1 or (size is not None and size < 1):
        raise ValueError("start and length are at least 1")
    return F.substring(s, start, 2**31 - 1 if size is None else size)


def to_char(value: Column, strftime: str | None = None) -> Column:
    """A timestamp by its format, anything else as text."""
    return value.cast("string") if strftime is None else F.date_format(value, date_pattern(strftime))


def xpath(s: Column, path: str) -> Column:
    """The one text or attribute that a path finds in an XML text; null for none, an error for several."""
    found = F.xpath(s, F.lit(path))
    return F.when(F.size(found) == 1, found[0]).when(F.size(found) > 1, F.raise_error(F.lit(f"{path} finds more than one")).cast("string"))
