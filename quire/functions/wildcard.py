"""Wildcard patterns: `*`, `?`, `[set]`, `[^set]`, a leading `^` inverts, a backslash takes the next character as it is."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand_ranges(pattern: str) -> str:
    """`[a-d]` becomes `[abcd]`."""
    return re.sub(r"\[([^\]]*)\]", lambda m: "[" + re.sub(r"(.)-(.)", lambda r: "".join(map(chr, range(ord(r[1]), ord(r[2]) + 1))), m[1]) + "]", pattern)


def to_regex(pattern: str) -> tuple[str, bool]:
    """An anchored regular expression (Java and Python alike) and whether the match is inverted."""
    inverted = pattern.startswith("^")
    rest, out = pattern[inverted:], []
    i = 0
    while i < len(rest):
        c = rest[i]
        if c == "\\" and i + 1 < len(rest):
            i += 1
            out.append(re.escape(rest[i]))
        elif c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[" and "]" in rest[i + 1 :]:
            end = rest.index("]", i + 1)
            body, no = rest[i + 1 : end], ""
            if body.startswith("^"):
                body, no = body[1:], "^"
            out.append("[" + no + re.sub(r"([\\\[\]^&~|])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + r"\z", inverted


def matches(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    regex, inverted = to_regex(pattern)
    found = column.rlike(("(?i)" if ignore_case else "") + regex)
    return ~found if inverted else found


def select_names(names: list[str], *patterns: str) -> list[str]:
    """The names that any of the patterns matches, in the order of names."""
    tests = [to_regex(p) for p in patterns]
    return [n for n in names if any(bool(re.match(r.replace(r"\z", r"\Z"), n)) != inv for r, inv in tests)]


def columns_like(df: DataFrame, *patterns: str, numeric: bool = False) -> list[str]:
    kinds = dict(df.dtypes)
    number = lambda c: kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
    return [c for c in select_names(df.columns, *patterns) if not numeric or number(c)]


def like_any(column: Column, *patterns: str) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(column, p)
    return out
