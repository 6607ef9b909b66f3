"""A cursor language for editing strings, applied to a column.

Commands, each with an optional repeat count before it: `f` `b` move, `a` `e` to the start or end, `d` delete, `K` kill to
the end, `k` kill a character into the buffer, `Z` kill all but the cursor's left, `y` yank, `i/text/` insert,
`s/text/` search (cursor before), `S/text/` search (cursor after), `%/old/new/` replace from the cursor on, `%g/old/new/`
replace everywhere, `u` `l` upper or lower case of the character, `U` `L` of the rest. The delimiter is the character
after the command.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(commands: str) -> list[tuple[int, str, list[str]]]:
    out, i = [], 0
    while i < len(commands):
        digits = i
        while i < len(commands) and commands[i].isdigit():
            i += 1
        count = int(commands[digits:i] or 1)
        if i >= len(commands):
            break
        name, args = commands[i], []
        i += 1
        if name == "%" and commands[i : i + 1] == "g":
            name, i = "%g", i + 1
        for _ in range({"i": 1, "s": 1, "S": 1, "%": 2, "%g": 2}.get(name, 0)):
            mark = commands[i] if not args else mark
            start = i + 1 if not args else i
            end = commands.index(mark, start)
            args.append(commands[start:end])
            i = end + 1
        out.append((count, name, args))
    return out


def edit(text: str, steps: list[tuple[int, str, list[str]]]) -> str:
    at, buffer = 0, ""
    for count, name, args in steps:
        for _ in range(count):
            if name == "f":
                at = min(at + 1, len(text))
            elif name == "b":
                at = max(at - 1, 0)
            elif name == "a":
                at = 0
            elif name == "e":
                at = len(text)
            elif name == "d":
                text = text[:at] + text[at + 1 :]
            elif name == "k":
                buffer, text = buffer + text[at : at + 1], text[:at] + text[at + 1 :]
            elif name == "K":
                buffer, text = text[at:], text[:at]
            elif name == "Z":
                text = text[:at]
            elif name == "y":
                text, at = text[:at] + buffer + text[at:], at + len(buffer)
            elif name == "i":
                text, at = text[:at] + args[0] + text[at:], at + len(args[0])
            elif name in "sS":
                found = text.find(args[0], at)
                if found >= 0:
                    at = found + len(args[0]) * (name == "S")
            elif name == "%":
                found = text.find(args[0], at)
                if found >= 0:
                    text, at = text[:found] + args[1] + text[found + len(args[0]) :], found + len(args[1])
            elif name == "%g":
                text = text.replace(args[0], args[1])
            elif name in "ul":
                text = text[:at] + (text[at : at + 1].upper() if name == "u" else text[at : at + 1].lower()) + text[at + 1 :]
                at = min(at + 1, len(text))
            elif name in "UL":
                text = text[:at] + (text[at:].upper() if name == "U" else text[at:].lower())
            else:
                raise ValueError(f"unknown edit command {name!r}")
    return text


def edited(column: Column, commands: str) -> Column:
    """JVM functions where the commands are plain replacements, a vectorised function otherwise."""
    steps = parse(commands)
    if all(name == "%g" for _, name, _ in steps):
        for _, _, (old, new) in steps:
            column = F.replace(column, F.lit(old), F.lit(new))
        return column

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: edit(x, steps), na_action="ignore")

    return apply(column)


def nth_token(column: Column, n: int, last: bool = False) -> Column:
    """The n-th (1-based) run of non-blanks, or the last."""
    words = F.filter(F.split(column, r"\s+"), lambda w: w != "")
    return F.get(words, F.size(words) - 1 if last else F.lit(n - 1))


def reformatted(text: Column, string: str | None = None, double: str | None = None, long: str | None = None) -> Column:
    """The words of a text (between blanks), numbers with a fraction or exponent written by the format `double`, whole
    numbers by `long`, others by `string`; a kind without a format stays as it is."""
    whole, number = r"^[-+]?\d+$", r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"

    def one(word: Column) -> Column:
        out = F.format_string(string, word) if string else word
        as_double = F.format_string(double, word.try_cast("double")) if double else word
        as_long = F.format_string(long, word.try_cast("bigint")) if long else word
        return F.when(word.rlike(whole), as_long).when(word.rlike(number), as_double).otherwise(out)

    return F.array_join(F.transform(F.split(text, " ", -1), one), " ")
