"""Stack (RPN) and infix expressions, compiled to Columns by symbolic execution.

Both notations work on two stacks, numbers and truth values: a comparison leaves its operands and adds a truth value,
`cond ? a : b $` takes one and runs both branches, which must leave stacks of one depth. Names are columns, memories
(`x sto name`) or definitions (`udf`). Words that read files, run commands or loop are refused: an expression is a
Column or an error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.wildcard import matches


def _trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def _fmod(a: Column, b: Column) -> Column:
    return a - b * _trunc(a / b)


def _divide(a: Column, b: Column) -> Column:
    """IEEE division: a / 0 is an infinity or NaN, never an error or null."""
    zero = F.when(a == 0, F.lit(float("nan"))).when(F.isnan(a), a).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


ONE: dict[str, Callable[[Column], Column]] = {
    "sqrt": F.sqrt, "sqr": lambda x: x * x, "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"),
    "round": lambda x: F.round(x), "int": _trunc, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "exp": F.exp, "ln": F.log, "log": lambda x: F.log(x) / math.log(10), "abs": F.abs, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "dsin": lambda x: F.sin(F.radians(x)), "dcos": lambda x: F.cos(F.radians(x)), "dtan": lambda x: F.tan(F.radians(x)),
    "rtod": F.degrees, "dtor": F.radians, "rec": lambda x: _divide(F.lit(1.0), x), "chs": lambda x: -x, "sign": F.signum, "10x": lambda x: F.pow(F.lit(10.0), x),
    "stepfn": lambda x: F.when(x < 0, 0.0).otherwise(1.0), "fact": lambda x: F.exp(_lgamma(x + 1)), "lngam": lambda x: _lgamma(x), "erf": lambda x: 1.0 - _erfc(x), "erfc": lambda x: _erfc(x),
}
TWO: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _divide, "pow": F.pow, "fmod": _fmod, "mod": _fmod, "atan2": F.atan2,
    "hypot": F.hypot, "max2": F.greatest, "min2": F.least, "safe_div": lambda a, b: F.when(b == 0, 0.0).otherwise(_divide(a, b)),
    "bit&": lambda a, b: a.cast("bigint").bitwiseAND(b.cast("bigint")).cast("double"), "bit|": lambda a, b: a.cast("bigint").bitwiseOR(b.cast("bigint")).cast("double"),
}
COMPARE = {">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a == b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "!=": lambda a, b: a != b}
CONSTANTS = {"pi": math.pi, "e": math.e, "c_mks": 299792458.0, "e_mks": 1.602176634e-19, "me_mks": 9.1093837015e-31, "kb_mks": 1.380649e-23}
REFUSED = {"open", "clos", "fprf", "puts", "gets", "scan", "csh", "cshs", "execs", "execn", "sleep", "quit", "@"}


def _horner(x: Column, coefficients: list[float]) -> Column:
    """A polynomial, lowest power first; x occurs once a power, so the expression grows in proportion."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


@lru_cache(1)
def _erfc_polynomial() -> list[float]:
    """Powers of u in ln(erfc(x) / t) + x^2 over x >= 0, where t = 2 / (2 + x) and u = 2 t - 1, by interpolation at
    Chebyshev points. Where erfc leaves the range of doubles its asymptotic series gives the logarithm."""

    def rest(u: float) -> float:
        t = (u + 1) / 2
        x = 2 / t - 2
        if x < 20:
            return math.log(math.erfc(x) / t) + x * x
        return math.log1p(-1 / (2 * x * x) + 3 / (4 * x**4) - 15 / (8 * x**6) + 105 / (16 * x**8) - 945 / (32 * x**10)) - math.log(x * math.sqrt(math.pi) * t)

    c = np.polynomial.chebyshev.chebinterpolate(np.vectorize(rest), 30)
    return np.polynomial.chebyshev.cheb2poly(c).tolist()


def _erfc(x: Column) -> Column:
    a = F.abs(x)
    t = F.lit(2.0) / (a + 2.0)
    positive = t * F.exp(_horner(t * 2.0 - 1.0, _erfc_polynomial()) - a * a)
    return F.when(x >= 0, positive).otherwise(2.0 - positive)


#: Lanczos's approximation with g = 7: fixed values.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def _lgamma(x: Column) -> Column:
    """By reflection below one half."""

    def above(z: Column) -> Column:
        total = F.lit(LANCZOS[0])
        for k, c in enumerate(LANCZOS[1:]):
            total = total + F.lit(c) / (z + float(k))
        base = z + 6.5
        return 0.5 * math.log(2 * math.pi) + (z - 0.5) * F.log(base) - base + F.log(total)

    low = x < 0.5
    z = F.when(low, 1.0 - x).otherwise(x)
    pole = F.floor(x) == x
    sine = F.when(pole, 1.0).otherwise(F.abs(F.sin(x * math.pi)))
    reflected = F.when(pole, F.lit(float("inf"))).otherwise(math.log(math.pi) - F.log(sine) - above(z))
    return F.when(low, reflected).otherwise(above(z))


@dataclass
class Stacks:
    numbers: list[Column] = field(default_factory=list)
    truths: list[Column] = field(default_factory=list)
    memory: dict[str, Column] = field(default_factory=dict)

    def copy(self) -> Stacks:
        return Stacks(list(self.numbers), list(self.truths), dict(self.memory))


class ExpressionError(ValueError):
    pass


def split_words(text: str) -> list[str]:
    return [m[0] for m in re.finditer(r'"[^"]*"|\S+', text)]


class Compiler:
    """names: what each free name means; definitions: words as RPN text, taking their arguments from the stack."""

    def __init__(self, names: dict[str, Column], definitions: dict[str, str] | None = None):
        self.names, self.definitions = names, definitions or {}

    def number(self, text: str) -> Column:
        """The value an RPN expression leaves on top."""
        s = self.run(split_words(text), Stacks())
        if not s.numbers:
            raise ExpressionError(f"no value left by {text!r}")
        return s.numbers[-1]

    def truth(self, text: str) -> Column:
        s = self.run(split_words(text), Stacks())
        if not s.truths:
            raise ExpressionError(f"no truth value left by {text!r}")
        return s.truths[-1]

    def run(self, words: list[str], s: Stacks, depth: int = 0) -> Stacks:
        if depth > 50:
            raise ExpressionError("definitions recurse: a loop is no Column")
        i = 0
        while i < len(words):
            w = words[i]
            if w == "?":
                if not s.truths:
                    raise ExpressionError("'?' without a condition")
                middle, end = self._branches(words, i + 1)
                cond = s.truths.pop()
                yes = self.run(words[i + 1 : middle], s.copy(), depth)
                no = self.run(words[middle + 1 : end], s.copy(), depth)
                s = self._merge(cond, yes, no)
                i = end
            elif w == "sto":
                i += 1
                s.memory[words[i]] = s.numbers[-1]
            else:
                s = self._word(w, s, depth)
            i += 1
        return s

    @staticmethod
    def _branches(words: list[str], at: int) -> tuple[int, int]:
        level, middle = 0, -1
        for j in range(at, len(words)):
            if words[j] == "?":
                level += 1
            elif words[j] == ":" and not level:
                middle = j
            elif words[j] == "$":
                if not level:
                    if middle < 0:
                        raise ExpressionError("a condition needs ':'")
                    return middle, j
                level -= 1
        raise ExpressionError("a condition needs '$'")

    @staticmethod
    def _merge(cond: Column, yes: Stacks, no: Stacks) -> Stacks:
        if len(yes.numbers) != len(no.numbers) or len(yes.truths) != len(no.truths):
            raise ExpressionError("the branches of a condition leave stacks of different depth")
        pick = lambda a, b: a if a is b else F.when(cond, a).otherwise(b)
        return Stacks([pick(a, b) for a, b in zip(yes.numbers, no.numbers, strict=True)], [pick(a, b) for a, b in zip(yes.truths, no.truths, strict=True)], {k: pick(v, no.memory[k]) for k, v in yes.memory.items() if k in no.memory})

    def _word(self, w: str, s: Stacks, depth: int) -> Stacks:
        n, t = s.numbers, s.truths
        need = lambda k, stack=n: len(stack) >= k or (_ for _ in ()).throw(ExpressionError(f"{w!r} needs {k} values"))
        if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", w):
            n.append(F.lit(float(w)))
        elif w.startswith('"'):
            n.append(F.lit(w[1:-1]))
        elif w in s.memory:
            n.append(s.memory[w])
        elif w in self.names:
            n.append(self.names[w])
        elif w in ONE:
            need(1)
            n.append(ONE[w](n.pop()))
        elif w in TWO:
            need(2)
            b, a = n.pop(), n.pop()
            n.append(TWO[w](a, b))
        elif w in COMPARE:
            need(2)
            t.append(COMPARE[w](n[-2], n[-1]))
        elif w in ("isnan", "isinf"):
            need(1)
            t.append(F.isnan(n[-1]) if w == "isnan" else F.abs(n[-1]) == float("inf"))
        elif w in ("&&", "||"):
            need(2, t)
            b, a = t.pop(), t.pop()
            t.append(a & b if w == "&&" else a | b)
        elif w == "!":
            need(1, t)
            t.append(~t.pop())
        elif w in ("streq", "strgt", "strlt"):
            need(2)
            b, a = n.pop(), n.pop()
            t.append(a == b if w == "streq" else a > b if w == "strgt" else a < b)
        elif w == "strlen":
            need(1)
            n.append(F.length(n.pop()).cast("double"))
        elif w == "=":
            need(1)
            n.append(n[-1])
        elif w == "swap":
            need(2)
            n[-1], n[-2] = n[-2], n[-1]
        elif w == "pop":
            need(1)
            n.pop()
        elif w == "popl":
            need(1, t)
            t.pop()
        elif w == "cle":
            n.clear()
        elif w in ("rup", "rdn"):
            n[:] = n[-1:] + n[:-1] if w == "rup" else n[1:] + n[:1]
        elif w == "sumn":
            need(1)
            raise ExpressionError("'sumn' takes its count from the stack: write the sum out")
        elif w in CONSTANTS:
            n.append(F.lit(CONSTANTS[w]))
        elif w in self.definitions:
            return self.run(split_words(self.definitions[w]), s, depth + 1)
        elif w in REFUSED:
            raise ExpressionError(f"{w!r} reaches outside the expression and is refused")
        else:
            raise ExpressionError(f"unknown word {w!r}")
        return s


_TOKEN = re.compile(r'\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|("[^"]*")|([A-Za-z_][\w.:]*)|(&&|\|\||[<>=!]=|[-+*/^()<>?:,!]))')
_LEVEL = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 4, ">": 4, "<=": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "^": 8}


def infix(text: str, names: dict[str, Column]) -> Column:
    """Precedence climbing over + - * / ^ comparisons && || ! a ? b : c and function calls."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"cannot read {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    place = 0

    def peek() -> str:
        return tokens[place][0].strip() if place < len(tokens) else ""

    def take(want: str = "") -> re.Match:
        nonlocal place
        if place >= len(tokens) or want and peek() != want:
            raise ExpressionError(f"expected {want or 'more'} in {text!r}")
        place += 1
        return tokens[place - 1]

    def atom() -> Column:
        m = take()
        if m[1]:
            return F.lit(float(m[1]))
        if m[2]:
            return F.lit(m[2][1:-1])
        if m[3]:
            if peek() != "(":
                if m[3] in names:
                    return names[m[3]]
                if m[3] in CONSTANTS:
                    return F.lit(CONSTANTS[m[3]])
                raise ExpressionError(f"unknown name {m[3]!r}")
            take("(")
            args = [ternary()]
            while peek() == ",":
                take()
                args.append(ternary())
            take(")")
            known = {1: ONE, 2: TWO}.get(len(args), {})
            if m[3] not in known:
                raise ExpressionError(f"no function {m[3]!r} of {len(args)} arguments")
            return known[m[3]](*args)
        if m[4] == "(":
            inner = ternary()
            take(")")
            return inner
        if m[4] == "-":
            return -binary(7)
        if m[4] == "+":
            return binary(7)
        if m[4] == "!":
            return ~binary(7)
        raise ExpressionError(f"unexpected {m[4]!r}")

    def binary(least: int) -> Column:
        left = atom()
        while (op := peek()) in _LEVEL and _LEVEL[op] >= least:
            take()
            right = binary(_LEVEL[op] + (op != "^"))
            if op == "&&":
                left = left & right
            elif op == "||":
                left = left | right
            elif op in COMPARE:
                left = COMPARE[op](left, right)
            else:
                left = F.pow(left, right) if op == "^" else TWO[op](left, right)
        return left

    def ternary() -> Column:
        cond = binary(1)
        if peek() != "?":
            return cond
        take("?")
        yes = ternary()
        take(":")
        return F.when(cond, yes).otherwise(ternary())

    out = ternary()
    if place < len(tokens):
        raise ExpressionError(f"unexpected {peek()!r}")
    return out


def string_matches(column: Column, pattern: str) -> Column:
    return matches(column, pattern)


def evaluated(df: DataFrame, equation: str, name: str, names: dict[str, Column], most: int = 1000) -> DataFrame:
    """df with name: the value of the stack expression that each row holds in its `equation` column. The distinct
    equations, refused beyond `most`, become one expression of as many cases; rows are not interpreted one by one."""
    found = [r[0] for r in df.select(equation).filter(F.col(equation).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ExpressionError(f"over {most} equations")
    value = F.lit(None).cast("double")
    for text in sorted(found, reverse=True):
        value = F.when(F.col(equation) == text, Compiler(names).number(text).cast("double")).otherwise(value)
    return df.withColumn(name, value)
