"""The self-describing paged file format: a text header of commands, then pages of parameters, arrays and a table, as text
or binary.

A file starts with a word of four capitals and a version digit. Header commands are `&name field=value, ... &end`; lines
that begin with `!` are comments. Pages are numbered from 1 and rows from 0. A file is read in one task; many files are
read in parallel.
"""

from __future__ import annotations

import io
import re
import shlex
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.frame import Paged

#: Fixed values of the format: type names, their Spark types, and numpy types for binary data.
TYPES = {
    "short": ("smallint", "i2"), "ushort": ("int", "u2"), "long": ("int", "i4"), "ulong": ("bigint", "u4"), "long64": ("bigint", "i8"), "ulong64": ("decimal(20,0)", "u8"),
    "float": ("float", "f4"), "double": ("double", "f8"), "longdouble": ("double", "f16"), "string": ("string", ""), "character": ("string", "S1"),
}


@dataclass
class Layout:
    columns: list[dict[str, str]] = field(default_factory=list)
    parameters: list[dict[str, str]] = field(default_factory=list)
    arrays: list[dict[str, str]] = field(default_factory=list)
    data: dict[str, str] = field(default_factory=dict)
    description: dict[str, str] = field(default_factory=dict)
    big_endian: bool = False
    end: int = 0  # where data begins

    @property
    def binary(self) -> bool:
        return self.data.get("mode") == "binary"

    def flag(self, name: str) -> int:
        return int(self.data.get(name, "0"))


class FormatError(ValueError):
    pass


def fields(text: str) -> dict[str, str]:
    """`name=value, ...` with quoted values."""
    lexer = shlex.shlex(re.sub(r"\s*=\s*", "=", text), posix=True)
    lexer.whitespace, lexer.whitespace_split, lexer.commenters, lexer.quotes = ", \t\n", True, "", '"'
    out = {}
    for word in lexer:
        if "=" in word:
            k, v = word.split("=", 1)
            out[k] = v
    return out


def read_header(raw: bytes) -> Layout:
    if not re.match(rb"[A-Z]{4}\d", raw):
        raise FormatError("not a paged file")
    layout, at = Layout(), raw.index(b"\n") + 1
    while True:
        end = raw.find(b"\n", at)
        line = raw[at : end if end >= 0 else len(raw)].decode("latin-1")
        if line.startswith("!"):
            layout.big_endian |= "big-endian" in line
            at = end + 1
            continue
        if not line.strip() and 0 <= end:
            at = end + 1
            continue
        stop = raw.find(b"&end", at)
        if not line.lstrip().startswith("&") or stop < 0:
            raise FormatError("the header has no data command")
        command = raw[at:stop].decode("latin-1").strip()
        at = raw.find(b"\n", stop)
        at = len(raw) if at < 0 else at + 1
        name, _, rest = command[1:].partition(" ")
        got = fields(rest.replace("\n", " "))
        if name in ("column", "parameter", "array"):
            if got.get("type") not in TYPES:
                raise FormatError(f"unknown type {got.get('type')!r}")
            getattr(layout, name + "s").append(got)
        elif name == "description":
            layout.description = got
        elif name == "data":
            layout.data = got
            for _ in range(int(got.get("additional_header_lines", "0"))):
                at = raw.index(b"\n", at) + 1
            layout.big_endian |= got.get("endian") == "big"
            layout.end = at
            return layout
        elif name not in ("associate", "include"):
            raise FormatError(f"unknown command {name!r}")


def text_value(word: str, kind: str):
    if kind in ("string", "character"):
        return word
    return float(word) if kind in ("float", "double", "longdouble") else int(word)


def split_row(line: str) -> list[str]:
    """White-space separated words; quoted ones may hold spaces and escaped quotes."""
    return [re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2] for m in re.finditer(r'"((?:[^"\\]|\\.)*)"|(\S+)', line)]


class Lines:
    """The lines of a file that are not comments; at is where the next one begins."""

    def __init__(self, f: io.BufferedIOBase):
        self.f, self.at, self.taken = f, f.tell(), 0

    def __iter__(self) -> Lines:
        return self

    def __next__(self) -> str:
        while raw := self.f.readline():
            self.at += len(raw)
            if not raw.startswith(b"!"):
                return raw.decode("utf-8", "replace").rstrip("\r\n")
        raise StopIteration

    def grouped(self, n: int, layout: Layout) -> Iterator[str]:
        """The next n rows of a table."""
        per = max(1, int(layout.data.get("lines_per_row", "1")))
        for _ in range(n):
            found = [x for _, x in zip(range(per), self, strict=False)]
            if len(found) < per:
                raise FormatError("the file ends inside a page")
            yield " ".join(found)

    def block(self) -> Iterator[str]:
        """Rows up to a blank line, counted in taken."""
        self.taken = 0
        for line in self:
            if not line.strip():
                return
            self.taken += 1
            yield line


def text_pages(lines: Lines, layout: Layout, table: Callable[[Iterator[str]], list]) -> Iterator[dict]:
    """Pages whose rows are what table makes of the lines of a page's table."""

    def content() -> str | None:
        return next((x for x in lines if x.strip()), None)

    moving = [p for p in layout.parameters if "fixed_value" not in p]
    while True:
        page = {"parameters": {p["name"]: text_value(p["fixed_value"], p["type"]) for p in layout.parameters if "fixed_value" in p}, "arrays": {}, "rows": []}
        for i, p in enumerate(moving):
            line = content() if p["type"] != "string" or i == 0 else next(lines, None)
            if line is None:
                return
            words = split_row(line)
            page["parameters"][p["name"]] = (" ".join(words) if p["type"] == "string" else text_value(words[0], p["type"])) if words else ""
        for a in layout.arrays:
            line = content()
            if line is None:
                return
            dims = [int(x) for x in line.split()]
            if any(d < 0 for d in dims):
                raise FormatError("negative array extent")
            need, words = int(np.prod(dims)) if dims else 0, []
            while len(words) < need:
                words += split_row(next(lines))
            page["arrays"][a["name"]] = (dims, [text_value(w, a["type"]) for w in words])
        if layout.columns:
            if layout.flag("no_row_counts"):
                page["rows"] = table(lines.block())
                if not lines.taken:
                    return
            else:
                line = content()
                if line is None:
                    return
                page["rows"] = table(lines.grouped(int(line.split()[0]), layout))
        elif not moving and not layout.arrays:
            return
        yield page


def _text_pages(raw: bytes, layout: Layout) -> Iterator[dict]:
    def table(rows: Iterator[str]) -> list:
        out = []
        for words in map(split_row, rows):
            if len(words) < len(layout.columns):
                raise FormatError("a row is short")
            out.append([text_value(w, c["type"]) for w, c in zip(words, layout.columns, strict=False)])
        return out

    f = io.BytesIO(raw)
    f.seek(layout.end)
    return text_pages(Lines(f), layout, table)


def _binary_pages(raw: bytes, layout: Layout) -> Iterator[dict]:
    order = ">" if layout.big_endian else "<"
    at = layout.end

    def integer() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "i", raw, at - 4)[0]

    def values(kind: str, n: int) -> list:
        nonlocal at
        if kind == "string":
            out = []
            for _ in range(n):
                size = integer()
                out.append(raw[at : at + size].decode("utf-8", "replace"))
                at += size
            return out
        dtype = np.dtype(TYPES[kind][1]).newbyteorder(order)
        out = np.frombuffer(raw, dtype, n, at)
        at += dtype.itemsize * n
        return [x.decode("latin-1") for x in out.tolist()] if kind == "character" else out.astype(float).tolist() if kind == "longdouble" else out.tolist()

    while at < len(raw):
        n = integer()
        if n == -(1 << 31):
            n = struct.unpack_from(order + "q", raw, at)[0]
            at += 8
        page = {"parameters": {}, "arrays": {}, "rows": []}
        for p in layout.parameters:
            page["parameters"][p["name"]] = text_value(p["fixed_value"], p["type"]) if "fixed_value" in p else values(p["type"], 1)[0]
        for a in layout.arrays:
            dims = [integer() for _ in range(int(a.get("dimensions", "1")))]
            if any(d < 0 for d in dims):
                raise FormatError("negative array extent")
            page["arrays"][a["name"]] = (dims, values(a["type"], int(np.prod(dims))))
        if layout.flag("column_major_order"):
            page["rows"] = list(map(list, zip(*[values(c["type"], n) for c in layout.columns], strict=True)))
        else:
            page["rows"] = [[values(c["type"], 1)[0] for c in layout.columns] for _ in range(n)]
        yield page


def read_pages(raw: bytes) -> tuple[Layout, Iterator[dict]]:
    layout = read_header(raw)
    return layout, (_binary_pages if layout.binary else _text_pages)(raw, layout)


def check(raw: bytes) -> str:
    """ok, badHeader or corrupted."""
    try:
        _, pages = read_pages(raw)
    except (FormatError, ValueError, IndexError):
        return "badHeader"
    try:
        for _ in pages:
            pass
        return "ok"
    except (FormatError, ValueError, IndexError, StopIteration, RuntimeError, struct.error):
        return "corrupted"


def read(spark: SparkSession, path: str) -> tuple[Paged, DataFrame]:
    """The rows and parameters of all files at path, as a Paged of pages (__file, __page) and rows __row; and the arrays:
    __file, __page, name, dims, data (as text). The first file's header gives the schema."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.orderBy("path").limit(1).collect()[0]["content"]  # one file, for its header
    layout = read_header(bytes(first))
    kinds = lambda items: "".join(f", `{x['name']}` {TYPES[x['type']][0]}" for x in items)
    keys = "__file string, __page int"

    def emit(it, pick, names):
        for pdf in it:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                for number, page in enumerate(read_pages(bytes(raw))[1], 1):
                    out += [[p, number, *r] for r in pick(page)]
            yield pd.DataFrame(out, columns=names, dtype=object)

    column_names = ["__file", "__page", "__row", *[c["name"] for c in layout.columns]]
    parameter_names = [p["name"] for p in layout.parameters]
    rows = files.mapInPandas(lambda it: emit(it, lambda g: [[i, *r] for i, r in enumerate(g["rows"])], column_names), f"{keys}, __row bigint{kinds(layout.columns)}")
    params = files.mapInPandas(lambda it: emit(it, lambda g: [[g["parameters"][n] for n in parameter_names]], ["__file", "__page", *parameter_names]), keys + kinds(layout.parameters))
    arrays = files.mapInPandas(lambda it: emit(it, lambda g: [[n, d, [str(x) for x in v]] for n, (d, v) in g["arrays"].items()], ["__file", "__page", "name", "dims", "data"]), f"{keys}, name string, dims array<int>, data array<string>")
    return Paged(rows, ("__file", "__page"), ("__row",), params), arrays


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """path and verdict of every file."""

    def batches(it):
        for pdf in it:
            yield pd.DataFrame({"path": pdf["path"], "verdict": [check(bytes(c)) for c in pdf["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(batches, "path string, verdict string")


def _quoted(x) -> str:
    s = "" if x is None else str(x)
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"' if not s or re.search(r'[\s"\\!,&]', s) else s


def header_bytes(magic: str, layout: Layout) -> bytes:
    lines = [magic]
    if layout.binary:
        lines.append("!# big-endian" if layout.big_endian else "!# little-endian")
    for kind in ("parameters", "arrays", "columns"):
        for item in getattr(layout, kind):
            lines.append(f"&{kind[:-1]} " + ", ".join(f"{k}={_quoted(v)}" for k, v in item.items()) + ", &end")
    lines.append("&data " + ", ".join(f"{k}={v}" for k, v in layout.data.items()) + ", &end")
    return "".join(x + "\n" for x in lines).encode()


def write_bytes(magic: str, layout: Layout, pages: list[dict]) -> bytes:
    """A file of the given pages; magic is its first word."""
    out = io.BytesIO()
    line = lambda s: out.write((s + "\n").encode())
    out.write(header_bytes(magic, layout))
    order = ">" if layout.big_endian else "<"

    def put(kind: str, x) -> None:
        if kind == "string":
            b = ("" if x is None else str(x)).encode()
            out.write(struct.pack(order + "i", len(b)) + b)
        else:
            out.write(np.array([x.encode("latin-1") if kind == "character" else x], np.dtype(TYPES[kind][1]).newbyteorder(order)).tobytes())

    for page in pages:
        moving = [p for p in layout.parameters if "fixed_value" not in p]
        if layout.binary:
            out.write(struct.pack(order + "i", len(page["rows"])))
            for p in moving:
                put(p["type"], page["parameters"][p["name"]])
            for a in layout.arrays:
                dims, data = page["arrays"][a["name"]]
                out.write(struct.pack(f"{order}{len(dims)}i", *dims))
                for x in data:
                    put(a["type"], x)
            cells = ((c["type"], r[i]) for i, c in enumerate(layout.columns) for r in page["rows"]) if layout.flag("column_major_order") else ((c["type"], x) for r in page["rows"] for c, x in zip(layout.columns, r, strict=True))
            for kind, x in cells:
                put(kind, x)
        else:
            for p in moving:
                line(_quoted(page["parameters"][p["name"]]))
            for a in layout.arrays:
                dims, data = page["arrays"][a["name"]]
                line(" ".join(map(str, dims)))
                line(" ".join(map(_quoted, data)))
            if layout.columns:
                if not layout.flag("no_row_counts"):
                    line(str(len(page["rows"])))
                for r in page["rows"]:
                    line(" ".join(_quoted(repr(x) if isinstance(x, float) else x) for x in r))
                if layout.flag("no_row_counts"):
                    line("")
    return out.getvalue()


SPARK_TYPES = {"smallint": "short", "int": "long", "bigint": "long64", "float": "float", "double": "double", "string": "string"}


def write(p: Paged, path: str, magic: str, mode: str = "binary") -> DataFrame:
    """One file per page under path (a folder Spark and its workers share): each task writes its pages; returns the
    files' names and row counts."""
    columns = [c for c in p.rows.columns if c not in p.page]
    kinds = dict(p.rows.dtypes)
    layout = Layout([{"name": c, "type": SPARK_TYPES[kinds[c]]} for c in columns], [{"name": c, "type": SPARK_TYPES[kinds[c]]} for c in p.page], [], {"mode": mode})
    page, order = list(p.page), list(p.order)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import os

        pdf = pdf.sort_values(order) if order else pdf
        keys = pdf[page].iloc[0].tolist()
        data = write_bytes(magic, layout, [{"parameters": dict(zip(page, keys, strict=True)), "arrays": {}, "rows": pdf[columns].to_numpy(object).tolist()}])
        name = os.path.join(path, "-".join(re.sub(r"\W", "_", str(k)) for k in keys) + ".paged")
        os.makedirs(path, exist_ok=True)
        with open(name + ".part", "wb") as f:
            f.write(data)
        os.replace(name + ".part", name)  # a task that runs twice leaves one whole file
        return pd.DataFrame({"file": [name], "rows": [len(pdf)]})

    return p.rows.groupBy(*page).applyInPandas(one, "file string, rows bigint")


def describe(layout: Layout, spark: SparkSession) -> DataFrame:
    """kind, name, type and units of everything a header defines."""
    rows = [(kind, x["name"], x["type"], x.get("units", "")) for kind in ("column", "parameter", "array") for x in getattr(layout, kind + "s")]
    return spark.createDataFrame(rows, "kind string, name string, type string, units string").orderBy(F.col("kind"), F.col("name"))
