"""Readers of other formats. Text formats that split by line are read by Spark's own sources; the rest are parsed file by
file in parallel, each by a pure function from bytes to rows."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """__file, __n (from 1) and value of each line. A file may be read in several splits: lines are ordered by where their
    split begins, and inside it, as one task reads it from its start, by the order of reading."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"), "value")
    return lines.select("__file", "value", F.row_number().over(Window.partitionBy("__file").orderBy("__start", "__at")).alias("__n"))


def csv(spark: SparkSession, path: str, schema: str, separator: str = ",", header: bool = False, fill_last: bool = False, skip_lines: int = 0) -> DataFrame:
    """Delimited text with declared types; short rows and unreadable cells are null, or with fill_last the value of the
    row before in the file."""
    if skip_lines or fill_last:
        lines = numbered_lines(spark, path).filter(F.col("__n") > skip_lines + int(header))
        rows = lines.select("__file", "__n", F.from_csv("value", schema, {"sep": separator, "mode": "PERMISSIVE"}).alias("r")).select("__file", "__n", "r.*")
        w = Window.partitionBy("__file").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
        return rows.select(*[F.last(c, True).over(w).alias(c) if fill_last else F.col(c) for c in rows.columns[2:]])
    return spark.read.csv(path, schema=schema, sep=separator, header=header, mode="PERMISSIVE")


def plain(spark: SparkSession, path: str, columns: dict[str, str], comment: str = "!", skip_lines: int = 0, row_count: bool = False) -> DataFrame:
    """White-space separated columns; comment lines are skipped, and the leading row count if there is one."""
    lines = numbered_lines(spark, path).withColumn("v", F.btrim("value")).filter((F.col("v") != "") & ~F.col("v").startswith(comment))
    lines = lines.withColumn("__n", F.row_number().over(Window.partitionBy("__file").orderBy("__n")))
    words = F.split("v", r"\s+")
    kept = lines.filter(F.col("__n") > skip_lines + int(row_count))
    return kept.select((F.col("__n") - 1 - skip_lines - int(row_count)).alias("row"), *[F.get(words, F.lit(i)).try_cast(k).alias(c) for i, (c, k) in enumerate(columns.items())])


def parsed(spark: SparkSession, path: str, parse: Callable[[bytes], dict[str, list]], schema: str) -> DataFrame:
    """path, and the columns parse returns for each file."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def batches(it):
        for pdf in it:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                out = pd.DataFrame(parse(bytes(raw)), columns=names)
                out.insert(0, "path", p)
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(batches, "path string, " + schema)


def pixels(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Raw bytes, row-major: path, Row, Column, value."""
    def parse(raw: bytes) -> dict:
        v = np.frombuffer(raw, np.uint8)
        i = np.arange(len(v))
        return {"Row": i // width, "Column": i % width, "value": v.astype(int)}

    return parsed(spark, path, parse, "Row bigint, Column bigint, value int")


def parse_tiff(raw: bytes) -> dict:
    """Uncompressed 8 or 16 bit strips, grey or RGB (then the mean): Row, Column, value."""
    order = "<" if raw[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", raw, 4)[0]
    sizes = {1: "B", 3: "H", 4: "I"}
    tags = {}
    for k in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        if kind in sizes:
            size = struct.calcsize(sizes[kind]) * n
            where = at + 2 + 12 * k + 8 if size <= 4 else struct.unpack_from(order + "I", raw, at + 2 + 12 * k + 8)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{sizes[kind]}", raw, where)
    if tags.get(259, (1,))[0] != 1:
        raise ValueError("compressed TIFF is not read")
    w, h, samples, bits = tags[256][0], tags[257][0], tags.get(277, (1,))[0], tags.get(258, (8,))[0]
    data = b"".join(raw[o : o + n] for o, n in zip(tags[273], tags[279], strict=True))
    v = np.frombuffer(data, np.dtype("u1" if bits == 8 else order + "u2"), w * h * samples).reshape(h, w, samples).mean(2)
    r, c = np.indices((h, w))
    return {"Row": r.ravel(), "Column": c.ravel(), "value": v.ravel()}


def tiff(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_tiff, "Row bigint, Column bigint, value double")


def parse_stl(raw: bytes) -> dict:
    """Triangles, text or binary: normal and corners."""
    if raw[:5] == b"solid" and b"facet" in raw[:1000]:
        numbers = [float(x) for x in re.findall(r"[-+]?\d[\d.]*(?:[eE][-+]?\d+)?", re.sub(r"^solid.*$|^endsolid.*$", "", raw.decode("latin-1"), flags=re.M))]
        v = np.array(numbers).reshape(-1, 12)
    else:
        n = struct.unpack_from("<I", raw, 80)[0]
        v = np.frombuffer(raw, np.dtype([("v", "<f4", 12), ("a", "<u2")]), n, 84)["v"].astype(float)
    return {k: v[:, i] for i, k in enumerate(["nx", "ny", "nz", "x1", "y1", "z1", "x2", "y2", "z2", "x3", "y3", "z3"])}


def stl(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_stl, ", ".join(f"{k} double" for k in ["nx", "ny", "nz", "x1", "y1", "z1", "x2", "y2", "z2", "x3", "y3", "z3"]))


def parse_tfs(raw: bytes) -> tuple[dict[str, str], list[str], list[list[str]]]:
    """Parameters (`@` lines), column names (`*`) and rows of words."""
    parameters, names, rows = {}, [], []
    for line in raw.decode("latin-1").splitlines():
        words = re.findall(r'"[^"]*"|\S+', line)
        if not words or words[0] in ("$", "#"):
            continue
        if words[0] == "@":
            parameters[words[1]] = words[3].strip('"')
        elif words[0] == "*":
            names = words[1:]
        else:
            rows.append([w.strip('"') for w in words])
    return parameters, names, rows


def tfs(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """path and the named columns of machine tables."""
    def parse(raw: bytes) -> dict:
        _, names, rows = parse_tfs(raw)
        return {c: [float(r[names.index(c)]) if k != "string" else r[names.index(c)] for r in rows] for c, k in columns.items()}

    return parsed(spark, path, parse, ", ".join(f"{c} {k}" for c, k in columns.items()))


def parse_citi(raw: bytes) -> dict:
    """Network analyser text: Variable values with each complex trace."""
    text = raw.decode("latin-1")
    lists = re.findall(r"VAR_LIST_BEGIN\s*(.*?)\s*VAR_LIST_END", text, re.S)
    traces = [[tuple(map(float, x.split(","))) for x in b.split()] for b in re.findall(r"^BEGIN\s*(.*?)^END", text, re.S | re.M)]
    names = re.findall(r"^DATA\s+(\S+)", text, re.M)
    out: dict[str, list] = {"trace": [], "variable": [], "re": [], "im": []}
    x = [float(v) for v in lists[0].split()] if lists else []
    for name, trace in zip(names, traces, strict=False):
        out["trace"] += [name] * len(trace)
        out["variable"] += x[: len(trace)] if x else list(map(float, range(len(trace))))
        out["re"] += [p[0] for p in trace]
        out["im"] += [p[1] for p in trace]
    return out


def citi(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_citi, "trace string, variable double, re double, im double")


def parse_plot(raw: bytes) -> dict:
    """Legacy plot text: two label lines, title, topline, a count, then x y pairs."""
    lines = [x for x in raw.decode("latin-1").splitlines()]
    n = int(lines[4].split()[0])
    v = [tuple(map(float, x.split()[:2])) for x in lines[5 : 5 + n]]
    return {"x": [a for a, _ in v], "y": [b for _, b in v]}


def plot_text(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_plot, "x double, y double")


def parse_column_text(raw: bytes, plain_names: bool = False) -> dict:
    """Legacy column text: the numbers of columns, lines a row and auxiliary values; a line per column (name, unit,
    description and format between backslashes), title, label, a line per auxiliary value (its format is the value), the
    number of rows, and rows of numbers. Lines that begin with `!` are comments; incomplete rows are left out."""
    lines = iter(x for x in raw.decode("latin-1").splitlines() if not x.startswith("!"))
    columns, per_row, auxiliaries = (int(v) for v in (next(lines).split() + ["1", "0"])[:3]) if raw.strip() else (0, 1, 0)

    def described(line: str) -> list[str]:
        parts = [x.strip() for x in re.split(r"(?<!\\)\\(?!\\)", line, maxsplit=3)] + [""] * 3
        return [parts[0].replace("$", "") if plain_names else parts[0], *parts[1:4]]

    out: dict[str, list] = {"kind": [], "name": [], "unit": [], "Row": [], "value": []}

    def add(kind: str, head: list[str], row: int | None, value: float) -> None:
        for key, v in zip(out, (kind, head[0], head[1], row, value), strict=True):
            out[key].append(v)

    heads = [described(next(lines)) for _ in range(columns)]
    if columns:
        next(lines), next(lines)  # title and label
    for _ in range(auxiliaries):
        head = described(next(lines))
        add("parameter", head, None, float(head[3].split()[0]) if head[3] else 0.0)
    count, row = int(next(lines).split()[0]) if columns else 0, 0
    while row < count:
        values: list[float] = []
        for _ in range(per_row):
            for word in next(lines, "").split():
                try:
                    values.append(float(word))
                except ValueError:
                    break  # the rest of the line is the row's label
        if not values:
            break
        if len(values) >= columns:
            for head, v in zip(heads, values, strict=False):
                add("column", head, row, v)
            row += 1
    return out


def column_text(spark: SparkSession, path: str, plain_names: bool = False) -> DataFrame:
    """path, kind (column or parameter), name, unit, Row (null for parameters) and value; plain_names: without `$`."""
    return parsed(spark, path, lambda raw: parse_column_text(raw, plain_names), "kind string, name string, unit string, Row bigint, value double")


def parse_scope_text(raw: bytes) -> dict:
    """Oscilloscope text dump: header words name=value; then comma or line separated samples, scaled by the header."""
    text = raw.decode("latin-1")
    header = {k.upper(): float(v) for k, v in re.findall(r"(XINCR|XZERO|YMULT|YOFF|YZERO)[ :=]+([-+.\deE]+)", text, re.I)}
    body = re.split(r"CURVE", text, flags=re.I)[-1]
    v = np.array([float(x) for x in re.findall(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", body)])
    return {"time": header.get("XZERO", 0.0) + np.arange(len(v)) * header.get("XINCR", 1.0), "signal": (v - header.get("YOFF", 0.0)) * header.get("YMULT", 1.0) + header.get("YZERO", 0.0)}


def scope_text(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_scope_text, "time double, signal double")


#: Header of a multichannel scaler file, little-endian, 256 bytes: fields in order with their struct codes.
MCS_HEADER = [
    ("file_type", "h"), ("trigger", "b"), ("dwell_flag", "b"), ("dwell_units", "b"), ("acquisition_mode", "b"), ("old_dwell", "I"), ("channels", "H"), ("passes", "I"), ("passes_preset", "I"), ("time", "8s"), ("date", "8s"),
    ("marker", "H"), ("mcs_number", "b"), ("calibrated", "b"), ("calibration_units", "4s"), ("zero", "f"), ("slope", "f"), ("reserved1", "10s"), ("id_byte", "b"), ("reserved2", "b"), ("detector_length", "B"), ("detector", "63s"),
    ("sample_length", "B"), ("sample", "63s"), ("reserved3", "16s"), ("selector", "b"), ("edge", "b"), ("discriminator", "f"), ("upper", "f"), ("lower", "f"), ("dwell", "f"), ("consistent", "b"), ("reserved4", "21s"), ("mcs_id", "8s"),
]


def parse_mcs(raw: bytes) -> dict:
    """Counts per channel, with the calibrated abscissa."""
    layout = struct.Struct("<" + "".join(c for _, c in MCS_HEADER))
    h = dict(zip((n for n, _ in MCS_HEADER), layout.unpack_from(raw), strict=True))
    counts = np.frombuffer(raw, "<u4", h["channels"], layout.size).astype(np.int64)
    i = np.arange(len(counts))
    return {"Channel": i, "Counts": counts, "Calibrated": h["zero"] + h["slope"] * i if h["calibrated"] else i.astype(float)}


def mcs(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_mcs, "Channel bigint, Counts bigint, Calibrated double")


#: Lines and pixels a line of each frame type of a beam analyser file; its header has 200 bytes.
LBA_FRAMES = {"A": (120, 120), "B": (256, 240), "C": (512, 480)}


def parse_lba(raw: bytes) -> dict:
    kind = raw[:1].decode("latin-1")
    if kind not in LBA_FRAMES:
        raise ValueError("not a beam analyser frame")
    columns, rows = LBA_FRAMES[kind]
    v = np.frombuffer(raw, np.uint8, rows * columns, 200)
    i = np.arange(len(v))
    return {"Row": i // columns, "Column": i % columns, "value": v.astype(int)}


def lba(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_lba, "Row bigint, Column bigint, value int")


def parse_arbitrary_waveform(raw: bytes) -> dict:
    """Big-endian 16 bit samples."""
    v = np.frombuffer(raw[: len(raw) // 2 * 2], ">i2")
    return {"Index": np.arange(len(v)), "Waveform": v.astype(int)}


def arbitrary_waveform(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_arbitrary_waveform, "Index bigint, Waveform int")


#: Numeric data types of TDMS by number.
TDMS_TYPES = {1: "i1", 2: "i2", 3: "i4", 4: "i8", 5: "u1", 6: "u2", 7: "u4", 8: "u8", 9: "f4", 10: "f8", 0x19: "f4", 0x1A: "f8", 0x21: "u1"}


def parse_tdms(raw: bytes) -> dict:
    """segment, channel (object path), Index and value of all numeric channels; a segment without new objects repeats
    the last list, and an index of 0 repeats a channel's last layout."""
    out: dict[str, list] = {"segment": [], "channel": [], "Index": [], "value": []}
    at, number, layouts, active, seen = 0, 0, {}, [], {}
    while at + 28 <= len(raw) and raw[at : at + 4] == b"TDSm":
        toc = struct.unpack_from("<I", raw, at + 4)[0]
        order = ">" if toc & 64 else "<"
        following, data = struct.unpack_from(order + "QQ", raw, at + 12)
        end = len(raw) if following == (1 << 64) - 1 else at + 28 + following
        place = at + 28

        def take(code: str):
            nonlocal place
            value = struct.unpack_from(order + code, raw, place)[0]  # noqa: B023
            place += struct.calcsize(order + code)  # noqa: B023
            return value

        def text() -> str:
            nonlocal place
            n = take("I")  # noqa: B023
            place += n
            return raw[place - n : place].decode()

        if toc & 2:
            if toc & 4:
                active = []
            for _ in range(take("I")):
                path, index = text(), take("I")
                if index not in (0, 0xFFFFFFFF):
                    kind, _, n = take("I"), take("I"), take("Q")
                    if kind == 0x20:
                        take("Q")
                    layouts[path] = (kind, n)
                if index != 0xFFFFFFFF and path not in active:
                    active.append(path)
                for _ in range(take("I")):
                    text()
                    kind = take("I")
                    place += 16 if kind == 0x44 else 0
                    if kind == 0x20:
                        text()
                    elif kind != 0x44:
                        place += np.dtype(TDMS_TYPES[kind]).itemsize
        place = at + 28 + data
        known = [(p, np.dtype(order + TDMS_TYPES[layouts[p][0]]), layouts[p][1]) for p in active if p in layouts and layouts[p][0] in TDMS_TYPES]
        size = sum(d.itemsize * n for _, d, n in known)
        while toc & 8 and size and place + size <= end:
            if toc & 32:
                rows = np.frombuffer(raw, np.dtype([(f"c{i}", d) for i, (_, d, _) in enumerate(known)]), known[0][2], place)
                chunk = [rows[f"c{i}"] for i in range(len(known))]
                place += size
            else:
                chunk = []
                for _, d, n in known:
                    chunk.append(np.frombuffer(raw, d, n, place))
                    place += d.itemsize * n
            for (path, _, n), v in zip(known, chunk, strict=True):
                first = seen.get(path, 0)
                seen[path] = first + n
                out["segment"] += [number] * n
                out["channel"] += [path] * n
                out["Index"] += range(first, first + n)
                out["value"] += v.astype(float).tolist()
        at, number = end, number + 1
    return out


def tdms(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_tdms, "segment int, channel string, Index bigint, value double")
