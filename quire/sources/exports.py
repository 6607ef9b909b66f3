"""Writers: text reports, delimited and binary tables, meshes and images."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.frame import Paged


def lines(p: Paged, columns: Sequence[str], delimiter: str = " ", formats: dict[str, str] | None = None) -> DataFrame:
    """page, order columns and `line`: the columns as delimited text, printf formats by column."""
    cell = lambda c: F.format_string((formats or {})[c], F.col(c)) if formats and c in formats else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return p.rows.select(*p.page, *[c for c in p.order if c not in p.page], F.concat_ws(delimiter, *[cell(c) for c in columns]).alias("line"))


def report(p: Paged, columns: Sequence[str], style: str = "text", width: int = 15) -> DataFrame:
    """`line` of a printed table: text (padded to width; a longer cell stays whole, after a blank), csv, html, latex or
    markdown rows."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells: list[Column] = [text(c) for c in columns]
    line = {
        "text": lambda: F.concat(*[F.when(F.length(c) >= width, F.concat(F.lit(" "), c)).otherwise(F.lpad(c, width, " ")) for c in cells]), "csv": lambda: F.concat_ws(",", *[F.when(c.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]),
        "html": lambda: F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>")), "latex": lambda: F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")), "markdown": lambda: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")),
    }[style]()
    return p.rows.select(*p.page, *[c for c in p.order if c not in p.page], line.alias("line"))


def write_lines(df: DataFrame, path: str, by_page: Sequence[str] = (), order: Sequence[str] = ()) -> None:
    """Text files, one folder per page."""
    rows = df.repartition(*by_page).sortWithinPartitions(*by_page, *order) if by_page else df.sortWithinPartitions(*order) if order else df
    writer = rows.select(*by_page, "line").write.mode("overwrite")
    (writer.partitionBy(*by_page) if by_page else writer).text(path)


def write_pages(p: Paged, path: str, form: str = "parquet") -> None:
    """A folder per page."""
    p.rows.write.mode("overwrite").partitionBy(*p.page).format(form).save(path)


def mathematica(p: Paged, columns: Sequence[str]) -> DataFrame:
    """`line`: each row as a list of rules."""
    pair = [F.concat(F.lit(f'"{c}" -> '), F.replace(F.col(c).cast("string"), F.lit("E"), F.lit("*^"))) for c in columns]
    return p.rows.select(*p.page, *[c for c in p.order if c not in p.page], F.concat(F.lit("{"), F.concat_ws(", ", *pair), F.lit("}")).alias("line"))


def headless(df: DataFrame, columns: Sequence[str], order: Sequence[str], column_major: bool = False, most_rows: int = 1 << 20) -> bytes:
    """Little-endian doubles without a header, of a table small enough for one file: refused beyond most_rows."""
    m = df.orderBy(*order).select(*[F.col(c).cast("double") for c in columns]).limit(most_rows + 1).toPandas().to_numpy("<f8")
    if len(m) > most_rows:
        raise ValueError(f"over {most_rows} rows")
    return (m.T if column_major else m).tobytes()


def iq_samples(df: DataFrame, i: str = "I", q: str = "Q") -> DataFrame:
    """df with iSample and qSample, 16 bit samples whose largest of both has the full range, and `sample`, their four
    big-endian bytes. The scale is one aggregate. A signal of zeros stays zero."""
    most = df.agg(F.greatest(F.max(F.abs(F.col(i))), F.max(F.abs(F.col(q)))).cast("double").alias("__most"))  # one row
    scaled = lambda c: F.coalesce(F.floor(F.col(c) * (32767 / F.nullif(F.col("__most"), F.lit(0.0))) + 0.5), F.lit(0)).cast("int")
    word = lambda c: F.lpad(F.hex(F.pmod(F.col(c), F.lit(65536)).cast("bigint")), 4, "0")
    rows = df.join(F.broadcast(most), F.lit(True)).withColumn("iSample", scaled(i)).withColumn("qSample", scaled(q)).drop("__most")
    return rows.withColumn("sample", F.unhex(F.concat(word("iSample"), word("qSample"))))


def iq_bytes(df: DataFrame, order: Sequence[str], i: str = "I", q: str = "Q", most_rows: int = 1 << 20) -> bytes:
    """The samples of a waveform small enough for a generator's memory, in order: refused beyond most_rows."""
    got = iq_samples(df, i, q).orderBy(*order).select("sample").limit(most_rows + 1).toArrow()
    if got.num_rows > most_rows:
        raise ValueError(f"over {most_rows} rows")
    return b"".join(got.column("sample").to_pylist())


def field_volume(p: Paged, row: str, columns: Sequence[str], names: tuple[str, str] = ("y", "value")) -> DataFrame:
    """A field kept as planes (pages of rows x and columns y) as one row per cell: page, row, number of y from 0 and value."""
    cells = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias(*names)
    return p.rows.select(*p.page, row, cells)


def field_planes(p: Paged, row: str, columns: Sequence[str], rows: Sequence[int], prefix: str = "x") -> DataFrame:
    """The same field cut the other way: y is the page, the old pages are rows, and `<prefix><k>` holds row k's values.
    (Planes of constant `row` need no work: they are paged(rows, row, page).)"""
    cells = [F.max(F.when(F.col(row) == k, F.col("value"))).alias(f"{prefix}{k}") for k in rows]
    return field_volume(p, row, columns).groupBy("y", *p.page).agg(*cells)


def stl_bytes(triangles: np.ndarray) -> bytes:
    """A binary mesh of rows of 12 numbers."""
    return b"\0" * 80 + struct.pack("<I", len(triangles)) + b"".join(np.asarray(t, "<f4").tobytes() + b"\0\0" for t in triangles)


def tiff_bytes(image: np.ndarray) -> bytes:
    """An uncompressed 8-bit grey image."""
    h, w = image.shape
    tags = [(256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, w * h)]
    data = image.astype("u1").tobytes()
    pad = b"\0" * (len(data) % 2)
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<I", v) if k == 4 else struct.pack("<HH", v, 0)) for t, k, v in tags) + b"\0\0\0\0"
    return b"II*\0" + struct.pack("<I", 8 + len(data) + len(pad)) + data + pad + ifd
