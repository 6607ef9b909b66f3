import numpy as np
import pytest

from quire.frame import paged
from quire.sources import exports, imports
from quire.sources import paged_file as P

HEADER = """ABCD5
! a comment
&description text="a test", &end
&parameter name=run, type=long, &end
&parameter name=fixed, type=string, fixed_value="all pages", &end
&array name=grid, type=short, dimensions=2, &end
&column name=x, type=double, units=m, &end
&column name=label, type=string, &end
"""
TEXT = HEADER + """&data mode=ascii, &end
! page 1
7
2 2
1 2 3 4
2
1.5 first
2.5 "two words"
8
1 1
9
0
"""


def layout(mode, **more):
    return P.Layout(
        [{"name": "x", "type": "double"}, {"name": "label", "type": "string"}, {"name": "n", "type": "long64"}, {"name": "c", "type": "character"}],
        [{"name": "run", "type": "long"}], [{"name": "grid", "type": "short", "dimensions": "2"}], {"mode": mode, **more},
    )


PAGES = [{"parameters": {"run": 1}, "arrays": {"grid": ([2, 1], [5, 6])}, "rows": [[1.25, 'a "b" c', 1 << 40, "z"], [-2.0, "é", 0, "y"]]}, {"parameters": {"run": 2}, "arrays": {"grid": ([0, 3], [])}, "rows": []}]


def test_text():
    _, pages = P.read_pages(TEXT.encode())
    pages = list(pages)
    assert [p["parameters"] for p in pages] == [{"run": 7, "fixed": "all pages"}, {"run": 8, "fixed": "all pages"}]
    assert pages[0]["rows"] == [[1.5, "first"], [2.5, "two words"]] and pages[1]["rows"] == []
    assert pages[0]["arrays"]["grid"] == ([2, 2], [1, 2, 3, 4])


@pytest.mark.parametrize("more", [{"mode": "binary"}, {"mode": "binary", "column_major_order": "1"}, {"mode": "ascii"}])
@pytest.mark.parametrize("big", [False, True])
def test_round_trip(more, big):
    lay = layout(**more)
    lay.big_endian = big and more["mode"] == "binary"
    raw = P.write_bytes("ABCD5", lay, PAGES[: 1 if more["mode"] == "ascii" else 2])
    assert list(P.read_pages(raw)[1]) == PAGES[: 1 if more["mode"] == "ascii" else 2]


def test_malformed():
    assert P.check(TEXT.encode()) == "ok"
    assert P.check(HEADER.encode()) == "badHeader"
    assert P.check(b"nothing") == "badHeader"
    assert P.check(TEXT.replace("type=short", "type=odd").encode()) == "badHeader"
    assert P.check(TEXT.replace("2 2\n1 2 3 4", "-1 2\n").encode()) == "corrupted"
    assert P.check(TEXT.replace("0\n", "9\n1 2\n", 1).encode()) in ("ok", "corrupted")
    assert P.check(P.write_bytes("ABCD5", layout("binary"), PAGES)[:-3]) == "corrupted"


def test_spark_reader_and_writer(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(TEXT.encode())
    p, arrays = P.read(spark, str(tmp_path / "*.dat"))
    assert [(r["__page"], r["__row"], r["x"], r["label"]) for r in p.rows.orderBy("__page", "__row").collect()] == [(1, 0, 1.5, "first"), (1, 1, 2.5, "two words")]
    assert {r["run"] for r in p.params.collect()} == {7, 8}
    assert {tuple(r["data"]) for r in arrays.collect()} == {("1", "2", "3", "4"), ("9",)}
    rows = spark.createDataFrame([("p", 2, 1.0), ("p", 1, 2.0), ("q", 1, 3.0)], "page string, i int, x double")
    got = P.write(paged(rows, "page", "i"), str(tmp_path / "out"), "ABCD5").collect()
    assert sorted(r["rows"] for r in got) == [1, 2]
    again, _ = P.read(spark, str(tmp_path / "out" / "*.paged"))
    assert sorted((r["i"], r["x"]) for r in again.rows.collect()) == [(1, 2.0), (1, 3.0), (2, 1.0)]
    (tmp_path / "bad.dat").write_bytes(b"junk")
    assert sorted(r["verdict"] for r in P.verdicts(spark, str(tmp_path / "*.dat")).collect()) == ["badHeader", "ok"]


def test_imports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("skip\n1,x\n,y\n3,z\n")
    got = imports.csv(spark, str(tmp_path / "a.csv"), "a int, b string", fill_last=True, skip_lines=1).collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, "x"), (1, "y"), (3, "z")]
    (tmp_path / "p.txt").write_text("! note\n2\n 1 2.5\n3 x\n")
    got = imports.plain(spark, str(tmp_path / "p.txt"), {"a": "int", "b": "double"}, row_count=True).orderBy("row").collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 2.5), (3, None)]
    image = np.arange(12, dtype="u1").reshape(3, 4)
    (tmp_path / "i.tif").write_bytes(exports.tiff_bytes(image))
    got = imports.tiff(spark, str(tmp_path / "i.tif")).orderBy("Row", "Column").collect()
    assert [r["value"] for r in got] == list(range(12))
    (tmp_path / "r.raw").write_bytes(image.tobytes())
    assert imports.pixels(spark, str(tmp_path / "r.raw"), 4).filter("Row = 2 AND Column = 1").first()["value"] == 9
    mesh = np.arange(24).reshape(2, 12)
    (tmp_path / "m.stl").write_bytes(exports.stl_bytes(mesh))
    assert imports.stl(spark, str(tmp_path / "m.stl")).orderBy("nx").first()["z3"] == 11
    (tmp_path / "t.tfs").write_text('@ NAME %05s "ring"\n* NAME S\n$ %s %le\n "Q1" 1.5\n "Q2" 2.5\n')
    assert [r["S"] for r in imports.tfs(spark, str(tmp_path / "t.tfs"), {"NAME": "string", "S": "double"}).collect()] == [1.5, 2.5]
    (tmp_path / "c.cti").write_text("CITIFILE A.01.00\nDATA S RI\nVAR_LIST_BEGIN\n1\n2\nVAR_LIST_END\nBEGIN\n0.5,1\n0.25,2\nEND\n")
    assert [(r["variable"], r["re"], r["im"]) for r in imports.citi(spark, str(tmp_path / "c.cti")).collect()] == [(1, 0.5, 1), (2, 0.25, 2)]
    (tmp_path / "s.txt").write_text("XINCR:0.5 XZERO:1 YMULT:2 YOFF:1 CURVE 1,2,3")
    assert [(r["time"], r["signal"]) for r in imports.scope_text(spark, str(tmp_path / "s.txt")).collect()] == [(1.0, 0.0), (1.5, 2.0), (2.0, 4.0)]


def test_exports(spark, tmp_path):
    p = paged(spark.createDataFrame([(1, 1, "a b", 2.5), (1, 2, 'q"q', None)], "page int, i int, s string, v double"), "page", "i")
    assert [r["line"] for r in exports.lines(p, ["i", "v"], ",", {"i": "%03d"}).orderBy("i").collect()] == ["001,2.5", "002,"]
    assert [r["line"] for r in exports.report(p, ["s", "v"], "csv").orderBy("i").collect()] == ["a b,2.5", '"q""q",']
    assert exports.report(p, ["i"], "markdown").orderBy("i").first()["line"] == "| 1 |"
    assert exports.headless(p.rows, ["i"], ["i"]) == np.array([1.0, 2.0]).tobytes()
    exports.write_lines(exports.lines(p, ["i"]), str(tmp_path / "o"), ["page"], ["i"])
    assert spark.read.text(str(tmp_path / "o" / "page=1")).count() == 2


def test_instrument_files(spark, tmp_path):
    import struct

    head = struct.Struct("<" + "".join(c for _, c in imports.MCS_HEADER))
    assert head.size == 256
    fields = {n: (b"" if c.endswith("s") else 0) for n, c in imports.MCS_HEADER} | {"channels": 3, "calibrated": 1, "zero": 1.0, "slope": 0.5}
    (tmp_path / "a.mcs").write_bytes(head.pack(*fields.values()) + struct.pack("<3I", 7, 8, 1 << 31))
    got = imports.mcs(spark, str(tmp_path / "a.mcs")).orderBy("Channel").collect()
    assert [(r["Counts"], r["Calibrated"]) for r in got] == [(7, 1.0), (8, 1.5), (1 << 31, 2.0)]
    (tmp_path / "a.lba").write_bytes(b"A".ljust(200, b"\0") + bytes(range(120)) * 120)
    assert imports.lba(spark, str(tmp_path / "a.lba")).filter("Row = 5 AND Column = 7").first()["value"] == 7
    with pytest.raises(ValueError, match="frame"):
        imports.parse_lba(b"Z")
    (tmp_path / "a.arb").write_bytes(struct.pack(">3h", 1, -2, 300))
    assert [r["Waveform"] for r in imports.arbitrary_waveform(spark, str(tmp_path / "a.arb")).orderBy("Index").collect()] == [1, -2, 300]

    def segment(toc, meta, data):
        return b"TDSm" + struct.pack("<IIQQ", toc, 4713, len(meta) + len(data), len(meta)) + meta + data

    def entry(path, index, properties=b"\0\0\0\0"):
        return struct.pack("<I", len(path)) + path.encode() + index + properties

    layout = lambda kind, n: struct.pack("<IIIQ", 20, kind, 1, n)
    name = struct.pack("<I", 1) + struct.pack("<I", 4) + b"unit" + struct.pack("<I", 0x20) + struct.pack("<I", 1) + b"V"
    one = segment(2 | 4 | 8, struct.pack("<I", 2) + entry("/'g'/'a'", layout(10, 2), name) + entry("/'g'/'b'", layout(3, 1)), struct.pack("<ddi", 1.5, 2.5, 7))
    two = segment(8, b"", struct.pack("<ddi", 3.5, 4.5, 8) * 2)
    (tmp_path / "a.tdms").write_bytes(one + two)
    got = imports.tdms(spark, str(tmp_path / "a.tdms")).filter("channel LIKE '%a%'").orderBy("Index").collect()
    assert [r["value"] for r in got] == [1.5, 2.5, 3.5, 4.5, 3.5, 4.5] and [r["segment"] for r in got] == [0, 0, 1, 1, 1, 1]


def test_column_text(spark, tmp_path):
    lines = ["! a comment", "3 2 1", r"$gx$r \ m \ place \ %g", "y \\ \\", "z", "a title", "a label", r"Q \ C \ charge \ 2.5", "3", "1 2", "3 first row", "4 5", "! between", "6", "7 8", "9.5e1"]
    (tmp_path / "a.col").write_text("\n".join(lines))
    rows = imports.column_text(spark, str(tmp_path / "a.col"), plain_names=True).collect()
    assert [(r["name"], r["unit"], r["value"]) for r in rows if r["kind"] == "parameter"] == [("Q", "C", 2.5)]
    assert {(r["name"], r["Row"]): r["value"] for r in rows if r["kind"] == "column"} == {("gxr", 0): 1, ("y", 0): 2, ("z", 0): 3, ("gxr", 1): 4, ("y", 1): 5, ("z", 1): 6, ("gxr", 2): 7, ("y", 2): 8, ("z", 2): 95}
    assert imports.parse_column_text("2\nx\ny\n\n\n2\n1\n3 4\n5 6".encode())["value"] == [3, 4, 5, 6]  # an incomplete row
    assert imports.parse_column_text(b"")["value"] == []
