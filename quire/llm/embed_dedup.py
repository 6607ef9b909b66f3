"""Operator 8, near-duplicate embeddings by int8 tile products with rigorous error bounds.

Every unit vector x is quantised once to x' = s * q, q in int8, and the norm e of x - x' is measured. Vectors of equal
components (128 bits of hashes) are one node with a count. Nodes are dealt to tiles by a hash; each pair of tiles is a
task of its own, and what is sent to it are codes: one byte a component. For unit vectors
|x.y - x'.y'| <= e_x |y'| + e_y, so the tile product q.q' (exact in floating point: integers below 2**24) decides most
pairs: below threshold minus bound they are no link, above threshold plus bound they are one. The nodes of pairs in
between are named, node and tile pair, never pair by pair; a second pass sends full vectors of only those to the tile
pairs that named them and recomputes the open pairs from the components in double precision.

Links never leave a task: a task returns the number of links of each vector, weighted by copies, and a spanning forest
of the links, fewer edges than vectors. Components come from the forests' edges. All pairs are compared, so work grows
with the square of the distinct vectors; a tile pair costs a matrix product, and each vector's codes are sent once per
tile, not per pair.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components link with nothing; vectors
of different lengths do not link; repeated rows and equal vectors are linked; null ids are kept as they are; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import join_counted, materialize
from quire.llm.components import components

#: Vectors of a tile at most, and components of all of them.
TILE, TILE_CODES = 16384, 1 << 22
LEAST_TILES = 4  # so that small inputs still use several cores
SLACK = 1e-5  # of the single precision products of scales
FOUND = "u bigint, v bigint, n bigint, i int, j int"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows to (q as float32 holding int8 values, scale, error norm)."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.float32), scale, np.linalg.norm(x - q * scale[:, None], axis=1)


class Codes:
    """Quantised vectors: q, scale and error norm, and the vectors themselves where they are at hand."""

    def __init__(self, q: np.ndarray, scale: np.ndarray, error: np.ndarray, vectors: np.ndarray | None = None):
        if vectors is not None:  # by powers of two, exactly, so that squares neither overflow nor vanish
            vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0.0))[1][:, None])
        self.q, self.scale, self.error, self.vectors = q, scale, error, vectors
        self.norm = None if vectors is None else np.sqrt((vectors * vectors).sum(1))

    def __len__(self) -> int:
        return len(self.scale)

    def at(self, some: np.ndarray) -> Codes:
        return Codes(self.q[some], self.scale[some], self.error[some], None if self.vectors is None else self.vectors[some])


def decided_pairs(a: Codes, b: Codes, threshold: float, same: bool, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Block by block, indices i into a and j into b (i < j only, if both are the same tile) of the pairs that are links by
    their codes, and of those that may be. The same pairs decide the same way in any tile: products are exact."""
    kind = np.float32 if 127 * 127 * a.q.shape[1] < 1 << 24 else np.float64
    qb, sb, eb = b.q.astype(kind).T, b.scale.astype(kind), b.error
    longest = 1 + max(a.error.max(initial=0.0), eb.max(initial=0.0))  # |y'| <= |y| + e_y
    for at in range(0, len(a), rows):
        part = slice(at, at + rows)
        dot = a.q[part].astype(kind) @ qb
        dot *= sb
        dot *= a.scale[part].astype(kind)[:, None]
        # a bound for the whole tile, a little too wide, leaves few pairs to look at one by one
        near = dot + eb.astype(kind) >= (threshold - a.error[part] * longest - 1.1 * SLACK).astype(kind)[:, None]
        i, j = np.divmod(np.flatnonzero(near), near.shape[1])
        if same:
            i, j = i[i + at < j], j[i + at < j]
        value = dot[i, j].astype(np.float64)
        i += at
        bound = a.error[i] * (1 + eb[j]) + eb[j] + SLACK
        sure, open_ = value >= threshold + bound, np.abs(value - threshold) < bound
        yield i[sure], j[sure], i[open_], j[open_]


def exact_links(a: Codes, b: Codes, i: np.ndarray, j: np.ndarray, threshold: float, some: int = 1 << 16) -> np.ndarray:
    """Which of the pairs i, j are links, by the vectors' components in double precision."""
    found = np.zeros(len(i), bool)
    for k in range(0, len(i), some):
        x, y = i[k : k + some], j[k : k + some]
        found[k : k + some] = (a.vectors[x] * b.vectors[y]).sum(1) / (a.norm[x] * b.norm[y]) >= threshold
    return found


class Links:
    """What a task keeps of its links: their number at each node, weighted by copies, and a spanning forest."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.count = copies, np.zeros(len(copies))
        self.edges = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, u: np.ndarray, w: np.ndarray) -> None:
        if len(u):
            n = len(self.copies)
            self.count += np.bincount(u, self.copies[w], n) + np.bincount(w, self.copies[u], n)
            self.edges = forest(np.r_[self.edges[0], u], np.r_[self.edges[1], w], n)

    def table(self, node: np.ndarray, open_: np.ndarray, i: int, j: int) -> pa.Table:
        """FOUND: (u, n) counts, (u, v) edges and (u, i, j) nodes with open pairs."""
        has, (x, y) = np.flatnonzero(self.count), self.edges
        none = lambda k: np.zeros(k, np.int64)
        kinds = np.repeat([0, 1, 2], [len(has), len(x), len(open_)])
        column = lambda values, kind, type_: pa.array(values, type_, mask=kinds != kind)
        return pa.table({
            "u": pa.array(np.r_[node[has], node[x], node[open_]], pa.int64()),
            "v": column(np.r_[none(len(has)), node[y], none(len(open_))], 1, pa.int64()),
            "n": column(np.r_[self.count[has].astype(np.int64), none(len(x) + len(open_))], 0, pa.int64()),
            "i": column(np.full(len(kinds), i, np.int32), 2, pa.int32()), "j": column(np.full(len(kinds), j, np.int32), 2, pa.int32()),
        })


def encode(vectors: DataFrame) -> DataFrame:
    """row, vec_id and, of usable vectors, the hashes h1 and h2, the components e, dim, and the code: q, scale and error."""
    v = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("e", lambda x: x != 0), F.lit(False))
    v = v.withColumn("e", F.when(usable, F.transform("e", lambda x: x + F.lit(0.0))))  # minus zero is zero
    v = v.withColumn("h1", F.when(usable, F.xxhash64("e"))).withColumn("h2", F.when(usable, F.xxhash64(F.lit(1), "e")))
    names = ["row", "vec_id", "h1", "h2", "e"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, e = len(b), b.column(4)
            sizes = np.nan_to_num(pa.compute.list_value_length(e).to_numpy(zero_copy_only=False)).astype(np.int64)
            q, scale, error = np.full(n, None, object), np.zeros(n), np.zeros(n)
            values, ends = e.flatten().to_numpy(), np.cumsum(sizes)
            for dim in np.unique(sizes[sizes > 0]):
                some = np.flatnonzero(sizes == dim)
                x = values[(ends[some] - dim)[:, None] + np.arange(dim)]
                x = x / np.abs(x).max(1)[:, None]  # no square is too large
                codes, scale[some], error[some] = quantise(x / np.sqrt((x * x).sum(1))[:, None])
                q[some] = [r.tobytes() for r in codes.astype(np.int8)]
            columns = [*b.columns, pa.array(sizes.astype(np.int32)), pa.array(q.tolist(), pa.binary()), pa.array(scale), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "dim", "q", "scale", "error"])

    return v.select(*names).mapInArrow(batches, "row bigint, vec_id bigint, h1 bigint, h2 bigint, e array<double>, dim int, q binary, scale double, error double")


def _codes(t: pa.Table) -> Codes:
    q = np.frombuffer(b"".join(t.column("q").to_pylist()), np.int8).reshape(len(t), -1)
    vectors = t.column("e").combine_chunks().flatten().to_numpy().reshape(len(t), -1) if "e" in t.column_names else None
    return Codes(q, t.column("scale").to_numpy(), t.column("error").to_numpy(), vectors)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of vectors (vec_id, embedding)."""
    v = materialize(encode(vectors), "vectors")
    usable = v.filter("h1 IS NOT NULL")
    code = F.struct("row", "dim", "q", "scale", "error")
    nodes = usable.groupBy("h1", "h2").agg(F.min_by(code, "row").alias("c"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.select("h1", "h2", "least", "copies", F.col("c.row").alias("node"), "c.dim", "c.q", "c.scale", "c.error"), "nodes")
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    tiles = max(LEAST_TILES, math.ceil(size["n"] / max(1, min(TILE, TILE_CODES // (size["dim"] or 1)))))
    coded = nodes.select("node", "copies", "dim", "q", "scale", "error", F.pmod(F.xxhash64("node"), F.lit(tiles)).cast("int").alias("own"))
    sent = coded.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    sent = sent.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other")

    def compare(t: pa.Table, exact: bool) -> pa.Table:
        node, copies, side = (t.column(c).to_numpy() for c in ("node", "copies", "side"))
        i, j, all_, links = t.column("i")[0].as_py(), t.column("j")[0].as_py(), _codes(t), Links(copies)
        a = np.flatnonzero(side == 0)
        b = a if i == j else np.flatnonzero(side == 1)
        open_ = np.zeros(len(node), bool)
        if len(a) and len(b):
            left, right = all_.at(a), all_.at(b)
            for u, w, x, y in decided_pairs(left, right, threshold, i == j):
                if exact:
                    is_link = exact_links(left, right, x, y, threshold)
                    u, w = x[is_link], y[is_link]
                else:
                    open_[a[x]] = open_[b[y]] = True
                links.add(a[u], b[w])
        return links.table(node, np.flatnonzero(open_), i, j)

    found = sent.groupBy("dim", "i", "j").applyInArrow(lambda t: compare(t, False), FOUND)
    found = materialize(found, "links")
    # open pairs, from full vectors of the nodes that have some
    named = found.filter("i IS NOT NULL").select(F.col("u").alias("node"), "i", "j")
    named = named.join(coded, "node").withColumn("side", ((F.col("i") != F.col("j")) & (F.col("own") == F.col("j"))).cast("int")).drop("own")
    named = named.join(v.select(F.col("row").alias("node"), "e"), "node")
    settled = materialize(named.groupBy("dim", "i", "j").applyInArrow(lambda t: compare(t, True), FOUND), "settled")
    found = found.filter("i IS NULL").unionByName(settled)

    counts = found.filter("n IS NOT NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    groups = components(found.filter("v IS NOT NULL").select("u", "v"))
    facts = nodes.select("h1", "h2", "node", "least", "copies").join(counts, "node", "left").join(groups, "node", "left")
    facts = facts.select("h1", "h2", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    facts = materialize(facts, "facts")
    ids = facts.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    facts = join_counted(facts, ids, ["component"], "members", size["n"])
    linked = join_counted(usable.select("vec_id", "h1", "h2"), facts.withColumnRenamed("copies", "n").withColumn("copies", F.col("n")), ["h1", "h2"], "copies", v.count())
    linked = linked.select("vec_id", (F.col("n") - 1 + F.col("links")).cast("bigint").alias("n_links"), "component_id")
    alone = v.filter("h1 IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def forest(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smaller node) that connect what the links left[i] - right[i] connect."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]
