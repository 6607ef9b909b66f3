"""Operator 13, tokens of two tokenizers held against each other, by DuckDB inside Arrow partitions.

Texts are taken in blocks of some megabytes. A block's tokens are two tables of byte intervals, A's and B's, one document
after another; in DuckDB, an ASOF join gives each A token the B token that covers its first byte, a range join gives
those that reach further the B tokens that begin inside them, and together these are all overlaps. Byte offsets where
tokens of both end cut them into groups; a window sum over the cuts numbers them. A block returns a row per document,
with places and occurrences of its pairs in the block's list of id pairs, and that list with its partial counts.

These rows are written once. Spark adds up the partial counts of all blocks, finds the highest count of each B id (at
most as many rows as B's vocabulary, so these are broadcast), brings the counts back to the blocks' lists, and each
block's documents meet their own list only.

A is a byte-level vocabulary (operator 9's encoder, or operator 11's for runs of spaces that the former's pattern cannot
take in; special tokens' strings are text), B a sentencepiece model. No B piece has a word mark after other characters,
so words between single spaces are encoded one by one, each once a block. No ids are kept from block to block: most
distinct words of a block are new, and a memory of them is larger than the block.

Defined cases: texts that are null, empty, or that the tokens of either do not spell out byte for byte (after a space)
have zeros and an empty digest, as has a text with U+2581, which B reads as a space; null ids and repeated rows have a row
each; texts are aligned whole, however long (a long text is a block of its own); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import bpe, packing
from quire.llm.bpe import Spelling, decoder_of, vocabulary_path
from quire.llm.common import materialize, text_of

BLOCK_BYTES = 3 << 20
MARK = "▁"
BLOCKS = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, places binary, times binary, a int, b int, n bigint, place int"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

COVERING = "SELECT a.n, a.id AS a, a.e, b.id AS b, b.e AS b_end FROM a ASOF JOIN b ON a.s >= b.s"
FURTHER = "SELECT longer.n, longer.a, b.id AS b FROM longer JOIN b ON b.s >= longer.b_end AND b.s < longer.e"

#: Number of cuts before each token, its group; ends of both tokenizers' tokens are the cuts.
GROUPS = """
WITH cut AS (SELECT a.n AS n_a, b.n AS n_b, coalesce(a.e, b.e) AS e, (a.e IS NOT NULL AND b.e IS NOT NULL)::INT AS cut FROM a FULL JOIN b ON a.e = b.e)
SELECT n_a, n_b, (sum(cut) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) - cut)::INT AS g FROM cut"""


class Pieces(Spelling):
    """Ids of a sentencepiece model, and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        spelt = [bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(names)]
        self.by_word = not any(MARK in t.lstrip(MARK) for t in names)
        super().__init__(spelt)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, of its distinct words in a block where they are encoded apart."""
        apart = [self.by_word and t != "" and MARK not in t and "  " not in t and t[0] != " " and t[-1] != " " for t in texts]
        words = pc.split_pattern(pa.array([t for t, x in zip(texts, apart, strict=True) if x], pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        found = self.model.encode(coded.dictionary.to_pylist(), num_threads=1)
        sizes = np.array([*map(len, found)], np.int64)
        flat, starts = np.fromiter(itertools.chain.from_iterable(found), np.int32, sizes.sum()), np.cumsum(sizes) - sizes
        del found
        word = coded.indices.to_numpy()
        n = sizes[word]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[word] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, ends][np.asarray(words.offsets)].tolist()
        of = (ids[x:y].tobytes() for x, y in itertools.pairwise(bounds))
        return [next(of) if x else array("i", self.model.encode(t)).tobytes() for t, x in zip(texts, apart, strict=True)]


@lru_cache(1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(1)
def _names(ids: int) -> list[bytes]:
    """Ids in decimal after nothing, ';', '|' or ','."""
    return [sep + b"%d" % i for sep in (b"", b";", b"|", b",") for i in range(ids)]


@lru_cache(1)
def database():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})


def ordinary(path: str, text: str) -> bytes:
    """A's ids of a text."""
    try:
        return packing.encoder_of(path).ordinary(text)
    except ValueError:  # a run of spaces longer than tiktoken's pattern can go back over
        return bpe.encoder_of(path).ordinary(text)


def tokens(texts: list[str], path_a: str, path_b: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For A and B: ids, byte lengths of tokens, and number of tokens of each text; none of texts that they do not spell."""
    b = pieces_of(path_b)
    both = [[ordinary(path_a, " " + t) if t else b"" for t in texts], b.encode(texts)]
    source = [(" " + t).encode() if t else b"" for t in texts]
    for part, table in zip(both, (decoder_of(path_a), b), strict=True):
        if table.spelt(np.frombuffer(b"".join(part), np.int32)) != b"".join(source):
            for i, ids in enumerate(part):
                if table.spelt(np.frombuffer(ids, np.int32)) != source[i]:
                    both[0][i] = both[1][i] = source[i] = b""
    out = []
    for part, table in zip(both, (decoder_of(path_a), b), strict=True):
        ids = np.frombuffer(b"".join(part), np.int32)
        out.append((ids, table.lengths[ids], np.array([len(x) // 4 for x in part], np.int64)))
    return out


def overlaps(con) -> pa.Table:
    """(n, a, b) of each pair of tokens of the tables a and b that overlap. The range join is a statement of its own: as
    part of one with the ASOF join it is planned without the number of its rows, as a loop over all of b."""
    covering = con.sql(COVERING).to_arrow_table()
    con.register("longer", covering.filter(pc.less(covering.column("b_end"), covering.column("e"))))
    further = con.sql(FURTHER).to_arrow_table()
    con.unregister("longer")
    return pa.concat_tables([covering.select(["n", "a", "b"]), further])


def align_block(block: int, doc_ids: list, texts: list[str], path_a: str, path_b: str) -> pa.RecordBatch:
    """BLOCKS: a row for each document, then a row for each id pair."""
    sides = tokens(texts, path_a, path_b)
    (a, a_len, n_a), (b, b_len, n_b) = sides
    con = database()
    for name, ids, length in (("a", a, a_len), ("b", b, b_len)):
        e = np.cumsum(length)
        con.register(name, pa.table({"n": np.arange(len(ids), dtype=np.int32), "id": ids, "s": (e - length).astype(np.int32), "e": e.astype(np.int32)}))
    links = overlaps(con) if len(a) else pa.table({c: pa.array([], pa.int32()) for c in "nab"})
    group = [np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)]
    if len(a):
        found = con.sql(GROUPS).to_arrow_table()
        for g, name in zip(group, ("n_a", "n_b"), strict=True):
            of = found.filter(pc.is_valid(found.column(name)))
            g[of.column(name).to_numpy()] = of.column("g").to_numpy()
    for name in "ab":
        con.unregister(name)

    width = len(pieces_of(path_b).lengths)
    pairs, place, n = np.unique(links.column("a").to_numpy().astype(np.int64) * width + links.column("b").to_numpy(), return_inverse=True, return_counts=True)
    doc_of = np.repeat(np.arange(len(texts)), n_a)
    held, times = np.unique(doc_of[links.column("n").to_numpy()] * max(1, len(pairs)) + place, return_counts=True)
    doc, place = np.divmod(held, max(1, len(pairs)))
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    n_links = np.add.reduceat(np.r_[times, 0], bounds[:-1]) * (np.diff(bounds) > 0) if len(texts) else times
    first, last = np.cumsum(n_a) - n_a, np.cumsum(n_a)
    n_groups = np.zeros(len(texts), np.int64)
    has = n_a > 0
    n_groups[has] = group[0][last[has] - 1] - group[0][first[has]] + 1

    # ids in order of group, side and place, each with what parts it from the one before
    ids, key = np.r_[a, b], np.r_[2 * group[0], 2 * group[1] + 1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    sep = np.where(new, 1 + (key & 1), 3)
    total = n_a + n_b
    at = np.cumsum(total) - total
    sep[at[has]] = 0
    size = max(len(decoder_of(path_a).lengths), width)
    code, name = sep * size + ids[order], _names(size).__getitem__
    digest = [hashlib.sha256(b"".join(map(name, code[x : x + m].tolist()))).hexdigest() if m else "" for x, m in zip(at, total, strict=True)]

    docs, k = len(texts), len(pairs)
    place, times = place.astype(np.int32), times.astype(np.int32)
    cut = lambda x: [x[p:q].tobytes() for p, q in zip(bounds[:-1], bounds[1:], strict=True)] + [None] * k
    of_doc = lambda x: pa.array(np.r_[x, np.zeros(k, np.int64)], pa.int64(), mask=np.arange(docs + k) >= docs)
    of_pair = lambda x, kind: pa.array(np.r_[np.zeros(docs, np.int64), x], kind, mask=np.arange(docs + k) < docs)
    columns = [
        pa.array(np.full(docs + k, block), pa.int64()), pa.array(doc_ids + [None] * k, pa.int64()), *map(of_doc, (n_a, n_b, n_groups, n_links)), pa.array(digest + [None] * k, pa.string()), pa.array(cut(place), pa.binary()), pa.array(cut(times), pa.binary()),
        of_pair(pairs // width, pa.int32()), of_pair(pairs % width, pa.int32()), of_pair(n, pa.int64()), of_pair(np.arange(k), pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCKS.split(", ")])


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """RESULT, a row for each row of docs (doc_id, text)."""
    if path_b is None:
        import public_tokenizers

        path_b = public_tokenizers.path("piece_bpe_32k.model")
    path_a = path_a or vocabulary_path()

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in it:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if texts and size + len(t) > block_bytes:
                    yield align_block(block, ids, texts, path_a, path_b)
                    block, ids, texts, size = block + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield align_block(block, ids, texts, path_a, path_b)

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(blocks, BLOCKS)
    found = materialize(found, "aligned")
    lists = found.filter("place IS NOT NULL").select("block", "place", "a", "b", "n")
    counts = materialize(lists.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # a row for each id of B's vocabulary at most
    counts = counts.join(F.broadcast(highest), "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    facts = lists.drop("n").join(counts, ["a", "b"]).select(F.col("block").alias("of_block"), "place", "count", "best")

    def add_up(mine: pa.Table, facts: pa.Table) -> pa.Table:
        count, best = np.zeros((2, len(facts)), np.int64)
        place = facts.column("place").to_numpy()
        count[place], best[place] = facts.column("count").to_numpy(), facts.column("best").to_numpy()
        sums = []
        for p, t in zip(mine.column("places").to_pylist(), mine.column("times").to_pylist(), strict=True):
            p, t = np.frombuffer(p, np.int32), np.frombuffer(t, np.int32).astype(np.int64)
            sums.append((int((best[p] * t).sum()), int((count[p] * t).sum())))
        n_best, count_sum = (pa.array(x, pa.int64()) for x in (zip(*sums, strict=True) if sums else ([], [])))
        mine = mine.append_column("n_best", n_best).append_column("count_sum", count_sum)
        return mine.select([c.split()[0] for c in RESULT.split(", ")])

    rows = found.filter("place IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")
    return rows.groupBy("block").cogroup(facts.groupBy("of_block")).applyInArrow(add_up, RESULT)
