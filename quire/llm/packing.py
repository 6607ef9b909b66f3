"""Operator 9, packing token ids into windows by multiway Karmarkar-Karp differencing.

A document's ids are cut into full windows of `capacity`, which fill a sequence each, and a rest, which is cut into
equal pieces of at most `max_piece`. Pieces are dealt by a hash, equal ones by a number each, to pools of about
`pool_pieces`, and each pool is partitioned into windows: every piece starts as a partition of one load and empty
windows; the two partitions of the largest spread are merged, the largest loads of one with the smallest of the other,
until one is left, whose windows are nearly equal. The window count starts at the least that could hold the pool and
rises by one whenever the fullest window exceeds capacity. Only piece lengths take part: ids are read, cut and checksummed in one pass over the texts.

Ids are those of the `tokenizers` library and its vocabulary file. Texts of Latin letters, most of them, are encoded by
`tiktoken` with ranks made from the same file, which takes a third of the time; all others by `tokenizers`. A test holds
the two against each other.

Defined cases: a null text is an empty one, of one end id; null ids and repeated rows are packed each; an empty table
gives an empty result; other columns are ignored. Sequence ids are unique, not gapless.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, numbered_copies, text_of

#: Letters below this code point have been in every version of Unicode the two libraries may know.
LATIN_END = "\u0250"
#: The published split of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.path = path

    @cached_property
    def tokenizer(self):
        """Loaded by the first text that needs it; most workers never meet one."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def latin(self):
        import tiktoken

        with open(self.path, encoding="utf-8") as f:
            described = json.load(f)
        # byte-level vocabularies write each byte as a printable character: itself, or the next from U+0100 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        spelt = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"] for t in described["added_tokens"]}
        ranks = {bytes(spelt[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
        return tiktoken.Encoding("latin", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def plain(self):
        """As tokenizer, but strings of special tokens are text like any other."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def ordinary(self, text: str) -> bytes:
        """Ids of a text in which strings of special tokens are text like any other."""
        if not text.isascii() and max(text) >= LATIN_END:
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.latin.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text or max(text) >= LATIN_END:  # special tokens, and letters the libraries might class differently
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.latin.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One a worker process, for all its tasks."""
    return Encoder(path)


def cut(tokens: int, capacity: int, max_piece: int) -> list[int]:
    """Lengths of a document's pieces."""
    full, rest = divmod(tokens, capacity)
    n = math.ceil(rest / max_piece)
    return [capacity] * full + [rest // n + (i < rest % n) for i in range(n)]


def karmarkar_karp(lengths: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """The window of each length, and the fullest window's load."""
    n = len(lengths)
    label = np.arange(n)  # of each piece: the piece whose window it has joined
    children: list[list[int]] = [[i] for i in range(n)]
    heap, parts = [], {}
    for i, x in enumerate(lengths):
        loads, owners = np.zeros(windows, np.int64), np.full(windows, -1)
        loads[0], owners[0] = x, i
        parts[i] = (loads, owners)
        heap.append((-int(x) if windows > 1 else 0, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        la, oa = parts[a]
        lb, ob = parts.pop(b)
        lb, ob = lb[::-1], ob[::-1]  # loads are kept in falling order
        loads, owners = la + lb, np.where(oa >= 0, oa, ob)
        for i in np.flatnonzero((oa >= 0) & (ob >= 0)):
            children[oa[i]] += children[ob[i]]
        order = np.argsort(-loads, kind="stable")
        loads, owners = loads[order], owners[order]
        parts[a] = (loads, owners)
        heapq.heappush(heap, (int(loads[-1] - loads[0]), a))
    loads, owners = parts[heap[0][1]]
    for w, o in enumerate(owners):
        if o >= 0:
            label[children[o]] = w
    return label, int(loads[0])


def pack_pool(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece of a pool; pieces of full capacity have one each, after the others."""
    window = np.zeros(len(lengths), np.int64)
    small = np.flatnonzero(lengths < capacity)
    k = 0
    if len(small):
        k = max(1, math.ceil(int(lengths[small].sum()) / capacity))
        while True:
            window[small], most = karmarkar_karp(lengths[small], k)
            if most <= capacity:
                break
            k += 1
    full = np.flatnonzero(lengths >= capacity)
    window[full] = k + np.arange(len(full))
    return window


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, max_piece: int) -> DataFrame:
    end = np.array([end_id], dtype="<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in it:
            row, start, length, crc, tokens = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = memoryview(encoder.encode(text) + end)
                n, at = len(ids) // 4, 0
                for size in cut(n, capacity, max_piece):
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    tokens.append(n)
                    at += size
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(batches, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 2048, max_piece: int = 512, pool_pieces: int = 512) -> DataFrame:
    """PIECES, sequence_id and offset: where each piece lies."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    found = materialize(pieces(docs, tokenizer, end_id, capacity, max_piece), "pieces")
    pools = max(1, math.ceil(found.filter(F.col("length") < capacity).count() / pool_pieces))

    def one(pool: pa.Table) -> pa.Table:
        pool = pool.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = pool.column("length").to_numpy()
        window = pack_pool(lengths, capacity)
        order = np.argsort(window, kind="stable")
        sizes, w = lengths[order], window[order]
        before = np.cumsum(sizes) - sizes
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        offset = np.empty(len(w), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.r_[first, len(w)]))
        number = pool.column("__pool").to_numpy()[0]
        return pool.drop_columns(["__pool"]).append_column("sequence_id", pa.array((number << 24) + window)).append_column("offset", pa.array(offset))

    found = numbered_copies(found)  # or all copies of a piece would meet in one pool
    pool = F.pmod(F.xxhash64("doc_id", F.floor(F.col("start") / (64 * capacity)), "doc_tokens", "ids_crc32", "__copy"), F.lit(pools)).cast("bigint")
    return found.withColumn("__pool", pool).drop("__copy").groupBy("__pool").applyInArrow(one, f"{PIECES}, sequence_id bigint, offset bigint")
