"""Operator 6, a uniform shuffle into shards of exact size, in DataFrame functions only.

Shard sizes differ by one at most. Rows are dealt to blocks by a hash; each block's rows get a random order; how many
of a block's rows go to each shard is drawn from the multivariate hypergeometric law, given all shard sizes, so the
counts are those of a truly uniform shuffle. The first rows of a block's order go to shard 0, and so on: that is the
exchange. Inside its shard every row gets its slot from a second random order. Blocks and orders are functions of the
rows and, for equal rows, of a number each, not of the partitions they happen to be read in: a task that is run again
deals the same way, and the copies of a row are dealt to all blocks.

The matrix has at most MAX_BLOCKS rows, whatever the input, and enters the plan as a constant: nothing is broadcast or
joined for it. Equal texts fall as they may: a group of copies is spread like any other rows.

Defined cases: null text has no bytes (size 1) and checksum 0; null ids and repeated rows are placed each; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import hex_digits, materialize, numbered_copies, running_total

ROWS_PER_BLOCK = 4096
MAX_BLOCKS = 4096


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` come from `good`: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    ln = math.lgamma
    choose = lambda n, k: ln(n + 1) - ln(k + 1) - ln(n - k + 1)
    up = down = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left, a, b = rng.random() - up, mode, mode
    while left > 0 and (a > low or b < high):
        if b < high:
            up *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            left -= up
            if left <= 0:
                return b
        if a > low:
            down *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            left -= down
            if left <= 0:
                return a
    return mode


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Row b: how many rows of block b go to each shard. Rows sum to block_rows, columns to shard_rows."""
    rng, room, matrix = random.Random(seed), list(shard_rows), []
    for n in block_rows:
        row, bad = [], sum(room)
        for s, r in enumerate(room):
            bad -= r
            k = n if s == len(room) - 1 else hypergeometric(rng, r, bad, n)
            row.append(k)
            n -= k
        room = [r - k for r, k in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def shard(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null)."""
    text = F.col("text").cast("string")
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"))
    narrow = materialize(numbered_copies(materialize(narrow, "sizes")), "shards")  # texts are read once; what follows moves a few numbers a row
    total = narrow.count()
    blocks = max(1, min(MAX_BLOCKS, math.ceil(total / ROWS_PER_BLOCK)))
    draw = lambda salt: F.hex(F.xxhash64(F.lit(seed + salt), "doc_id", "text_crc32", "size", "__copy"))
    narrow = narrow.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", "__copy"), F.lit(blocks)).cast("int"))
    counts = {r["__block"]: r["n"] for r in narrow.groupBy("__block").agg(F.count(F.lit(1)).alias("n")).collect()}  # MAX_BLOCKS at most
    sizes = [(total + shards - 1 - s) // shards for s in range(shards)]
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], sizes, seed)
    ends = [[sum(row[: s + 1]) for s in range(shards - 1)] for row in matrix]
    ends = F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")
    rank = F.row_number().over(Window.partitionBy("__block").orderBy(draw(1), "doc_id", "text_crc32", "__copy")) - 1
    dealt = narrow.withColumn("__rank", rank)
    dealt = dealt.withColumn("shard", F.size(F.filter(F.get(ends, F.col("__block")), lambda e: e <= F.col("__rank"))))
    dealt = dealt.withColumn("__order", F.lpad(draw(2), 16, "0")).withColumn("__one", F.lit(1).cast("bigint"))
    placed = running_total(dealt, ["shard"], "__order", ["__block", "__rank"], "__one", "slot", hex_digits(math.ceil(total / shards)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
