"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than these six; both forms say the same.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []
_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a private one only where that is unset and all executors
    are threads of this machine's driver."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quire-shared-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return "file://" + _own_dir[0]


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile leaves no shuffle files: each execution's go when it ends. Else they stay until the driver
    happens to collect its garbage. Only for writes, whose plans nothing runs again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later steps neither recompute it nor lose it with an
    executor. Unlike checkpoint() this runs the plan once, and later reads prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    _scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    """A process that ends takes its intermediate folders along, as far as its JVM still answers."""
    spark = SparkSession.getActiveSession() if _scratch else None
    with contextlib.suppress(Exception):
        for name in _scratch if spark else ():
            _delete(spark, name)


def drop_shared(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that nothing will read again."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quire-" in name:
            _delete(df.sparkSession, name)


def scratch_mark() -> int:
    return len(_scratch)


def scratch_since(mark: int) -> list[str]:
    """Folders that materialize() has written since the mark."""
    return _scratch[mark:]


def release_scratch(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders that materialize() has written, for callers that have written out what they wanted of them."""
    for name in folders:
        _delete(spark, name)


def small_side(df: DataFrame, most_rows: int = 1 << 20) -> DataFrame:
    """df, written and counted: marked for broadcast up to most_rows rows, else left for a shuffled join."""
    df = materialize(df, "side")
    return F.broadcast(df) if df.count() <= most_rows else df


#: Bitmaps (4 KB each, of 2**15 numbers of rows) that are broadcast at most.
BITMAPS = 1 << 13


def keep_rows(df: DataFrame, row: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose number is in wanted (one column, monotonically_increasing_id of a written table, repeated or
    not). The wanted numbers are broadcast as bits, so df, which holds texts, is not shuffled; beyond BITMAPS it is."""
    number = F.col(wanted.columns[0])
    bits = wanted.select(F.bitmap_bucket_number(number).alias("__bucket"), F.bitmap_bit_position(number).alias("__bit")).repartition("__bucket")
    bits = materialize(bits.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits")), "bits")
    bits = F.broadcast(bits) if bits.count() <= BITMAPS else bits
    found = df.withColumns({"__bucket": F.bitmap_bucket_number(row), "__bit": F.bitmap_bit_position(row)}).join(bits, "__bucket")
    byte = F.conv(F.hex(F.expr("substring(__bits, int(__bit div 8) + 1, 1)")), 16, 10).cast("int")
    return found.withColumn("__byte", byte).filter("shiftright(__byte, int(__bit % 8)) & 1 = 1").select(*[F.col(quoted(c)) for c in df.columns])


def quoted(name: str) -> str:
    """A column's name as a reference: dots and backticks in it are its own."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame, out: str) -> Column:
    """All columns of df as one struct."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(out)


#: A key of at most this many rows is left to the task it falls to.
HOT_ROWS = 1024


def join_counted(big: DataFrame, facts: DataFrame, on: list[str], copies: str, rows: int, hot: int = HOT_ROWS) -> DataFrame:
    """Inner join of big (`rows` rows) with facts: one row per key, `copies` telling how many rows of big have it.

    No task takes all rows of a hot key: keys of more than `hot` rows, of which there are at most 2**17, are broadcast;
    only the other keys are shuffled.
    """
    hot = max(hot, rows >> 17)
    if rows <= hot:
        return big.join(facts.drop(copies), on)
    heavy, light = F.broadcast(facts.filter(F.col(copies) > hot).drop(copies)), facts.filter(F.col(copies) <= hot).drop(copies)
    return big.join(heavy, on).unionByName(big.join(heavy.select(*on), on, "left_anti").join(light, on))


def numbered_copies(df: DataFrame, out: str = "__copy", chunk: int = 1 << 16) -> DataFrame:
    """df's rows with a number: how many rows equal to it come before. Equal rows can stand for each other, so they are
    counted, not sorted, and dealt again chunk by chunk: the numbers depend on the rows alone, and no task takes all
    copies of a row."""
    names = [quoted(c) for c in df.columns]
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    numbers = lambda first, last: F.explode(F.sequence(first, last)).alias(out)
    few = counted.filter(F.col("__n") <= chunk).select(*names, numbers(F.lit(0).cast("bigint"), F.col("__n") - 1))
    many = counted.filter(F.col("__n") > chunk).select(*names, "__n", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / chunk))).alias("__part"))
    many = many.repartition(*names, "__part").select(*names, numbers(F.col("__part") * chunk, F.least(F.col("__n"), (F.col("__part") + 1) * chunk) - 1))
    return few.unionByName(many)


def text_of(col: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, as an array."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN, -1))


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row even where body's lambdas use it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_remainder(mod: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo mod: decides which rows labels may be learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % mod


def hex_digits(rows: int, per_group: int = 4096) -> int:
    """Leading hex digits of a uniform hash that leave about per_group rows to each prefix."""
    return max(0, math.ceil(math.log(max(rows, 1) / per_group, 16)))


def running_total(df: DataFrame, keys: list[str], order: str, ties: list[str], value: str, out: str, digits: int) -> DataFrame:
    """Add `out`: the sum of `value` over the earlier rows of the same keys, ordered by a uniform hex hash.

    A key may hold any share of the rows: they are grouped by the hash's first digits, the groups' sums are totalled
    (recursively, three digits at a time), and only a group's own rows meet in one task. Keys may be null.
    """
    before = Window.partitionBy(*keys, "__prefix") if digits else Window.partitionBy(*keys)
    before = before.orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(value).over(before), F.lit(0))
    if not digits:
        return df.withColumn(out, local)
    offset = f"__offset{digits}"
    df = df.withColumn("__prefix", F.substring(order, 1, digits))
    sums = df.groupBy(*keys, "__prefix").agg(F.sum(value).alias("__sum"))
    offsets = running_total(sums.withColumnRenamed("__prefix", "__order"), keys, "__order", [], "__sum", offset, max(0, digits - 3))
    offsets = offsets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__order").alias("__p"), offset)
    same = F.col("__prefix") == F.col("__p")
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"__k{i}")) & same
    joined = df.withColumn("__local", local).join(offsets, same, "left")
    return joined.withColumn(out, F.col("__local") + F.coalesce(offset, F.lit(0))).drop(*[f"__k{i}" for i in range(len(keys))], "__p", "__prefix", "__local", offset)
