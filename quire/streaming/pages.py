"""Operators over unbounded streams: pages become event-time windows, and late rows are bounded by a watermark.

Gap breaks are session windows; blocked statistics by value width are tumbling windows, overlapping ones sliding; the
grouped envelope is a running aggregation; per-key counters of rows are kept by a stateful function. The consuming join
needs every earlier row of both sides and stays a batch operator.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATISTICS = {"Mean": F.avg, "Min": F.min, "Max": F.max, "Sum": F.sum, "Count": F.count}


def _statistics(column: str, names: Sequence[str]) -> list[Column]:
    return [_STATISTICS[n](F.col(column).cast("double")).alias(column + n) for n in names]


def gap_pages(stream: DataFrame, time: str, keys: Sequence[str], column: str, gap: str, late: str, statistics: Sequence[str] = ("Count", "Mean")) -> DataFrame:
    """A page ends where a key is silent for gap: start, end, keys and statistics of each."""
    w = F.session_window(time, gap)
    out = stream.withWatermark(time, late).groupBy(w.alias("page"), *keys).agg(*_statistics(column, statistics))
    return out.select(F.col("page.start").alias("start"), F.col("page.end").alias("end"), *keys, *[column + s for s in statistics])


def window_statistics(stream: DataFrame, time: str, keys: Sequence[str], column: str, width: str, late: str, slide: str | None = None, statistics: Sequence[str] = ("Mean", "Min", "Max")) -> DataFrame:
    """Blocked (or with slide, overlapping) statistics over event time."""
    w = F.window(time, width, slide or width)
    out = stream.withWatermark(time, late).groupBy(w.alias("page"), *keys).agg(*_statistics(column, statistics))
    return out.select(F.col("page.start").alias("start"), F.col("page.end").alias("end"), *keys, *[column + s for s in statistics])


def grouped_envelope(stream: DataFrame, keys: Sequence[str], column: str, statistics: Sequence[str] = ("Mean", "Min", "Max", "Sum", "Count")) -> DataFrame:
    """One-pass statistics per group so far (update mode)."""
    return stream.groupBy(*keys).agg(*_statistics(column, statistics))


def row_limit_pages(stream: DataFrame, key: str, column: str, limit: int) -> DataFrame:
    """A page for every `limit` rows of a key, in the order of arrival: key, page, rows and sum. State is two numbers
    and a counter a key."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        page, rows, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        for pdf in parts:
            for v in pdf[column]:
                rows, total = rows + 1, total + float(v)
                if rows == limit:
                    out.append((k[0], page, rows, total))
                    page, rows, total = page + 1, 0, 0.0
        state.update((page, rows, total))
        yield pd.DataFrame(out, columns=[key, "page", "rows", "total"])

    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, page bigint, rows bigint, total double", "page bigint, rows bigint, total double", "append", GroupStateTimeout.NoTimeout)


def append_log(stream: DataFrame, path: str, checkpoint: str, by: str):
    """Append readings to Parquet, a folder per channel; start() the result. Restarts neither lose nor repeat rows."""
    return stream.writeStream.format("parquet").partitionBy(by).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def log_span(log: DataFrame, time: str, start, end) -> DataFrame:
    return log.filter(F.col(time).between(start, end))


def log_last(log: DataFrame, time: str, n: int) -> DataFrame:
    return log.orderBy(F.desc(time)).limit(n)
