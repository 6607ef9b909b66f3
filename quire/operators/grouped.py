"""Running a numpy function over each whole page, in order. A page must fit in one executor, as these operators need
every row of it at once (recurrences, transforms, fits); pages are independent and spread over the cluster."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quire.frame import Paged

Result = dict[str, "np.ndarray | float | str"]


def per_page(p: Paged, columns: Sequence[str], f: Callable[[dict[str, np.ndarray]], Result], schema: str) -> DataFrame:
    """f gets the columns of a page as arrays in order and returns columns of one length (or scalars)."""
    page, order = list(p.page), list(p.order)
    names = [x.strip().split()[0].strip("`") for x in schema.split(",")]
    keys = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in p.rows.select(*page).schema)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable") if order else pdf
        got = f({c: pdf[c].to_numpy() for c in columns})
        n = max((len(v) for v in got.values() if isinstance(v, np.ndarray | list)), default=1)
        out = pd.DataFrame({c: (v if isinstance(v, np.ndarray | list) else [v] * n) for c, v in got.items()}, columns=names)
        for i, c in enumerate(page):
            out.insert(i, c, [pdf[c].iloc[0]] * len(out))
        return out

    rows = p.rows.select(*dict.fromkeys([*page, *order, *columns]))
    return rows.groupBy(*page).applyInPandas(one, f"{keys}, {schema}" if page else schema)
