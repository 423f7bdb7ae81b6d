"""Ordered folds by key: each row of a key meets the state that the rows before it left.

Rows are dealt by key and sorted within partitions, and a task goes through them with one state at a time: no key is held
whole, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def folded(rows: DataFrame, key: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], list[tuple]], finish: Callable[[tuple, Any], list[tuple]], schema: str) -> DataFrame:
    """What `step` (state, row) and, after a key's last row, `finish` (key, state) tell; `step` changes the state in place.

    Rows are named tuples with the columns of `rows`; nulls are None.
    """
    names = [f.split()[0] for f in schema.split(",")]
    n = len(key)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names, dtype=object)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in pdfs:
            out: list[tuple] = []
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name="Row"):
                now = tuple(row[:n])
                if at != now:
                    if at is not None:
                        out += finish(at, state)
                    at, state = now, start()
                out += step(state, row)
            if out:
                yield frame(out)
        if at is not None and (out := finish(at, state)):
            yield frame(out)

    rest = [c for c in rows.columns if c not in key]
    spread = rows.select(*key, *rest).repartition(*key).sortWithinPartitions(*key, *order)
    return spread.mapInPandas(run, schema)
