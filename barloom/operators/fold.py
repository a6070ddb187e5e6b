"""Sequential folds over ordered streams, one shuffle, bounded memory.

Rows are dealt by stream and sorted on disk within their partition; a fold then reads batch
after batch and sees each stream's rows in order. What it keeps of a stream is up to the
fold: the bar folds keep a few values, whatever the stream's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from barloom.session import ship_package

#: Output rows gathered before a batch is handed on.
FLUSH = 20_000


class Fold(Protocol):
    """A stream's state: ``push`` takes its next rows, ``finish`` ends it; both yield output rows (tuples)."""

    def push(self, rows: pd.DataFrame) -> Iterator[tuple]: ...

    def finish(self) -> Iterator[tuple]: ...


def fold_streams(df: DataFrame, make: Callable[[tuple], Fold], schema: str, keys: list[str], order: list[str]) -> DataFrame:
    """Run ``make(key values)`` over every stream of ``df``; output has the keys, then the fold's columns.

    ``schema`` is the fold's columns as a DDL string. Null keys are streams of their own.
    """
    ship_package(df.sparkSession)
    types = dict(df.dtypes)
    names = [c.strip().split()[0].strip("`") for c in _columns(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fold, out = None, None, []

        def handed() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=[*keys, *names], dtype=object)
            out.clear()
            return frame

        for batch in batches:
            if not len(batch):
                continue
            values = batch[keys].astype(object).where(batch[keys].notna(), None)
            changed = (values != values.shift()) & ~(values.isna() & values.shift().isna())
            changed.iloc[0] = True
            starts = [*changed.any(axis=1).to_numpy().nonzero()[0].tolist(), len(batch)]
            for a, b in zip(starts, starts[1:]):
                key = tuple(values.iloc[a])
                if fold is None or key != at:
                    if fold is not None:
                        out.extend((*at, *row) for row in fold.finish())
                    at, fold = key, make(key)
                out.extend((*key, *row) for row in fold.push(batch.iloc[a:b]))
                if len(out) >= FLUSH:
                    yield handed()
        if fold is not None:
            out.extend((*at, *row) for row in fold.finish())
        if out:
            yield handed()

    full = ", ".join([*[f"`{k}` {types[k]}" for k in keys], schema])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, full)


def _columns(ddl: str) -> list[str]:
    """Top-level parts of a DDL string."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(ddl[at:i])
            at = i + 1
    return [*out, ddl[at:]]
