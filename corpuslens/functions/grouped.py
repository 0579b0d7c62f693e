"""Ordered folds over many small groups without one pandas call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_groups(
    df: DataFrame, keys: list[str], order: list[str], fn: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str
) -> DataFrame:
    """Shuffle by ``keys``, sort, and stream each group's rows once through ``fn``.

    ``fn(key, rows)`` gets the rows in order as tuples of the non-key columns and
    yields output tuples. Only one group is held at a time; callers keep groups
    small by splitting them first.
    """
    cols = [c for c in df.columns if c not in keys]
    nk = len(keys)
    out_cols = T.DataType.fromDDL(schema).fieldNames()

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for f in frames:
            yield from zip(*(f[c].tolist() for c in [*keys, *cols]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer = []
        for key, group in groupby(rows(frames), key=lambda r: r[:nk]):
            buffer.extend(fn(key, [r[nk:] for r in group]))
            if len(buffer) > 20000:
                yield pd.DataFrame(buffer, columns=out_cols)
                buffer = []
        if buffer:
            yield pd.DataFrame(buffer, columns=out_cols)

    # By a hash of the keys: Spark leaves out a shuffle by the keys themselves after a join on them, and AQE may
    # then turn that join into one that no longer keeps a key together.
    return df.select(*keys, *cols).repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
