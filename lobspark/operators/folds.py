"""Ordered folds: shuffle by key, sort inside partitions, stream Arrow batches through a state.

A task holds the state of one key and one batch, never a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    make: Callable[[tuple], object],
    schema: str,
) -> DataFrame:
    """``make(key)`` returns an object with ``push(pdf)`` and ``finish()``, each giving a frame, a list
    of frames or None.

    Output frames lack the key columns; they are added back in front.
    """
    keys = list(keys)
    arranged = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def stamp(result: pd.DataFrame | list | None, key: tuple) -> Iterator[pd.DataFrame]:
        for out in result if isinstance(result, list) else [result]:
            if out is not None and len(out):
                for i, (name, v) in enumerate(zip(keys, key)):
                    out.insert(i, name, v)
                yield out

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            change = np.zeros(len(pdf), bool)
            for k in keys:
                v = pdf[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
            for a, b in zip(cuts, cuts[1:]):
                part = pdf.iloc[a:b]
                here = tuple(part[k].iloc[0] for k in keys)
                if fold is None or here != key:
                    if fold is not None:
                        yield from stamp(fold.finish(), key)
                    key, fold = here, make(here)
                yield from stamp(fold.push(part), key)
        if fold is not None:
            yield from stamp(fold.finish(), key)

    return arranged.mapInPandas(run, schema)
