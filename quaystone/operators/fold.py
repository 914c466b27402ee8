"""Folds in order that stream: a key's rows pass through their task one after the other, only a small state stays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, step: Callable[[tuple, Any, pd.DataFrame], tuple[Any, pd.DataFrame | None]], finish: Callable[[tuple, Any], pd.DataFrame] | None = None) -> DataFrame:
    """Rows are dealt by ``keys`` and sorted by ``order`` inside a key; one shuffle, whatever a key's size.

    ``step`` gets a key, the state so far (None at its beginning) and some of its rows in order, a part of an Arrow batch,
    and gives the new state and rows of ``schema``, or None for no rows. ``finish`` gives a key's last rows from its state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            change = np.zeros(len(pdf), bool)
            for k in keys:
                c = pdf[k]
                change[1:] |= ~((c.iloc[1:].to_numpy() == c.iloc[:-1].to_numpy()) | (c.iloc[1:].isna().to_numpy() & c.iloc[:-1].isna().to_numpy()))
            starts = np.concatenate(([0], np.flatnonzero(change), [len(pdf)]))
            for begin, end in zip(starts, starts[1:], strict=False):
                part = pdf.iloc[begin:end]
                key = tuple(None if pd.isna(x) else x for x in part.iloc[0][list(keys)])
                if key != at:
                    if at is not None and finish:
                        yield finish(at, state)
                    at, state = key, None
                state, out = step(key, state, part)
                if out is not None:
                    yield out
        if at is not None and finish:
            yield finish(at, state)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
