"""Running a state machine over each key's rows, in order, with memory bounded by a batch.

Rows are shuffled by key and sorted within partitions; a machine is fed stretches of a key's rows as numpy columns and
carries its state from batch to batch, so a long series never has to fit into a worker at once. Keys run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def scan(df: DataFrame, keys: list[str], order: str, machine: Callable[[tuple], Callable[[dict], dict]], schema: str) -> DataFrame:
    """machine(key values) gives a function from a stretch of rows (name -> array) to output columns (name -> array);
    the keys are added to its output. schema: the keys, then the machine's columns."""

    def run(batches):
        key, feed = None, None
        for batch in batches:
            if batch.empty:
                continue
            change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(change | (np.arange(len(batch)) == 0))
            for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
                part = batch.iloc[a:b]
                this = tuple(part[keys].iloc[0])
                if this != key:
                    key, feed = this, machine(this)
                out = pd.DataFrame(feed({c: part[c].to_numpy() for c in part.columns}))
                if len(out):
                    for i, (k, v) in enumerate(zip(keys, this, strict=True)):
                        out.insert(i, k, v)
                    yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)
