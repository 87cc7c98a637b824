"""Walking key groups of a sorted partition, for mapInPandas."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd


def key_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, of batches that are sorted by ``keys``.

    Only the last key of a batch is carried to the next one, so memory is one
    batch and one group; callers bound their groups.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch) - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.nonzero(change)[0] + 1, [len(batch)]])
        if held and any(held[-1][k].iloc[-1] != batch[k].iloc[0] for k in keys):
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        for a, b in zip(starts[:-2], starts[1:-1], strict=True):
            part = batch.iloc[a:b]
            if held:
                held.append(part)
                part, held = pd.concat(held, ignore_index=True), []
            yield part
        held.append(batch.iloc[starts[-2] :])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
