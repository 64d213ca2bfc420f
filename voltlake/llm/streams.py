"""Contiguous groups of a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each run of equal integer keys; a group may span batches. Only the rows of one
    group are held."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.append(np.flatnonzero(new), batch.num_rows)
        for i, j in zip(at[:-1], at[1:], strict=True):
            own = tuple(int(c[i]) for c in cols)
            if own != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(i, j - i))
    if held:
        yield key, pa.Table.from_batches(held)
