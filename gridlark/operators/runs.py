"""Sorted rows inside a task, group by group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def turns(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Places where the next key starts."""
    codes = [batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
    return np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1


def whole_keys(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows that are sorted by `keys`, in batches that never end within a key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = lambda i: tuple(batch.column(k)[i].as_py() for k in keys)
        places = turns(batch, keys)
        cut = int(places[-1]) if len(places) else 0
        if held and at(0) != last:
            yield pa.concat_batches(held)
            held = []
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = at(batch.num_rows - 1)
    if held:
        yield pa.concat_batches(held)
