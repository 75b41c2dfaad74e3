"""Groups of rows in Arrow functions: partitions sorted by a key, read as batches that hold whole groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def sorted_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def grouped(batches, n_key: int):
    """Whole groups of a sorted partition: (key arrays, other columns), a batch's worth at a time."""
    held: list[pa.RecordBatch] = []

    def ready(table: pa.Table):
        table = table.combine_chunks()
        cols = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns]
        return [c.to_numpy(zero_copy_only=False) for c in cols[:n_key]], cols[n_key:]

    for batch in batches:
        if not batch.num_rows:
            continue
        tail = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_key)]
        last = np.logical_and.reduce([k == k[-1] for k in tail])
        cut = batch.num_rows if not last.any() else int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut == 0 and held:
            before = held[-1]
            if all(before.column(i)[-1].as_py() == batch.column(i)[0].as_py() for i in range(n_key)):
                held.append(batch)
                continue
            yield ready(pa.Table.from_batches(held))
            held = [batch]
            continue
        if cut:
            yield ready(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield ready(pa.Table.from_batches(held))


def lean(run):
    """``run`` (batches to batches), giving freed memory back to the system when a partition ends.

    Workers are reused: what their allocators keep would count against the executor while the JVM works.
    """

    def wrapped(batches):
        import ctypes
        import gc

        from plumbline.llm import bytescan

        yield from run(batches)
        bytescan.forget_powers()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped
