"""Connected parts of edges that meet in one task, in numpy and Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Edges that one step of a task takes at a time: some tens of bytes each.
CHUNK = 500_000


def parts(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Of each node 0 .. n - 1 the smallest node reachable over the edges (u, v)."""
    label = np.arange(n)
    while len(u):
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))  # both ends are roots here
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
        u, v = label[u], label[v]
        u, v = u[u != v], v[u != v]
    return label


def _stars(u: pa.ChunkedArray, v: pa.ChunkedArray) -> pa.RecordBatch:
    ends = pa.chunked_array([*u.chunks, *v.chunks]).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(ends.dictionary)
    nodes, rank = ends.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    at = rank[ends.indices.to_numpy()]
    label = parts(at[: len(u)], at[len(u) :], len(order))
    moved = np.nonzero(label != np.arange(len(order)))[0]
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(label[moved]))], names=["u", "v"])


def stars(batches: Iterator[pa.RecordBatch], chunk: int | None = CHUNK) -> Iterator[pa.RecordBatch]:
    """Fewer edges (u, v) of the same connected parts: of each chunk of edges (None: of all) every node with the smallest that it
    reaches there, itself left out. Ends aren't null."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if held and chunk is not None and rows >= chunk:
            table = pa.Table.from_batches(held)
            yield _stars(table.column(0), table.column(1))
            held, rows = [], 0
    if held:
        table = pa.Table.from_batches(held)
        yield _stars(table.column(0), table.column(1))


def all_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """stars() of all edges of the task at once."""
    return stars(batches, None)
