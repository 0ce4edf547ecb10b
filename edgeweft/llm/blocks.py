"""Shuffles of packed blocks.

Where a step is done on arrays, its map side sorts its rows by target partition and sends
one binary block per target instead of a row per element. The JVM then only moves blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_SCHEMA = "part int, body binary"


def pack(part: np.ndarray, parts: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One block per target partition; ``columns`` are arrays of equal length and fixed-width types."""
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts))
    sorted_columns = [c[order] for c in columns]
    to, bodies, start = [], [], 0
    for p, end in enumerate(ends.tolist()):
        if end > start:
            to.append(p)
            bodies.append(np.int64(end - start).tobytes() + b"".join(c[start:end].tobytes() for c in sorted_columns))
        start = end
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(bodies, pa.binary())], names=["part", "body"])


def unpack(bodies: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """The columns of all blocks, one after the other."""
    pieces: list[list[np.ndarray]] = [[] for _ in kinds]
    for body in bodies:
        n, at = int(np.frombuffer(body, np.int64, 1)[0]), 8
        for k, kind in enumerate(kinds):
            pieces[k].append(np.frombuffer(body, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.empty(0, kind) for p, kind in zip(pieces, kinds)]


def exchange(
    df: DataFrame, send: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], parts: int,
    receive: Callable[[list[bytes]], Iterator[pa.RecordBatch]], schema: str,
) -> DataFrame:
    """``send`` makes blocks of a frame's batches, ``receive`` gets all blocks of one partition."""

    def all_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: list[bytes] = []
        for batch in batches:
            bodies += batch.column(1).to_pylist()
        if bodies:
            yield from receive(bodies)

    blocks = df.mapInArrow(send, BLOCK_SCHEMA)
    return blocks.repartitionById(parts, "part").mapInArrow(all_blocks, schema)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer (multiply, xor, shift): equal inputs give equal, well spread outputs."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column; a null list has length 0."""
    lengths = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), lengths
