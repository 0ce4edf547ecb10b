"""Texts put into containers of a fixed number of tokens.

Each text gets a vector of its hashed tokens, which is projected to a few dimensions and placed
on a Hilbert curve. The texts are range-sorted along the curve, and short runs of neighbours are packed:
largest first, each into the fullest container it fits. What a run leaves in containers
that aren't nearly full goes on to the next run, so a container holds neighbours.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .blocks import mix
from .bpe import VOCABULARY, encoder, text_blocks
from .encoding import spread, text_bytes

CAPACITY = 4096
#: Buckets of the hashed token vectors, and dimensions and bits of the curve.
BUCKETS, DIMENSIONS, BITS = 256, 4, 10
#: Texts of one task, and of one run along the curve. Longer runs fill containers a little better and join texts that lie farther
#: apart: of 10,000 texts runs of 200 need 0.12 % more containers than fit the tokens, with half of them inside 180 neighbours; one run none more, inside 4,700.
TEXTS_PER_TASK, RUN = 25_000, 200
#: Containers filled to this share are closed at the end of a run; what the others hold is packed again with the next run.
CLOSED = 0.995


def hilbert_key(x: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with integer coordinates below 2**bits, an array (n, dimensions)."""
    x = x.astype(np.int64).T.copy()
    d = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(d):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[d - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((BUCKETS, DIMENSIONS))


def text_keys(texts: list[bytes], vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens and Hilbert key of each text."""
    coder = encoder(vocabulary)
    slot, count, text = coder.pieces(texts)
    sizes = np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)
    first = np.array(coder.flat, np.int64)[np.array(coder.offsets, np.int64)]
    home = (mix(first * 65536 + np.array(coder.counts, np.int64)) % np.uint64(BUCKETS)).astype(np.int64)
    vector = np.bincount(text * BUCKETS + home[slot], minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)
    vector = np.log1p(vector)
    vector -= vector.mean(axis=1, keepdims=True)
    vector /= np.maximum(np.sqrt((vector**2).sum(axis=1, keepdims=True)), 1e-9)
    place = 1 / (1 + np.exp(-1.702 * (vector @ _projection())))
    return sizes, hilbert_key(np.minimum(place * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row, doc_id, n_tokens, key) of each document; null and empty texts have 0 tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(2))
            found = [text_keys(texts[some], vocabulary) for some in text_blocks(texts)]
            sizes, keys = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(keys)], names=["row", "doc_id", "n_tokens", "key"])

    texts_of = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    rows = texts_of.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(work, "row bigint, doc_id bigint, n_tokens bigint, key bigint")


def pack_run(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit, largest first: the items of each container."""
    room: list[tuple[int, int]] = []  # (space left, container), sorted
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, c = room.pop(at)
            out[c].append(i)
            insort(room, (left - sizes[i], c))
        else:
            out.append([i])
            insort(room, (capacity - sizes[i], len(out) - 1))
    return out


def pack_along(items: Iterator[tuple[int, int, int]], capacity: int, run: int) -> Iterator[tuple[int, int, int]]:
    """(item, part, container) of items (item, part, size) in curve order; containers are numbered from 0."""
    held: list[tuple[int, int, int]] = []
    number = 0

    def close(last: bool) -> Iterator[tuple[int, int, int]]:
        nonlocal held, number
        left = []
        for members in pack_run([x[2] for x in held], capacity):
            filled = sum(held[i][2] for i in members)
            if last or filled >= CLOSED * capacity:
                for i in members:
                    yield held[i][0], held[i][1], number
                number += 1
            else:
                left += members
        held = [held[i] for i in sorted(left)]

    grown = 0
    for item in items:
        held.append(item)
        grown += 1
        if grown >= run:
            yield from close(False)
            grown = 0
    if held:
        yield from close(True)


def packed(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, run: int = RUN) -> DataFrame:
    """(doc_id, part, container, n_tokens): the container of every document.

    No container has more than ``capacity`` tokens of the public tokenizer. A document that alone
    has more is cut into parts 0, 1, ... of ``capacity`` tokens and a rest; all others are part 0.
    Null and empty texts have 0 tokens and a container like all others. Rows with a null or
    repeated doc_id are kept, each as an item of its own; extra columns are ignored.
    """
    items = materialize(sized(documents, vocabulary), "sized")
    width = max(1, -(-items.count() // TEXTS_PER_TASK))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        docs: list[int | None] = []

        def parts() -> Iterator[tuple[int, int, int]]:
            for batch in batches:
                for doc, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    docs.append(doc)
                    whole, rest = divmod(n, capacity)
                    for p in range(whole):
                        yield len(docs) - 1, p, capacity
                    if rest or not whole:
                        yield len(docs) - 1, whole, rest

        out: list[tuple[int | None, int, int, int]] = []
        length: dict[tuple[int, int], int] = {}

        def noted() -> Iterator[tuple[int, int, int]]:
            for item, p, n in parts():
                length[item, p] = n
                yield item, p, n

        for item, p, c in pack_along(noted(), capacity, run):
            out.append((docs[item], p, base + c, length.pop((item, p))))
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    ranged = items.repartitionByRange(width, "key", "row").sortWithinPartitions("key", "row")
    return ranged.select("doc_id", "n_tokens").mapInArrow(work, "doc_id bigint, part int, container bigint, n_tokens int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, part, container, n = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(container, pa.int64()), pa.array(n, pa.int32())], names=["doc_id", "part", "container", "n_tokens"])
