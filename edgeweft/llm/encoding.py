"""Token ids of every text of a corpus, with chunks that texts share encoded once.

1. A rolling hash cuts each text into chunks where the last bytes say so, so equal passages give
   equal chunks wherever they stand. Each task sends a different chunk once, with the places
   where it occurs, to the partition of its content.
2. There it is encoded once, between its first and last *hard cut*: a place where white space
   follows something else. The pattern always starts a piece there, whatever lies around.
3. The chunks of a text meet again. At each join, what lies between the last hard cut before
   it and the first one after it is encoded anew; beyond these cuts both encodings agree
   exactly. A chunk without a hard cut joins both its neighbours, and the stretch grows on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .blocks import BLOCK_SCHEMA, exchange, mix
from .bpe import VOCABULARY, classes_of, encoder, hard_cuts, join_texts, text_blocks

#: A chunk ends where this many bits of the rolling hash are zero, every 2**CHUNK_BITS bytes on average.
CHUNK_BITS = 9
#: Bytes that the rolling hash looks at.
WINDOW = 16
#: A chunk that occurs more often than this in one block of texts is encoded in up to SALTS partitions.
HOT_IN_BLOCK = 64
SALTS = 64
#: Input partitions that encode a common chunk in one place. Without a bound a chunk that every block holds would gather in one task.
PARTITIONS_SHARING = 256


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def chunk_cuts(buf: np.ndarray) -> np.ndarray:
    """Positions in joined texts where the rolling hash ends a chunk, always between characters."""
    h = mix(np.arange(256)).astype(np.uint32)[buf]
    k = 1
    while k < WINDOW:
        h[k:] += h[:-k] << np.uint32(k)
        k *= 2
    cut = np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0) + 1
    cut = cut[cut < len(buf)]
    while len(cut) and (inside := (buf[cut] & 0xC0) == 0x80).any():
        cut[inside] += 1
    # the window must not reach into the text before
    gap = np.flatnonzero(buf == 255)
    before = gap[np.searchsorted(gap, cut, "left") - 1]
    return cut[cut - before > WINDOW]


def chunk_texts(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Chunks of all texts in order, and the number of each text's chunks."""
    buf = join_texts(texts)
    raw = buf.tobytes()
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    end = np.cumsum(sizes + 1)
    begin = end - sizes
    cut = chunk_cuts(buf)
    cut = cut[cut < end[-1]]
    of = np.searchsorted(begin, cut, "right") - 1
    cut = cut[(cut > begin[of]) & (cut < end[of])]
    keep = begin[sizes > 0]
    first = np.sort(np.concatenate([keep, cut]))
    text = np.searchsorted(begin, first, "right") - 1
    last = np.minimum(np.r_[first[1:], end[-1]], end[text])
    return [raw[a:b] for a, b in zip(first.tolist(), last.tolist())], np.bincount(text, minlength=len(texts))


def _send_chunks(parts: int, sharing: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = 0
        group = TaskContext.get().partitionId() // sharing
        shift = hash_bytes(group.to_bytes(8, "little")) if group else 0
        for batch in batches:
            row, doc = batch.column(0).to_numpy(), batch.column(1)
            null = doc.is_null().to_numpy(zero_copy_only=False)
            doc = doc.fill_null(0).to_numpy()
            texts = text_bytes(batch.column(2))
            for some in text_blocks(texts):
                blocks += 1
                yield _block_chunks(row[some], doc[some], null[some], texts[some], parts, hash_bytes(int(row[some][0]).to_bytes(8, "little")) % SALTS, shift)

    return send


def _block_chunks(row: np.ndarray, doc: np.ndarray, null: np.ndarray, texts: list[bytes], parts: int, salt: int, shift: int) -> pa.RecordBatch:
    chunks, per_text = chunk_texts(texts)
    text = np.repeat(np.arange(len(texts)), per_text)
    seq = np.arange(len(chunks)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(c, len(number)) for c in chunks), np.int64, len(chunks))
    distinct = list(number)
    home = np.fromiter((hash_bytes(c) for c in distinct), np.uint64, len(distinct)) ^ np.uint64(shift)
    hot = np.bincount(which, minlength=len(distinct)) > HOT_IN_BLOCK
    part = ((home + np.where(hot, np.uint64(salt), np.uint64(0))) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((which, part[which])) if len(which) else which
    places = [row[text], seq, doc[text], null[text]]
    empty = np.flatnonzero(per_text == 0)
    to, bodies = [], []
    bounds = np.searchsorted(part[which][order], np.arange(parts + 1))
    lone = (row[empty] % parts).astype(np.int64)
    for p in range(parts):
        mine = order[bounds[p] : bounds[p + 1]]
        none = empty[lone == p]
        if not len(mine) and not len(none):
            continue
        w = which[mine]
        new = np.r_[True, w[1:] != w[:-1]] if len(w) else np.empty(0, bool)
        to.append(p)
        bodies.append(pickle.dumps((
            [distinct[i] for i in w[new].tolist()], np.cumsum(new) - 1, *[x[mine] for x in places], row[none], doc[none], null[none],
        ), 5))
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(bodies, pa.binary())], names=["part", "body"])


def hash_bytes(x: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(x)


def _encode_chunks(parts: int, vocabulary: str):
    """Encodes each different chunk of a partition, and sends what its occurrences need to the partitions of their texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        places: list[tuple] = []
        for batch in batches:
            for body in batch.column(1).to_pylist():
                chunks, which, row, seq, doc, null, erow, edoc, enull = pickle.loads(body)
                codes = np.fromiter((number.setdefault(c, len(number)) for c in chunks), np.int64, len(chunks))
                places.append((codes[which], row, seq, doc, null))
                if len(erow):
                    places.append((np.full(len(erow), number.setdefault(b"", len(number))), erow, np.zeros(len(erow), np.int64), edoc, enull))
        if not places:
            return
        which, row, seq, doc, null = (np.concatenate(x) for x in zip(*places))
        distinct = list(number)
        heads, tails, loose, ids, count = [], [], [], [], []
        for some in text_blocks(distinct):
            a, b, c, d, e = encode_inner(distinct[some], vocabulary)
            heads, tails = heads + a, tails + b
            loose.append(c), ids.append(d), count.append(e)
        loose, ids, count = np.concatenate(loose), np.concatenate(ids), np.concatenate(count)
        ids = ids.astype(np.uint16 if ids.max(initial=0) < 1 << 16 else np.uint32)
        at = np.cumsum(count) - count
        part = row % parts
        order = np.lexsort((which, part))
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            mine = order[bounds[p] : bounds[p + 1]]
            if not len(mine):
                continue
            w = which[mine]
            new = np.r_[True, w[1:] != w[:-1]]
            used = w[new]
            n = count[used]
            take = np.repeat(at[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            body = (
                np.cumsum(new) - 1, row[mine], seq[mine], doc[mine], null[mine],
                [heads[i] for i in used.tolist()], [tails[i] for i in used.tolist()], loose[used], n, ids[take],
            )
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([pickle.dumps(body, 5)], pa.binary())], names=["part", "body"])

    return work


def encode_inner(chunks: list[bytes], vocabulary: str) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Head, tail, whether there is no hard cut, ids of all inner parts, and their number, of each chunk."""
    buf = join_texts(chunks)
    raw = buf.tobytes()
    cut = hard_cuts(buf, classes_of(buf))
    sizes = np.fromiter((len(c) for c in chunks), np.int64, len(chunks))
    end = np.cumsum(sizes + 1)
    begin = end - sizes
    lo, hi = np.searchsorted(cut, begin, "right"), np.searchsorted(cut, end, "left")
    loose = lo >= hi
    if len(cut):
        first = np.where(loose, end, cut[np.minimum(lo, len(cut) - 1)])
        last = np.where(loose, end, cut[np.maximum(hi - 1, 0)])
    else:
        first = last = end
    spans = list(zip(begin.tolist(), first.tolist(), last.tolist(), end.tolist()))
    ids, count = encoder(vocabulary).encode([raw[b:c] for _, b, c, _ in spans])
    return [raw[a:b] for a, b, _, _ in spans], [raw[c:d] for _, _, c, d in spans], loose, ids, count


def _assemble(vocabulary: str):
    def receive(bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        places, heads, tails, loose, counts, ids, base = [], [], [], [], [], [], 0
        for body in bodies:
            which, row, seq, doc, null, h, t, lo, n, flat = pickle.loads(body)
            places.append((which + base, row, seq, doc, null))
            base += len(h)
            heads += h
            tails += t
            loose.append(lo), counts.append(n), ids.append(flat)
        which, row, seq, doc, null = (np.concatenate(x) for x in zip(*places))
        loose, counts, ids = np.concatenate(loose), np.concatenate(counts), np.concatenate(ids).astype(np.int32)
        at = np.cumsum(counts) - counts
        order = np.lexsort((seq, row))
        which, row, doc, null = which[order], row[order], doc[order], null[order]
        new = np.r_[True, row[1:] != row[:-1]]
        joins: list[bytes] = []
        inner: list[int] = []  # the chunk whose inner ids follow each join, or -1 at a text's end
        held: list[bytes] = []
        for k, (w, begins, no_cut) in enumerate(zip(which.tolist(), new.tolist(), loose[which].tolist())):
            if begins and k:
                joins.append(b"".join(held))
                inner.append(-1)
                held = []
            held.append(heads[w])
            if not no_cut:
                joins.append(b"".join(held))
                inner.append(w)
                held = [tails[w]]
        joins.append(b"".join(held))
        inner.append(-1)
        yield from _with_joins(joins, np.array(inner), doc[new], null[new], at, counts, ids, vocabulary)

    return receive


def _with_joins(joins, inner, doc, null, at, counts, ids, vocabulary) -> Iterator[pa.RecordBatch]:
    jids, jcount = [], []
    for some in text_blocks(joins):
        a, b = encoder(vocabulary).encode(joins[some])
        jids.append(a), jcount.append(b)
    jids, jcount = np.concatenate(jids), np.concatenate(jcount)
    every = np.concatenate([ids, jids])
    jat = len(ids) + np.cumsum(jcount) - jcount
    real = inner >= 0
    offset = np.stack([jat, np.where(real, at[inner], 0)], axis=1).ravel()
    length = np.stack([jcount, np.where(real, counts[inner], 0)], axis=1).ravel()
    text = np.cumsum(np.r_[False, ~real[:-1]])
    sizes = np.bincount(text, weights=length.reshape(-1, 2).sum(axis=1), minlength=len(doc)).astype(np.int64)
    ends = np.cumsum(length)
    doc_end = np.cumsum(sizes)
    done, seg = 0, 0
    last_seg = np.cumsum(np.bincount(text, minlength=len(doc)) * 2)
    while done < len(doc):  # several texts at a time, of about a million ids
        base = doc_end[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(doc_end, base + 1_000_000, "right")))
        s = slice(seg, last_seg[upto - 1])
        n = length[s]
        take = np.repeat(offset[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, doc_end[done:upto] - base].astype(np.int32)), pa.array(every[take]))
        yield pa.RecordBatch.from_arrays([pa.array(doc[done:upto], mask=null[done:upto]), lists], names=["doc_id", "ids"])
        done, seg = upto, s.stop


def corpus_ids(documents: DataFrame, vocabulary: str = VOCABULARY, sharing: int = PARTITIONS_SHARING) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of ``documents(doc_id, text)``, one row per input row.

    ``ids`` are those of the public tokenizer without special tokens; strings that look like
    special tokens are ordinary text. Null and empty texts give the empty list. A null
    or repeated doc_id is kept as it is. Empty input gives no rows; extra columns are ignored.
    Texts are encoded whole; one text is one task's work. A chunk is encoded once for every ``sharing`` partitions of the input that hold it.
    """
    parts = width_of(documents)
    texts = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    chunks = rows.mapInArrow(_send_chunks(parts, sharing), BLOCK_SCHEMA).repartitionById(parts, "part")
    return exchange(chunks, _encode_chunks(parts, vocabulary), parts, _assemble(vocabulary), "doc_id bigint, ids array<int>")


def spread(df: DataFrame, least: int = 1) -> DataFrame:
    """The frame over at least ``least`` partitions, and as many as tasks can run at once: work on texts is slow, and a few files are few tasks."""
    width = max(least, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df


def width_of(documents: DataFrame) -> int:
    """Partitions for work on texts: four for each partition that reads them, which may be of 128 MB compressed."""
    least = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, 4 * documents.rdd.getNumPartitions())
