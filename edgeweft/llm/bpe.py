"""Byte-level BPE over whole blocks of texts.

The public tokenizer cuts a text into pieces by a pattern and encodes each piece by itself.
Here the cuts of a whole block of texts are found at once from the classes of its bytes, and
each different piece of a block is encoded once, by the tokenizer's own merge table. The ids are
exactly those of the tokenizer without special tokens.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd

#: Where the vocabularies lie on every machine; a parameter of all functions that encode.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern of the public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that one worker remembers; then it starts anew.
PIECES_KEPT = 400_000
#: Bytes of text worked on at once.
BLOCK_BYTES = 6_000_000

OTHER, LETTER, NUMBER, SPACE, SEPARATOR = range(5)
#: No UTF-8 text holds this byte; it stands between texts.
SEPARATOR_BYTE = b"\xff"


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point, as the pattern sees it."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(what, text):
            a, b = (x if x < 0xD800 else x + 0x800 for x in m.span())
            table[a : b if b > a else a + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


@lru_cache(maxsize=1)
def byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[:128] = char_classes()[:128]
    table[255] = SEPARATOR
    return table


def classes_of(buf: np.ndarray) -> np.ndarray:
    """Class of each byte; the bytes of one character all have its class. ``buf`` ends with four separators."""
    cls = byte_classes()[buf]
    lead = np.flatnonzero((buf >= 0xC2) & (buf < 0xF5))
    if len(lead):
        b0 = buf[lead].astype(np.int32)
        b1, b2, b3 = ((buf[lead + k] & 0x3F).astype(np.int32) for k in (1, 2, 3))
        three, four = b0 >= 0xE0, b0 >= 0xF0
        cp = np.where(four, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3, np.where(three, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 31) << 6 | b1))
        kind = char_classes()[np.minimum(cp, 0x10FFFF)]
        for k, some in ((0, None), (1, None), (2, three), (3, four)):
            at, what = (lead, kind) if some is None else (lead[some], kind[some])
            inside = (k == 0) | (buf[at + k] != 255)
            cls[(at + k)[inside]] = what[inside]
    return cls


def piece_starts(buf: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Whether a piece of the pattern starts at each byte; separators start pieces of their own."""
    start = np.empty(len(buf), bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    space = cls == SPACE
    # the last white space before something else stands alone, or goes with it if it is a blank
    end = np.flatnonzero(space[:-1] & ~space[1:] & (cls[1:] != SEPARATOR))
    last = end.copy()
    for _ in range(3):
        last -= (buf[last] & 0xC0) == 0x80
    start[last] = True
    start[end[buf[end] == 0x20] + 1] = False
    quote = np.flatnonzero((buf == 0x27) & start)
    a, b = buf[quote + 1], buf[quote + 2]
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
    for some, length in ((two, 2), (one, 1)):
        start[quote[some] + 1] = False
        start[quote[some] + 1 + length] = True
    return start


def join_texts(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(SEPARATOR_BYTE + SEPARATOR_BYTE.join(texts) + SEPARATOR_BYTE * 24, np.uint8)


def hard_cuts(buf: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Positions where white space follows something else: a piece starts there whatever lies around."""
    space = cls == SPACE
    return np.flatnonzero(space[1:] & ~space[:-1] & (cls[:-1] != SEPARATOR)) + 1


class Encoder:
    """Ids of pieces, with a bounded memory of those seen before."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.slots: dict = {}
        self.counts, self.offsets, self.flat = array("i"), array("q"), array("i")

    def _slot(self, key: object, piece: bytes) -> int:
        ids = self.core._encode_single_piece(piece)
        self.slots[key] = slot = len(self.counts)
        self.counts.append(len(ids))
        self.offsets.append(len(self.flat))
        self.flat.extend(ids)
        return slot

    def _slots_of(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Slot of each piece. Pieces of up to 15 bytes are told apart by their bytes packed into integers."""
        eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        out = np.empty(len(start), np.int64)
        slots, raw = self.slots, buf.data
        short = np.flatnonzero(length < 8)
        n = length[short]
        keys = (eight[start[short]] & masks[n]) | (n.astype(np.uint64) << np.uint64(56))
        code, unique = pd.factorize(keys)
        of = [slots.get(k, -1) for k in unique.tolist()]
        for i, k in enumerate(unique.tolist()):
            if of[i] < 0:
                of[i] = self._slot(k, k.to_bytes(8, "little")[: k >> 56])
        out[short] = np.array(of, np.int64)[code]
        middle = np.flatnonzero((length >= 8) & (length < 16))
        if len(middle):
            at, n = start[middle], length[middle]
            low, high = eight[at], (eight[at + 8] & masks[n - 8]) | (n.astype(np.uint64) << np.uint64(56))
            (c1, u1), (c2, u2) = pd.factorize(low), pd.factorize(high)
            code, unique = pd.factorize(c1.astype(np.int64) * len(u2) + c2)
            of = []
            for k in zip(u1[unique // len(u2)].tolist(), u2[unique % len(u2)].tolist()):
                slot = slots.get(k, -1)
                of.append(slot if slot >= 0 else self._slot(k, k[0].to_bytes(8, "little") + k[1].to_bytes(8, "little")[: (k[1] >> 56) - 8]))
            out[middle] = np.array(of, np.int64)[code]
        for i in np.flatnonzero(length >= 16).tolist():
            piece = bytes(raw[start[i] : start[i] + length[i]])
            slot = slots.get(piece, -1)
            out[i] = slot if slot >= 0 else self._slot(piece, piece)
        return out

    def pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pieces of all texts in order: slot, number of ids, and index of the text."""
        if len(self.counts) > PIECES_KEPT:
            self._forget()
        buf = join_texts(texts)
        cls = classes_of(buf)
        start = np.flatnonzero(piece_starts(buf, cls))
        length = np.diff(np.r_[start, len(buf)])
        real = cls[start] != SEPARATOR
        start, length = start[real], length[real]
        slot = self._slots_of(buf, start, length)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        begin = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        text = np.searchsorted(begin, start, "right") - 1
        # an empty text begins where the separator before the next text stands, so it gets no pieces
        return slot, np.array(self.counts, np.int64)[slot], text

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        if not texts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        slot, count, text = self.pieces(texts)
        first = np.array(self.offsets, np.int64)[slot]
        total = int(count.sum())
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)
        ids = np.array(self.flat, np.int32)[at] if total else np.empty(0, np.int32)
        return ids, np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=1)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The worker's encoder."""
    return Encoder(vocabulary)


def text_blocks(texts: list[bytes]) -> list[slice]:
    """Slices of the list of about BLOCK_BYTES bytes each, with at least one text."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= BLOCK_BYTES:
            out.append(slice(start, i + 1))
            start, held = i + 1, 0
    if start < len(texts):
        out.append(slice(start, len(texts)))
    return out
