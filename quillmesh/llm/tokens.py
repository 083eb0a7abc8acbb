"""Words of many texts at once, in numpy: word boundaries and 64-bit word hashes.

A batch of texts is one byte buffer with a separator byte after each text. A word's hash is a
polynomial of random 64-bit byte values modulo 2**64, mixed at the end, so equal words have equal
hashes in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240117))
VALUES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
CHUNK = 1 << 20
with np.errstate(over="ignore"):
    UP = np.concatenate([[np.uint64(1)], np.cumprod(np.full(CHUNK, BASE, np.uint64))])
    DOWN = np.concatenate([[np.uint64(1)], np.cumprod(np.full(CHUNK, INVERSE, np.uint64))])

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of words: all but space and \t..\r; and 0-9, a-z (after folding) and non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array, and the offsets of its texts; null is empty."""
    a = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    a = a.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    bufs = a.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = NOT_SPACE, fold: bool = True):
    """(starts, ends, doc) of the words of all texts, in order; kind: which bytes are in words."""
    folded = FOLD[data] if fold else data
    inside = kind[folded]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    prev = np.zeros(len(data), bool)
    prev[1:] = inside[:-1]
    prev &= ~edge[:-1]
    starts = np.flatnonzero(inside & ~prev)
    nxt = np.zeros(len(data), bool)
    nxt[:-1] = inside[1:]
    nxt &= ~edge[1:]
    ends = np.flatnonzero(inside & ~nxt) + 1
    doc = np.searchsorted(offs, starts, "right") - 1
    return folded, starts, ends, doc


def hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words; the buffer is walked in chunks, words longer than a chunk one by one."""
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        i = 0
        while i < len(starts):
            at = int(starts[i])
            j = int(np.searchsorted(ends, at + CHUNK, "right"))
            if j <= i:
                h, p = np.uint64(0), at
                while p < ends[i]:
                    part = VALUES[folded[p : min(p + CHUNK, int(ends[i]))]]
                    h = h * UP[len(part)] + np.sum(part * UP[: len(part)], dtype=np.uint64)
                    p += len(part)
                out[i] = h
                i += 1
                continue
            end = int(ends[j - 1])
            c = np.empty(end - at + 1, np.uint64)
            c[0] = 0
            np.cumsum(VALUES[folded[at:end]] * UP[: end - at], dtype=np.uint64, out=c[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = (c[e] - c[s]) * DOWN[s]
            i = j
        return mixed(out + (ends - starts).astype(np.uint64))


def shingles(wh: np.ndarray, doc: np.ndarray, n_docs: int, k: int):
    """Hashes of all k-word runs and the text of each; a shorter text is one run of all its words."""
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    count = np.diff(first)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(wh), np.uint64)
        for j in range(k):
            step = mixed(np.uint64(1 + j) * BASE + np.zeros(1, np.uint64))[0] | np.uint64(1)
            part = np.zeros(len(wh), np.uint64)
            if len(wh) > j:
                part[: len(wh) - j] = wh[j:]
                # words past the end of the text count as zero
                same = np.zeros(len(wh), bool)
                same[: len(wh) - j] = doc[j:] == doc[: len(wh) - j]
                part[~same] = 0
            acc += part * step
        acc = mixed(acc)
    pos = np.arange(len(wh)) - first[doc] if len(wh) else np.zeros(0, int)
    keep = pos <= np.maximum(count[doc] - k, 0) if len(wh) else np.zeros(0, bool)
    return acc[keep], doc[keep]


#: Shingles of sets keep their 52 high bits; the 12 low bits of a sort key's top are the text's.
SET_BITS = 52
SET_DOCS = 1 << (64 - SET_BITS)


def distinct_sets(h: np.ndarray, doc: np.ndarray, n_docs: int):
    """Each text's distinct hashes (SET_BITS bits), ascending, one after another, with their offsets.

    At most SET_DOCS texts at a time: text and hash are sorted as one number.
    """
    bits = np.uint64(SET_BITS)
    key = np.sort((doc.astype(np.uint64) << bits) | (h >> np.uint64(64 - SET_BITS)))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    first = np.searchsorted(key, np.arange(n_docs, dtype=np.uint64) << bits)
    return key & np.uint64(2**SET_BITS - 1), np.append(first, len(key))
