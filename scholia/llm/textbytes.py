"""Words of Arrow string columns as numpy arrays, without a Python object for each word.

A word's 64-bit id is a polynomial over its bytes, taken from one running sum over the
buffer: ``(C[end] - C[start]) * p**-start``. Work goes through pieces of ``CHUNK`` bytes that
end between words, so that memory doesn't follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
#: An odd base has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def byte_class(word: "callable", lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(byte -> byte in lower case, byte -> belongs to a word)."""
    low = np.arange(256, dtype=np.uint8)
    if lower:
        low[65:91] += 32
    return low, np.array([word(int(b)) for b in low], bool)


#: Letters and digits of ASCII and all beyond, A-Z lower-cased.
ALNUM = byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: All but blanks, A-Z lower-cased.
NONSPACE = byte_class(lambda b: not (b == 32 or 9 <= b <= 13))
#: Letters of ASCII and all beyond, A-Z lower-cased.
LETTERS = byte_class(lambda b: 97 <= b <= 122 or b >= 128)


class Words(NamedTuple):
    """id, first byte and end of each word (from the start of the buffer), and each text's first word."""

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit ids."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    data = column.buffers()[2] if len(column) else None
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs.astype(np.int64)


def blocks(offs: np.ndarray, most: int = 4 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of about so many bytes; a longer text is alone."""
    out, i, n = [], 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def pieces(data: np.ndarray, offs: np.ndarray, cls: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, bytes in lower case, places where a text starts) of pieces of about CHUNK bytes that end between words."""
    low, isw = cls
    a, last = int(offs[0]), int(offs[-1])
    edges = offs[1:-1]
    while a < last:
        b = min(a + CHUNK, last)
        if b < last:
            gap = np.flatnonzero(~isw[low[data[a:b]]])
            k = int(np.searchsorted(edges, b, "right"))
            edge = int(edges[k - 1]) if k and edges[k - 1] > a else a
            b2 = max(a + int(gap[-1]) + 1 if len(gap) else a, edge)
            while b2 == a:  # a word longer than a piece
                more = np.flatnonzero(~isw[low[data[b : b + CHUNK]]])
                k = int(np.searchsorted(edges, b, "left"))
                stop = [last] if b + CHUNK >= last else []
                stop += [b + int(more[0])] if len(more) else []
                stop += [int(edges[k])] if k < len(edges) and edges[k] <= b + CHUNK else []
                if stop:
                    b2 = max(min(stop), a + 1)
                else:
                    b += CHUNK
            b = b2
        yield a, low[data[a:b]], edges[np.searchsorted(edges, a, "right") : np.searchsorted(edges, b, "left")] - a
        a = b


def span_ids(x: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Ids of the byte strings x[s:e]."""
    c = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(x)), out=c[1:])
    return mix((c[e] - c[s]) * _power_table(_INV, len(x))[s])


def words(data: np.ndarray, offs: np.ndarray, cls: tuple[np.ndarray, np.ndarray] = ALNUM) -> Words:
    """All words of the texts between the offsets."""
    isw = cls[1]
    hs, ss, es = [], [], []
    for a, x, inner in pieces(data, offs, cls):
        m = isw[x]
        st, en = m.copy(), np.zeros(len(m) + 1, bool)
        st[1:] &= ~m[:-1]
        en[1:] = m
        en[1:-1] &= ~m[1:]
        st[inner] = m[inner]
        en[inner] = m[inner - 1]
        s, e = np.flatnonzero(st), np.flatnonzero(en)
        hs.append(span_ids(x, s, e))
        ss.append(s + a)
        es.append(e + a)
    if not hs:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64))
    s = np.concatenate(ss)
    return Words(np.concatenate(hs), s, np.concatenate(es), np.searchsorted(s, offs, "left"))


def word_id(word: str, cls: tuple[np.ndarray, np.ndarray] = ALNUM) -> int:
    """The id that words() gives to one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(raw, np.array([0, len(raw)]), cls).h[0])


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """An id for each n consecutive words: the words' ids weighted by place."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(_BASE)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)
