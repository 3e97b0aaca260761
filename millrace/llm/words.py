"""Vectorised words, word hashes and window hashes of Arrow text columns.

Texts are taken as UTF-8 bytes; all separators are ASCII, so byte classes split the same
words as code points do. Everything works on whole texts, a few MB of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of the 64-bit mixing steps (public SplitMix64 constants).
MIX_A, MIX_B, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
CHUNK_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_A)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def space_class() -> np.ndarray:
    """Separators of ``[^\\x20\\x09-\\x0D]+``."""
    sep = np.zeros(256, bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    return sep


def alnum_class() -> np.ndarray:
    """Separators of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``: letters and digits, lower case, stay."""
    sep = np.zeros(256, bool)
    sep[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
    return sep


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def chunks(batches, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of record batches with a ``text`` column: at most ``limit`` bytes or one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text")
        size = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(size, size[at] + limit, side="right")) - 1)
            to = min(to, len(text))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, nulls as empty, and the n + 1 offsets of its rows."""
    text = text.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def split(buf: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 bounds of each row's words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~sep[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = off[(off > 0) & (off < len(buf))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word; ``fold`` takes A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP)) | np.uint64(1)
    if fold:
        table = table[lower_table()]
    lens = ends - starts
    begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(begin, lens)
    power = np.full(int(lens.max()), MIX_A | 1, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    h = np.add.reduceat(table[buf[pos + np.repeat(starts, lens)]] * power[pos], begin)
    return mix(h + lens.astype(np.uint64) * np.uint64(STEP))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``h[i:i+k]`` for each i from 0 to len(h) - k; rows' bounds are the caller's matter."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    q = MIX_B | 1
    out, done, power, width = None, 0, h, 1
    left = k
    while left:
        if left & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(q, width, 1 << 64)) + part
            done += width
        left >>= 1
        if left:
            power = power[:-width] * np.uint64(pow(q, width, 1 << 64)) + power[width:]
            width *= 2
    return mix(out + np.uint64(k * STEP & (1 << 64) - 1))


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Mask over word positions (len = all words): a window of k words starts here inside its row."""
    n = int(first[-1])
    ok = np.zeros(n, bool)
    if n:
        room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
        ok = room >= k
    return ok


def pack6(x: np.ndarray) -> bytes:
    """The low 48 bits of each value."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack6(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()
