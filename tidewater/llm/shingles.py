"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Words are the maximal runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z lower-cased unless
asked otherwise. A shingle is ``k`` successive words; a text with fewer words, but at least one, has
its whole word sequence as its only shingle; a text without words, or a null, has none.

A word's hash takes its bytes eight at a time and mixes the state with each block, so it isn't a
polynomial in the bytes: words of one length never collide through the algebra of the hash.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240607)
_COEFFICIENT = _rng.integers(0, 2**64, 64, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: Runs longer than this are hashed one by one.
_LONG_RUN = 1024


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the offsets of its values; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def run_hashes(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each run ``symbols[start : start + length]``. Symbols are bytes, of which eight make a
    block, or 64-bit values, each a block."""
    h = mix64(lengths.astype(np.uint64) ^ mix64(np.array([seed], dtype=np.uint64)))
    if not len(starts):
        return h
    if symbols.dtype == np.uint8:
        padded = np.zeros(len(symbols) + 8, dtype=np.uint8)
        padded[:-8] = symbols
        blocks, step = np.ndarray((len(symbols) + 1,), "<u8", padded.data, strides=(1,)), 8
    else:
        blocks, step = symbols, 1
    shortest, longest = int(lengths.min()), int(lengths.max())
    if step == 8 and longest > _LONG_RUN:
        for i in np.flatnonzero(lengths > _LONG_RUN):
            run = symbols[starts[i] : starts[i] + lengths[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(run, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
        longest = _LONG_RUN
    live = None
    for at in range(0, longest, step):
        if at + step <= shortest:
            h = mix64(h ^ blocks[starts + at])
            continue
        live = np.flatnonzero((lengths > at) & (lengths <= longest)) if live is None else live[lengths[live] > at]
        block = blocks[starts[live] + at]
        if step == 8:
            block &= _MASK[np.minimum(lengths[live] - at, 8)]
        h[live] = mix64(h[live] ^ block)
    return h


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in order, and for each text the index of its first word (one more
    at the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[raw]
    full = offsets[1:] > offsets[:-1]
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    before[offsets[:-1][full]] = True
    after = np.empty(n, dtype=bool)
    after[:-1] = space[1:]
    after[-1] = True
    after[offsets[1:][full] - 1] = True
    starts = np.flatnonzero(~space & before)
    return starts, np.flatnonzero(~space & after) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and for each text the index of its first word (one more at the
    end)."""
    starts, ends, first = word_bounds(raw, offsets)
    return run_hashes(_LOWER[raw] if lower else raw, starts, ends - starts, 1), first


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Of one text's words, with repeats, in order."""
    n = len(words)
    if not n:
        return words
    if n < k:
        return mix64((words * _COEFFICIENT[:n]).sum(keepdims=True, dtype=np.uint64) + _U(n))
    total = words[: n - k + 1] * _COEFFICIENT[0]
    for j in range(1, k):
        total += words[j : n - k + 1 + j] * _COEFFICIENT[j]
    return mix64(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) > 1 else values


def shingle_sets(column, k: int):
    """The sorted distinct shingle hashes of each text of an Arrow string column."""
    words, first = word_hashes(*text_bytes(column))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield distinct(shingle_hashes(words[a:b], k))
