"""Vectorised word and shingle hashing over Arrow string buffers.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z is lower-cased.  Both
rules only concern ASCII bytes, which never occur inside a multi-byte UTF-8 sequence, so whole
texts are hashed on their raw bytes without building a Python object per word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
SLICE = 2 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_VALUE[65:91] = _VALUE[97:123]
_VALUE[_SPACE] = 0
_BASE = _U(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=_U)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(64, 1 << int(n - 1).bit_length())
        _powers = np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, _BASE, dtype=_U))])
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and n+1 offsets into them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches, size: int = SLICE):
    """Record batches cut so that their texts have about size bytes each, which bounds what one needs at a time."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.column("text").nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system at the end of a task, as workers stay for the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and n+1 offsets of the texts into the hashes."""
    raw, offsets = buffers(column)
    starts_of_text = np.zeros(len(raw) + 1, dtype=bool)
    starts_of_text[offsets[:-1]] = True
    found, places, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and not (_SPACE[raw[end]] or starts_of_text[end]):  # a piece ends between words
            step = raw[end : end + 4096]
            cut = np.flatnonzero(_SPACE[step] | starts_of_text[end : end + len(step)])
            end += int(cut[0]) if len(cut) else len(step)
        part = raw[at:end]
        inside = ~_SPACE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | starts_of_text[at + 1 : end]
        begin = np.flatnonzero(first)
        if len(begin):
            spans = np.diff(np.append(begin, len(part)))
            place = np.arange(len(part) - begin[0], dtype=np.int32) - np.repeat((begin - begin[0]).astype(np.int32), spans)
            powers = _power(int(spans.max()))
            found.append(mix(np.add.reduceat(_VALUE[part[begin[0] :]] * powers[place], begin - begin[0])))
            places.append(begin + at)
        at = end
    hashes = np.concatenate(found) if found else np.zeros(0, _U)
    begin = np.concatenate(places) if places else np.zeros(0, np.int64)
    return hashes, np.searchsorted(begin, offsets)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text; with fewer words, the whole sequence as one."""
    if len(words) == 0:
        return np.zeros(0, _U)
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, _U(width), dtype=_U)
    for i in range(width):
        out = out * _U(0x2545F4914F6CDD1D) + words[i : len(words) - width + 1 + i]
    return mix(out)


def word_codes(column: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of all texts, each word's place among them, and n+1 offsets of the texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = pc.fill_null(pa.concat_arrays([column]), "").cast(pa.large_string())  # Arrow's string kernels go wrong on slices
    runs = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    ends = runs.offsets.to_numpy()
    coded = pc.dictionary_encode(runs.flatten())
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    index = coded.indices.to_numpy()
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    upto = (ends - ends[0]).astype(np.int64)
    if empty >= 0:  # before leading and after trailing white space
        real = index != empty
        index = index[real]
        upto = np.concatenate([[0], np.cumsum(real, dtype=np.int64)])[upto]
    return coded.dictionary, index, upto
