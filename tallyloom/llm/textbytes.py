"""Whole-batch work on UTF-8 bytes of Arrow string columns, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20

#: Which bytes are ASCII white space, and bytes with A to Z in lower case.
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[0x41:0x5B] += 32
#: 1 letter, 2 digit, 3 another sign; 0 white space, control characters and all that isn't ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of consecutive rows of a string column without nulls; offsets start at 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offset_buf, data_buf = column.buffers()
    offsets = np.frombuffer(offset_buf, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of other than ASCII white space, also parted before ``cuts``.

    None crosses a document's end.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE_BYTES[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    if cuts is not None:
        first |= cuts
        last[:-1] |= cuts[1:]
    full = offsets[1:] > offsets[:-1]
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    first[begin] = word[begin]
    last[end] = word[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow binary column."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    at = np.arange(offsets[-1], dtype=np.int64) + np.repeat(starts - offsets[:-1], lengths)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def kind_cuts(data: np.ndarray) -> np.ndarray:
    """Where a letter, a digit and another sign meet, as a mask of the later byte.

    The patterns of byte-level BPE match letters, digits and other signs apart, but for an apostrophe
    with letters after it.  Kinds are told for ASCII and for the letters of Latin-1; next to any other
    byte nothing is cut.
    """
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        letter = lead[~np.isin(data[lead + 1], (0x97, 0xB7))]
        kind[letter] = kind[letter + 1] = 1
    cut = np.zeros(len(data), bool)
    before, after = kind[:-1], kind[1:]
    cut[1:] = (before != after) & (before > 0) & (after > 0) & ~((data[:-1] == 0x27) & (after == 1))
    return cut


def cut_bounds(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> np.ndarray:
    """Where the texts may be cut before white space without any change of a byte-level BPE's pieces.

    The pattern that such tokenizers split by never matches across a place between a character that isn't
    white space and white space.  Whether the byte before belongs to white space is known for ASCII,
    for two-byte characters above U+00BF and for others by their lead bytes; no cut is made in doubt.
    Returns the starts of the parts; each document that isn't empty starts one.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    space = SPACE_BYTES[data]
    at = np.flatnonzero(space)
    at = at[at > 0]
    b1 = data[at - 1]
    b2 = np.where(at > 1, data[np.maximum(at - 2, 0)], 0)
    b3 = np.where(at > 2, data[np.maximum(at - 3, 0)], 0)
    b4 = np.where(at > 3, data[np.maximum(at - 4, 0)], 0)
    safe = (b1 > 0x20) & (b1 < 0x7F)
    tail = b1 >= 0x80
    safe |= tail & (b2 >= 0xC3) & (b2 <= 0xDF)
    tail2 = tail & (b2 >= 0x80) & (b2 < 0xC0)
    safe |= tail2 & (b3 >= 0xE4) & (b3 <= 0xEF)
    safe |= tail2 & (b3 >= 0x80) & (b3 < 0xC0) & (b4 >= 0xF0)
    cut = np.zeros(len(data), bool) if cuts is None else cuts
    cut[at[safe]] = True
    cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(cut)


def grouped_take(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``flat[begins[c] : begins[c] + lengths[c]]`` over ``codes``; also the ends of the parts."""
    n = lengths[codes]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(begins[codes] - (ends - n), n)
    return flat[at], ends
