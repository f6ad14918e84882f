"""Words of many texts at once: byte classes by table look-up, spellings by Arrow's dictionary encoding.

A UTF-8 byte of 128 and above belongs to a character of 128 and above, so the byte classes below cut exactly where the
character classes do, and lower-casing A-Z is a table look-up too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from panelyard.llm.shared import raw


def _table(is_word) -> np.ndarray:
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return np.array([lower[b] if is_word(lower[b]) else 0x20 for b in range(256)], np.uint8)


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
LETTERS = _table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: ``[^\x20\x09-\x0D]+`` after lower-casing A-Z.
BLANKS = _table(lambda b: b != 32 and not 9 <= b <= 13)
#: Bytes that end a clause, ``[.,;:!?\x0A-\x0D]``, and ``[^\x20\x09]+`` between them after lower-casing A-Z.
CLAUSE_ENDS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
CLAUSES = _table(lambda b: b not in b" \t" and not CLAUSE_ENDS[b])


@dataclass
class Words:
    """ids: each word's index in ``spellings``; document d has the words ``first[d]:first[d + 1]``; starts: words' first bytes."""

    ids: np.ndarray
    spellings: pa.BinaryArray
    first: np.ndarray
    starts: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: pa.StringArray, table: np.ndarray = LETTERS) -> Words:
    data, begins = raw(texts)
    if len(data) == 0:
        return Words(np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64))
    low = table[data]
    inside = low != 0x20
    if table is BLANKS:
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, bool)  # a text's first byte
    cut[begins] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | cut[1:-1]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=at[1:])
    column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(low[inside]))])
    coded = column.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.searchsorted(starts, begins), starts)
