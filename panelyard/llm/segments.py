"""Texts cut at places where every pre-tokenizer of the usual pattern cuts, and coded by their spellings.

The pattern's alternatives hold a space only as their first character, before something that is not white space; a run of
letters ends where punctuation begins; a single line feed between visible characters stands alone.  So a cut there never
changes a text's tokens.  Cuts are made only where the neighbours are ASCII or letters of the block U+00C0 to U+00FF; other
places stay whole.  A batch's distinct segments are few beside its segments, so each is tokenized once.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa

from panelyard.llm.shared import raw

_VISIBLE, _MARK, _LETTER = 1, 2, 3  # digits and other visible characters, ASCII punctuation, letters
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _VISIBLE
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER


@dataclass
class Segments:
    """ids: each segment's index in ``spellings``; text t has the segments ``first[t]:first[t + 1]``."""

    ids: np.ndarray
    spellings: pa.BinaryArray
    first: np.ndarray


def segments(texts: pa.StringArray) -> Segments:
    data, begins = raw(texts)
    n = len(data)
    if n == 0:
        return Segments(np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64))
    kind = _KIND[data]
    wide = np.flatnonzero(data == 0xC3)
    wide = wide[wide < n - 1]
    letter = (data[wide + 1] != 0x97) & (data[wide + 1] != 0xB7)  # not the signs of multiplication and division
    kind[wide[letter]] = kind[wide[letter] + 1] = _LETTER
    kind[wide[~letter]] = kind[wide[~letter] + 1] = _VISIBLE
    seen = kind >= _VISIBLE
    cut = np.zeros(n + 1, bool)
    cut[1 : n - 1] = (data[1:-1] == 0x20) & seen[:-2] & seen[2:]
    line = np.flatnonzero(data[1:-1] == 0x0A) + 1
    line = line[seen[line - 1] & seen[line + 1]]
    cut[line] = cut[line + 1] = True
    cut[1:n] |= (kind[:-1] == _LETTER) & (kind[1:] == _MARK)
    cut[begins] = True
    cut[n] = False
    starts = np.flatnonzero(cut)
    at = np.append(starts, n).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    return Segments(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.searchsorted(starts, begins))


def uncut(texts: pa.StringArray) -> Segments:
    """Each text as the one segment that it has (an empty one has none)."""
    data, begins = raw(texts)
    first = np.concatenate([[0], np.cumsum(np.diff(begins) > 0)])
    ends = np.append(begins[:-1][np.diff(begins) > 0], len(data)).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    return Segments(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, first)


def gather(values: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value runs of ``ids`` one after the other, and where each ends; run k is ``values[ends[k]:ends[k + 1]]``."""
    size = (ends[1:] - ends[:-1])[ids]
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    at = np.arange(total) + np.repeat(ends[ids] - (stop - size), size)
    return values[at], stop


class Coder:
    """Token ids of texts by way of their segments; spellings seen before are not encoded again.

    encode: from a list of spellings to their ids one after the other and the number of ids of each.  Spellings that a slice
    holds twice or more are remembered, ``most`` of them; then the memory starts anew, which only costs time.  whole: texts
    are not cut, for a pattern or tokenizer that the cuts are not meant for.
    """

    def __init__(self, encode, most: int = 200_000, whole: bool = False):
        self.encode, self.most, self.whole = encode, most, whole
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.values, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def code(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's ids begin (one more than texts)."""
        found = uncut(texts) if self.whole else segments(texts)
        spellings = found.spellings.to_pylist()
        slots = np.fromiter(map(self.known.get, spellings, repeat(-1)), np.int64, len(spellings))
        values, ends = self.values, self.ends
        if (slots < 0).any():
            often = np.bincount(found.ids, minlength=len(spellings)) > 1
            new = np.flatnonzero(slots < 0)
            new = new[np.argsort(~often[new], kind="stable")]  # what is worth remembering first
            own = [spellings[k] for k in new.tolist()]
            fresh, sizes = self.encode(own)
            slots[new] = len(ends) - 1 + np.arange(len(new))
            values, ends = np.concatenate([values, fresh.astype(np.uint32)]), np.concatenate([ends, ends[-1] + np.cumsum(sizes)])
            keep = int(often[new].sum())
            if len(self.known) + keep > self.most:
                self.forget()
            else:
                self.known.update(zip(own[:keep], slots[new[:keep]].tolist(), strict=True))
                self.ends = ends[: len(self.ends) + keep].copy()
                self.values = values[: self.ends[-1]].copy()
        ids, stop = gather(values, ends, slots[found.ids])
        return ids, np.concatenate([[0], stop])[found.first]
