"""Byte-level BPE by length-bucketed padded matrices.

Pieces of a length bucket lie as rows of one matrix of token ids.  In every round each row merges its leftmost pair of
minimum rank; pair ranks come from a hash table in two arrays; what follows the merged pair moves up by one, finished rows
leave the matrix and the matrix narrows as its rows shorten.  A piece of more than _WIDE bytes is a matrix of one row, which
merges all places of its minimum rank in one round, from the left as far as no merge makes a pair of lower rank, and is
compacted when a quarter of it is gone: the same merges in the same order, in as many rounds as ranks, not as merges.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.segments import Coder, gather
from panelyard.llm.shared import SLICE_BYTES, text_slices

_NONE = np.int32(2**31 - 1)
_WIDE = 4096


class PairTable:
    """Rank of the token that two tokens make, by open addressing with linear probing."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(len(pairs) * 3).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        slot, left = self._home(pairs), np.arange(len(pairs))
        while len(left):
            here = slot[left]
            free = self.keys[here] == -1
            first = np.zeros(len(left), bool)
            first[np.unique(here, return_index=True)[1]] = True
            put = left[free & first]
            self.keys[slot[put]], self.ranks[slot[put]] = pairs[put], ranks[put]
            left = left[~(free & first)]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _home(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; a negative id (padding) pairs with nothing."""
        pairs = (left.astype(np.int64) << 32) | right.astype(np.int64)
        pairs[(left < 0) | (right < 0)] = -2
        slot = self._home(pairs)
        out, open_ = np.full(pairs.shape, _NONE, np.int32), np.flatnonzero(pairs.ravel() >= 0)
        flat, pairs, slot = out.ravel(), pairs.ravel(), slot.ravel()
        while len(open_):
            have = self.keys[slot[open_]]
            same = have == pairs[open_]
            flat[open_[same]] = self.ranks[slot[open_[same]]]
            open_ = open_[~same & (have != -1)]
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
        return flat.reshape(out.shape)


class Merges:
    """A vocabulary of ranks (a rank is the token's id), ready to encode and decode."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        made = [(ranks[a], ranks[b], rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := token[:k]) in ranks and (b := token[k:]) in ranks]
        left, right, rank = (np.array(x, np.int64) for x in (zip(*made) if made else ([], [], [])))
        self.pairs = PairTable((left << 32) | right, rank.astype(np.int32))
        spelled = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            spelled[rank] = token
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_ends = np.concatenate([[0], np.cumsum([len(x) for x in spelled])])

    def pieces(self, spellings: list[bytes]) -> list[list[bytes]]:
        return [[p.encode() for p in self.pattern.findall(s.decode())] for s in spellings]

    def encode(self, spellings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The spellings' ids one after the other, and how many each has."""
        split = self.pieces(spellings)
        distinct = list(dict.fromkeys(chain.from_iterable(split)))
        number = {p: k for k, p in enumerate(distinct)}
        values, ends = self._pieces(distinct)
        rows = np.fromiter((number[p] for p in chain.from_iterable(split)), np.int64, sum(map(len, split)))
        ids, stop = gather(values, ends, rows)
        last = np.cumsum([len(x) for x in split], dtype=np.int64)
        total = np.concatenate([[0], stop])[np.concatenate([[0], last])]
        return ids, np.diff(total)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.spelled, self.spelled_ends, ids.astype(np.int64))[0].tobytes()

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        done: list[tuple[np.ndarray, np.ndarray]] = []  # piece numbers, rows padded with -1
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        at = np.flatnonzero(whole >= 0)
        if len(at):
            done.append((at, whole[at][:, None].astype(np.int32)))
        rest = np.flatnonzero(whole < 0)
        sizes = np.array([len(pieces[k]) for k in rest.tolist()], np.int64)
        buckets = np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
        for bucket in np.unique(buckets).tolist():
            own = rest[buckets == bucket]
            step = max(1, (1 << 20) >> bucket)
            for k in range(0, len(own), step):
                done += self._bucket(own[k : k + step], [pieces[i] for i in own[k : k + step].tolist()])
        count = np.zeros(len(pieces), np.int64)
        for rows, ids in done:
            count[rows] = (ids >= 0).sum(1)
        ends = np.concatenate([[0], np.cumsum(count)])
        values = np.zeros(int(ends[-1]), np.int32)
        for rows, ids in done:
            r, c = np.nonzero(ids >= 0)
            values[ends[rows[r]] + c] = ids[r, c]
        return values, ends

    def _bucket(self, rows: np.ndarray, pieces: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        if width > _WIDE:
            return [(rows[k : k + 1], self._long(pieces[k])[None, :]) for k in range(len(pieces))]
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        filled = np.arange(width)[None, :] < size[:, None]
        ids[:, :width][filled] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width + 1), _NONE, np.int32)
        ranks[:, :width] = self.pairs.look(ids[:, :-1], ids[:, 1:])
        out = []
        while len(rows):
            place = ranks.argmin(1)
            line = np.arange(len(rows))
            best = ranks[line, place]
            over = best == _NONE
            if over.any():
                out.append((rows[over], ids[over]))
                going = ~over
                rows, size, ids, ranks, place, best = rows[going], size[going], ids[going], ranks[going], place[going], best[going]
                if not len(rows):
                    break
                line = np.arange(len(rows))
                if (narrow := int(size.max()) + 1) < ids.shape[1]:
                    ids, ranks = ids[:, :narrow].copy(), ranks[:, :narrow].copy()
            ids[line, place] = best
            beyond = np.arange(ids.shape[1] - 1)[None, :] > place[:, None]
            ids[:, :-1] = np.where(beyond, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(beyond, ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, _NONE
            size = size - 1
            ranks[line, place] = self.pairs.look(ids[line, place], ids[line, place + 1])
            front = line[place > 0]
            ranks[front, place[front] - 1] = self.pairs.look(ids[front, place[front] - 1], ids[front, place[front]])
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """The ids of one long piece.  A merged-away place stays, marked _NONE in rank and -1 in id, until the next compaction."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        ranks, after, before, gone = self._linked(ids)
        while n > 1:
            rank = ranks.min()
            if rank == _NONE:
                break
            at = np.flatnonzero(ranks == rank)
            overlaps = np.zeros(len(at), bool)
            overlaps[1:] = at[1:] == after[at[:-1]]
            if overlaps.any():  # of a run of overlapping places every other one, from its first
                first = np.maximum.accumulate(np.where(overlaps, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            second = after[at]
            third = after[second]
            touching = np.zeros(len(at), bool)
            touching[1:] = at[1:] == third[:-1]
            left = np.where(touching, rank, np.where(before[at] >= 0, ids[np.maximum(before[at], 0)], -1)).astype(np.int32)
            right = np.where(third < len(ids), ids[np.minimum(third, len(ids) - 1)], -1).astype(np.int32)
            own = np.full(len(at), rank, np.int32)
            sooner = np.minimum(self.pairs.look(left, own), self.pairs.look(own, right)) < rank
            if sooner.any():  # that pair comes before the places that follow
                stop = int(sooner.argmax()) + 1
                at, second, third = at[:stop], second[:stop], third[:stop]
            ids[at], ids[second], ranks[second] = rank, -1, _NONE
            after[at] = third
            inside = third < len(ids)
            before[third[inside]] = at[inside]
            for p in (at, before[at][before[at] >= 0]):
                q = after[p]
                ranks[p] = self.pairs.look(ids[p], np.where(q < len(ids), ids[np.minimum(q, len(ids) - 1)], -1).astype(np.int32))
            n, gone = n - len(at), gone + len(at)
            if 4 * gone > len(ids):
                ids = ids[ids >= 0]
                ranks, after, before, gone = self._linked(ids)
        return ids[ids >= 0]

    def _linked(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Ranks of each place with the next (_NONE at the end), the next and the last place of each, and no place gone."""
        n = len(ids)
        ranks = np.full(n, _NONE, np.int32)
        ranks[:-1] = self.pairs.look(ids[:-1], ids[1:])
        return ranks, np.arange(1, n + 1), np.arange(-1, n - 1), 0


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Merges:
    """A rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> Coder:
    return Coder(load(path, pattern).encode, whole=pattern != public_tokenizers.PATTERN)


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, most=2 * SLICE_BYTES):
            ids, at = _coder(path, pattern).code(texts)
            whole = ids.astype("<u4").tobytes()
            del ids
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([whole[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["doc_id", "ids"])
        _coder(path, pattern).forget()  # the worker may serve other stages next

    return run


def _decoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = load(path, pattern)
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                spelled = [table.decode(np.frombuffer(x or b"", "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(spelled, pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


_IDS, _DECODED = "doc_id long, ids binary", "doc_id long, ids binary, decoded binary"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id and ids (binary: little-endian unsigned 32-bit), one row per row.

    Null and empty texts have no ids; repeated rows repeat; other columns are not read.  path: a tokenizer's rank file on
    every executor; pattern: what splits texts before the merges (for another than public_tokenizers.PATTERN texts are not cut
    into segments first).  A piece of any length is encoded exactly.
    """
    return _texts(docs).mapInArrow(_encoder(path, pattern), _IDS)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of ``encode`` as doc_id, ids and decoded (binary: the bytes that the ids spell); null ids spell nothing."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path, pattern), _DECODED)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encoded and decoded again, in one pass of one worker: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    forth, back = _encoder(path, pattern), _decoder(path, pattern)
    both = _texts(docs).mapInArrow(lambda batches: back(forth(batches)), _DECODED)
    return both.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
