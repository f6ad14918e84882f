"""Benchmark decontamination with suffix arrays of the training text.

Each shard (some megabytes of documents inside a task) gets a suffix array over its words.  Every test suffix (a benchmark
item from one of its words on) is binary-searched in it, word by word; the interval that is left after ``window`` words
holds the window's occurrences, the last interval that is not empty the longest verbatim match.  Only stretches that hold
some item's first words somewhere (a seed of up to three words) enter the array: no other suffix can match a window.

The benchmark is a stated query set.  It is sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text, each block a
separate pass over the documents; per-document intervals of several passes are joined by document before they are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import Tables, text_slices
from panelyard.llm.words import Words, words

WINDOW = 10
#: Text bytes of benchmark items that one pass takes to the tasks.
BLOCK_BYTES = 8 << 20
_SEED = 3


class TestSuffixes:
    """The benchmark items of one block as word numbers from 1, all in a row with a 0 after each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        found = words(pa.array([text for _, text in items], pa.string()))
        self.spellings = found.spellings
        sizes = np.diff(found.first)
        self.names = [name for (name, _), n in zip(items, sizes, strict=True) if n]
        pieces = [found.ids[found.first[k] : found.first[k + 1]] + 1 for k in np.flatnonzero(sizes)]
        self.row = np.concatenate([x for p in pieces for x in (p, [0])]) if pieces else np.zeros(0, np.int64)
        own = np.array([len(p) for p in pieces], np.int64)
        self.item = np.repeat(np.arange(len(own)), own + 1)
        ends = np.cumsum(own + 1) - 1
        self.left = ends[self.item] - np.arange(len(self.row)) if len(own) else np.zeros(0, np.int64)  # words from here on
        self.offset = (own[self.item] - self.left) if len(own) else self.left
        self.window = np.minimum(window, own)[self.item] if len(own) else self.left
        self.longest = int(own.max(initial=0))
        self.seed = int(min(_SEED, np.minimum(window, own).min(initial=_SEED)))
        self.base = len(self.spellings) + 1
        while self.seed > 1 and self.base**self.seed >= 1 << 62:
            self.seed -= 1
        self.suffix = np.flatnonzero(self.left >= self.seed)
        self.seeds = np.unique(self._grams(self.row)[self.suffix]) if len(self.suffix) else np.zeros(0, np.int64)

    def _grams(self, row: np.ndarray) -> np.ndarray:
        padded = np.concatenate([row, np.zeros(self.seed, np.int64)])
        out = padded[: len(row)].copy()
        for k in range(1, self.seed):
            out = out * self.base + padded[k : k + len(row)]
        return out

    def numbered(self, found: Words) -> np.ndarray:
        """The shard's words by the benchmark's numbers, 0 where it has no such word."""
        if not len(found.ids):
            return found.ids
        known = pc.fill_null(pc.index_in(found.spellings, value_set=self.spellings), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        return known[found.ids]


class ShardSuffixes:
    """Suffix array over the stretches of a shard's words in which some test suffix can match."""

    def __init__(self, row: np.ndarray, first: np.ndarray, tests: TestSuffixes):
        n = len(row)
        self.place = np.zeros(0, np.int64)
        if not n or not len(tests.seeds):
            self.text = self.order = self.place
            return
        last = np.zeros(n + 1, bool)
        last[first] = True  # a document's first word: no match runs over it
        full, whole = np.zeros(n, bool), max(0, n - tests.seed + 1)
        full[:whole] = row[:whole] > 0
        for k in range(1, tests.seed):
            full[:whole] &= (row[k : whole + k] > 0) & ~last[k : whole + k]
        at = np.flatnonzero(full)
        grams = row[at]
        for k in range(1, tests.seed):
            grams = grams * tests.base + row[at + k]
        near = np.searchsorted(tests.seeds, grams)
        near[near == len(tests.seeds)] = 0
        at = at[tests.seeds[near] == grams]
        use = np.zeros(n + 1, np.int8)
        for k in range(tests.seed):
            use[at + k] = 1
        covered = np.flatnonzero(use[:n])
        if not len(covered):
            self.text = self.order = self.place
            return
        gap = np.ones(len(covered), bool)
        gap[1:] = (np.diff(covered) > 1) | last[covered[1:]]
        slot = np.arange(len(covered)) + np.cumsum(gap)  # a 0 before each stretch
        size = int(slot[-1]) + 2
        self.text, self.place = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.text[slot], self.place[slot] = row[covered], covered
        rank, depth = np.unique(self.text, return_inverse=True)[1].astype(np.int64), 1
        while depth < tests.longest:
            ahead = np.zeros(size, np.int64)
            ahead[: size - depth] = rank[depth:]
            new = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
            depth *= 2
            if new.max() == rank.max() or new.max() == size - 1:
                rank = new
                break
            rank = new
        self.order = np.argsort(rank, kind="stable")

    def search(self, tests: TestSuffixes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """After each number of words: the test suffixes that still match, and their intervals of the array."""
        size = len(self.order)
        if not size:
            return
        alive = tests.suffix
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), size, np.int64)
        for depth in range(tests.longest):
            want = tests.row[alive + depth]
            new = []
            for side in (0, 1):
                a, b = lo.copy(), hi.copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    have = self.text[np.minimum(self.order[np.minimum(mid, size - 1)] + depth, size - 1)]
                    right = open_ & ((have < want) if side == 0 else (have <= want))
                    a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
                new.append(a)
            left = new[0] < new[1]
            alive, lo, hi = alive[left], new[0][left], new[1][left]
            if not len(alive):
                return
            yield depth + 1, alive, lo, hi
            more = tests.left[alive] > depth + 1
            alive, lo, hi = alive[more], lo[more], hi[more]
            if not len(alive):
                return

    def places(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The shard's word positions in the intervals, one interval after the other."""
        many = hi - lo
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return self.place[self.order[np.repeat(lo, many) + within]]


def _hits(found: Words, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which words are hit; the pairs (document, item) as document * items + item; each document's longest match, and its start."""
    shard = ShardSuffixes(tests.numbered(found), found.first, tests)
    edge, pairs, doc_of = np.zeros(len(found.ids) + 1, np.int64), [], found.doc_of()
    longest, start = np.zeros(len(found.first) - 1, np.int64), np.zeros(len(found.first) - 1, np.int64)
    for depth, alive, lo, hi in shard.search(tests):
        if depth >= _SEED:  # matches only get longer, so the last depth that a document is met at stands
            every = np.sort(shard.places(lo, hi))
            docs, first = np.unique(doc_of[every], return_index=True)
            longest[docs], start[docs] = depth, every[first] - found.first[docs]
        here = tests.window[alive] == depth
        if here.any():
            at = shard.places(lo[here], hi[here])
            np.add.at(edge, at, 1)
            np.add.at(edge, at + depth, -1)
            pairs.append(np.unique(doc_of[at] * len(tests.names) + np.repeat(tests.item[alive[here]], (hi - lo)[here])))
    return np.cumsum(edge[:-1]) > 0, np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64), longest, start


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(names))).encode()).hexdigest()


def _scan(tests: TestSuffixes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            found = words(texts)
            hit, pairs, longest, start = _hits(found, tests)
            n = len(texts)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[found.first[1:]] - total[found.first[:-1]]
            names: list[list[str]] = [[] for _ in range(n)]
            for pair in pairs.tolist():
                names[pair // len(tests.names)].append(tests.names[pair % len(tests.names)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(found.first)), pa.array(n_hit.astype(np.int64)), pa.array([len(set(x)) for x in names], pa.int64()), pa.array(list(map(_digest, names))), pa.array(n_hit > 0), pa.array(longest), pa.array(start, mask=longest == 0)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_start"],
            )

    return run


def _scan_spans(tests: TestSuffixes):
    """For several passes: per document and pass the hit stretches and items, still to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            found = words(texts)
            hit, pairs, longest, start = _hits(found, tests)
            names: list[list[str]] = [[] for _ in range(len(texts))]
            for pair in pairs.tolist():
                names[pair // len(tests.names)].append(tests.names[pair % len(tests.names)])
            spans = []
            for a, b in zip(found.first[:-1], found.first[1:], strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                spans.append([{"a": int(x), "b": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), pa.array(np.diff(found.first)), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())), pa.array(longest), pa.array(start, mask=longest == 0)],
                names=["row_id", "doc_id", "n_words", "spans", "names", "longest_match", "longest_start"],
            )

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, one at a time on the driver (an item above the bound is a block alone)."""
    block, held = [], 0
    for name, text in _items(benchmark).toLocalIterator():
        if block and held + len(text.encode()) > block_bytes:
            yield block
            block, held = [], 0
        block.append((name, text))
        held += len(text.encode())
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, longest_start.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A window is ``window`` consecutive words of an
    item, a shorter item (not an empty one) is one window.  Words inside an occurrence are hit, once however many windows
    cover them.  Null or empty text has no words; null item ids are empty strings; repeated items count once by id; an
    empty benchmark hits nothing; every row of ``docs`` gets its row, repeated ones too.  Other columns are not read.
    longest_match is the length in words of the longest stretch that stands in an item word for word (three at least, else 0),
    longest_start the word where the first of that length begins (null without one).
    """
    base, schema = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_start long"
    blocks = list(_blocks(benchmark, block_bytes)) if _one_block(benchmark, block_bytes) else None
    if blocks is not None:
        return base.mapInArrow(_scan(TestSuffixes(blocks[0] if blocks else [], window)), schema)
    tables, parts = Tables(base.sparkSession, "decontaminate"), None
    rows = tables.kept(base.withColumn("row_id", F.monotonically_increasing_id()), "rows")
    for block in _blocks(benchmark, block_bytes):
        part = rows.mapInArrow(_scan_spans(TestSuffixes(block, window)), "row_id long, doc_id long, n_words long, spans array<struct<a:long,b:long>>, names array<string>, longest_match long, longest_start long")
        part = tables.kept(part, "pass")  # so that no plan holds more than one block
        parts = part if parts is None else parts.unionByName(part)
    joined = parts.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.max("longest_match").alias("longest_match"), F.max_by("longest_start", F.struct("longest_match", -F.col("longest_start"))).alias("longest_start"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")),
        lambda s: s["n"],
    )
    return joined.select("doc_id", "n_words", covered.alias("n_hit"), F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"), (covered > 0).alias("contaminated"), "longest_match", "longest_start")


def _one_block(benchmark: DataFrame, block_bytes: int) -> bool:
    held = _items(benchmark).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return held <= block_bytes


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; all columns stay, whatever their names."""
    columns, tables, single = docs.columns, Tables(docs.sparkSession, "decontaminate"), _one_block(benchmark, block_bytes)
    for block in _blocks(benchmark, block_bytes):
        tests = TestSuffixes(block, window)

        def keep(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_slices(batches):
                found = words(texts)
                hit, *_ = _hits(found, tests)
                total = np.concatenate([[0], np.cumsum(hit)])
                yield batch.filter(pa.array(total[found.first[1:]] == total[found.first[:-1]]))

        docs = docs.mapInArrow(keep, docs.schema)
        if not single:
            docs = tables.kept(docs, "pass")
    return docs.select(*columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim match of every test suffix that matches at all: item, item_offset, n_words, doc_id, doc_offset.

    Each shard names one place of its longest match; the longest of all shards wins, then the smallest doc_id and offset.
    Matches shorter than the seed (three words, or the shortest item's) are not looked for.
    """
    base, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), None
    tables, single = Tables(docs.sparkSession, "longest-matches"), _one_block(benchmark, block_bytes)
    for block in _blocks(benchmark, block_bytes):
        tests = TestSuffixes(block)

        def scan(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_slices(batches):
                found = words(texts)
                shard = ShardSuffixes(tests.numbered(found), found.first, tests)
                best: dict[int, tuple[int, int]] = {}
                for depth, alive, lo, _ in shard.search(tests):
                    best |= {s: (depth, x) for s, x in zip(alive.tolist(), shard.place[shard.order[lo]].tolist(), strict=True)}
                ids, doc_of = batch.column("doc_id").to_pylist(), found.doc_of()
                rows = [(tests.names[tests.item[s]], int(tests.offset[s]), d, ids[doc_of[x]], int(x - found.first[doc_of[x]])) for s, (d, x) in best.items() if d >= tests.seed]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["item", "item_offset", "n_words", "doc_id", "doc_offset"])

        part = base.mapInArrow(scan, "item string, item_offset long, n_words long, doc_id long, doc_offset long")
        part = part if single else tables.kept(part, "pass")  # so that no plan holds more than one block
        out = part if out is None else out.unionByName(part)
    if out is None:
        return base.sparkSession.createDataFrame([], "item string, item_offset long, n_words long, doc_id long, doc_offset long")
    first = F.min_by(F.struct("n_words", "doc_id", "doc_offset"), F.struct(-F.col("n_words"), "doc_id", "doc_offset"))
    return out.groupBy("item", "item_offset").agg(first.alias("best")).select("item", "item_offset", "best.*")
