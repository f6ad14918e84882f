"""Near-duplicate groups by SimHash: 64-bit fingerprints linked at a few differing bits, found with BK-trees.

1.  A text's fingerprint has a bit where more than half of its four-word shingles' hashes (repeats included) have it.  Texts
    with one fingerprint are one node from here on.
2.  Nodes are dealt to shards.  The 64 bits are cut in RADIUS + 1 parts; two fingerprints within the radius agree on a whole
    part, so each node stands in one shard for each part.  A shard that is too large for one tree is dealt again on the bits
    that its nodes do not share yet, by the same argument, so no pair is lost and no shard stays large: 2**b nodes are the
    most that fit in a shard whose nodes differ in b bits only.
3.  In each shard the nodes near its least one are linked with it, and shards that hold one component after that are done: a
    dense group of near copies costs its own size.
4.  The other shards get a BK-tree each: a node's children are keyed by their Hamming distance to it, and a search at distance
    d follows the edges d - RADIUS to d + RADIUS only.  A task searches the trees of many shards at once, and hands on a
    spanning set of what it linked, never all pairs.  Trees stay with the rows of their shard, that are their queries too:
    broadcasting them would carry every fingerprint through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.near_dup import components
from panelyard.llm.shared import Tables, text_slices
from panelyard.llm.words import BLANKS, words

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Nodes of one tree at most; shards of more are dealt again.
TREE_NODES = 2048
#: Rows whose trees a task builds at once, and pairs that one step of its search may look at.
FOREST_ROWS, STEP_PAIRS = 1 << 16, 1 << 20

#: For each byte its eight bits in eight lanes, so that up to 255 of them can be added without a carry.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _shingle_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, and where each text's begin (one more than texts)."""
    found = words(texts, BLANKS)
    spelled = found.spellings.to_pylist()
    whole = b" ".join([spelled[i] for i in found.ids.tolist()])
    length = pc.binary_length(found.spellings).to_numpy(zero_copy_only=False).astype(np.int64)[found.ids] if len(spelled) else np.zeros(0, np.int64)
    stop = np.cumsum(length + 1) - 1
    start = stop - length
    n = np.diff(found.first)
    own = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(own)])
    head = np.repeat(found.first[:-1], own) + np.arange(at[-1]) - np.repeat(at[:-1], own)
    last = np.minimum(head + SHINGLE, np.repeat(found.first[1:], own)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(start[head].tolist(), stop[last].tolist(), strict=True)), np.uint64, len(head)), at


def fingerprints(texts: pa.StringArray) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text; a text without words has 0."""
    hashes, at = _shingle_hashes(texts)
    out, n = np.zeros(len(texts), np.uint64), np.diff(at)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    runs = -(-n[some] // 255)  # a text's shingles are added in runs that the lanes can hold
    first_run = np.cumsum(runs) - runs
    begin = np.repeat(at[:-1][some], runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    ends = np.append(begin[1:], len(hashes))
    counts = np.empty((len(begin), 64), np.uint8)
    for k in range(0, len(begin), 256):
        a, b = begin[k], ends[min(k + 256, len(begin)) - 1]
        lanes = _LANES[hashes[a:b].view(np.uint8).reshape(-1, 8)]
        counts[k : k + 256] = np.add.reduceat(lanes, begin[k : k + 256] - a, axis=0).view(np.uint8)
    total = np.add.reduceat(counts, first_run, axis=0, dtype=np.int64)
    out[some] = np.packbits(2 * total > n[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(texts).view(np.int64))], names=["doc_id", "node"])


@lru_cache(maxsize=4096)
def _parts(mask: int) -> list[int]:
    """The bits outside ``mask`` in RADIUS + 1 parts, each joined with ``mask``."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row (mask, node) once for each part of the bits that its shard does not share; key: the node's bits under the mask."""
    for batch in batches:
        masks, nodes = (batch.column(c).to_numpy().view(np.uint64) for c in ("mask", "node"))
        for mask in np.unique(masks).tolist():
            own = nodes[masks == mask]
            for wider in _parts(mask):
                bits = np.full(len(own), wider, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (bits, own & bits, own)], names=["mask", "key", "node"])


class Forest:
    """BK-trees of many shards.  Rows come shard by shard; a shard's first row is its root, fingerprints in a shard differ."""

    def __init__(self, shard: np.ndarray, prints: np.ndarray):
        self.prints = prints
        self.root = np.searchsorted(shard, shard)  # shards are sorted: the first row of each
        rows = np.flatnonzero(self.root != np.arange(len(shard)))
        above, edges = self.root[rows], []
        children = []
        while len(rows):
            key = above * 65 + np.bitwise_count(prints[rows] ^ prints[above])
            edge, first, own = np.unique(key, return_index=True, return_inverse=True)
            edges.append(edge)
            children.append(rows[first])
            above = rows[first][own]  # the first comer at this distance is the parent of the others
            stay = np.ones(len(rows), bool)
            stay[first] = False
            rows, above = rows[stay], above[stay]
        key = np.concatenate([np.zeros(0, np.int64), *edges])
        order = np.argsort(key, kind="stable")
        #: Edges as parent * 65 + distance, ascending, and the child at each.
        self.edge, self.child = key[order], np.concatenate([np.zeros(0, np.int64), *children])[order]

    def search(self, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) of one shard within the radius; all levels of all trees are walked together."""
        at, found = self.root[queries], []
        while len(queries):
            d = np.bitwise_count(self.prints[queries] ^ self.prints[at]).astype(np.int64)
            near = (d <= radius) & (queries != at)
            found.append((queries[near], at[near]))
            low = np.searchsorted(self.edge, at * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edge, at * 65 + np.minimum(d + radius, 64), side="right") - low
            place = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
            queries, at = np.repeat(queries, n), self.child[place]
        return tuple(np.concatenate([np.zeros(0, np.int64), *side]) for side in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect, fewer than there are ends."""
    ends, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    label = np.arange(len(ends))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            moved = label != np.arange(len(ends))
            return ends[label[moved]], ends[moved]
        label = new


def _linked(shard: np.ndarray, prints: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links between the components ``root`` of rows within the radius."""
    forest = Forest(shard, prints)
    size = np.bincount(np.unique(shard, return_inverse=True)[1])
    work = np.cumsum(np.repeat(size, size))
    cut = np.searchsorted(work, np.arange(0, work[-1], STEP_PAIRS)) if len(work) else np.zeros(0, np.int64)
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(prints)], strict=True):
        query, row = forest.search(np.arange(a, z))
        other = root[query] != root[row]
        low, high = spanning(root[query[other]], root[row[other]])
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, node, root) in the order of shards; whole shards are taken together."""
    held: list[np.ndarray] = []

    def run(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        yield from _linked(np.cumsum(new), rows[:, 2].view(np.uint64), rows[:, 3])

    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("mask", "key", "node", "root")], axis=1))
        if sum(map(len, held)) >= FOREST_ROWS:
            rows = np.ascontiguousarray(np.concatenate(held))
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
            whole = last[-1] + 1 if len(last) else 0
            yield from run(np.ascontiguousarray(rows[:whole]))
            held = [rows[whole:]]
    if held and len(rows := np.concatenate(held)):
        yield from run(np.ascontiguousarray(rows))


def components_within(nodes: DataFrame, tables: Tables, tree_nodes: int = TREE_NODES) -> DataFrame:
    """node, root (the least node that it is connected with) of the nodes that have a link; ``nodes``: distinct fingerprints."""
    dealt, labels, trees = nodes.select(F.lit(0).cast("long").alias("mask"), "node"), None, []
    while True:
        shards = dealt.mapInArrow(_deal, "mask long, key long, node long")
        shards = tables.kept(shards, "shards")
        ends = shards.groupBy("mask", "key").agg(F.min("node").alias("low"), F.count("*").alias("size")).where("size > 1")
        shards = tables.kept(shards.join(ends, ["mask", "key"]), "shared")
        star = shards.where((F.bit_count(F.col("node").bitwiseXOR(F.col("low"))) <= RADIUS) & (F.col("node") != F.col("low")))
        labels = components(star.select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), tables, labels)
        rooted = tables.kept(shards.join(labels, "node", "left").select("mask", "key", "node", "size", F.coalesce("root", "node").alias("root")), "rooted")
        several = rooted.groupBy("mask", "key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("mask", "key")
        open_ = tables.kept(rooted.join(several, ["mask", "key"], "left_semi"), "open")
        trees.append(open_.where(F.col("size") <= tree_nodes).select("mask", "key", "node", "root"))
        dealt = open_.where(F.col("size") > tree_nodes).select("mask", "node")
        if dealt.isEmpty():
            break
    links = []
    for rows in trees:
        sorted_ = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "node")
        links.append(tables.kept(sorted_.mapInArrow(_searched, "a long, b long"), "links"))
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    return components(every.distinct(), tables, labels)


def simhash(docs: DataFrame, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Per row: doc_id, fingerprint, component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, shingles four words joined by a space, each as often as it
    stands there; a text of fewer words is one shingle.  A text without words (null text too) has the fingerprint zero and is
    linked like any other.  Rows whose fingerprints differ in four bits or fewer are linked; component_id is the smallest
    doc_id reachable, the row's own included (null ids stand below no other; null if the whole group has none).  Repeated
    rows are rows each and share their answer; an empty table gives no row.  Other columns are not read.  tree_nodes shapes
    the work, not the rows.
    """
    own, work = Tables(docs.sparkSession, "simhash"), Tables(docs.sparkSession, "simhash-work")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = own.kept(base.mapInArrow(_fingerprinted, "doc_id long, node long"), "fingerprints")
    nodes = work.kept(rows.groupBy("node").agg(F.min("doc_id").alias("least_doc")), "nodes")
    labels = components_within(nodes.select("node"), work, tree_nodes)
    group = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = work.kept(group.groupBy("root").agg(F.min("least_doc").alias("component_id")), "least")  # a table, so that the join below can split a large component
    answers = own.kept(group.join(least, "root").select("node", "component_id"), "answers")
    work.drop()
    return rows.join(answers, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
