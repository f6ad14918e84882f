"""Near-duplicate groups with SetSketch registers.

1.  Every text's set of five-word shingles (64-bit hashes) becomes a SetSketch: register i holds the truncated, exponentially
    spaced level of the least exponential variate that the i-th hash gives to any element.  Registers merge by maximum.
    Texts with the same set are one node from here on, so copies cost nothing further.
2.  Register values are banded.  In each band's bucket every node is paired with two of its nodes (a star each), the one of
    the least number and the hub, whose buckets hold the most nodes, not with each other.  The hub is the text that the
    others were made from, where there is one: it is nearer to all of them than they are to each other.  A pair's similarity is estimated jointly, by maximum likelihood over the counts of larger, smaller
    and equal registers given both set sizes; clear misses go, the rest is verified on full sets.
3.  Verified links are contracted to components.  Buckets that still hold several components compare nodes across them:
    small ones by pairs that are estimated and verified as before, large ones in cells of two blocks, so that no bucket must
    fit a task and no pair leaves it but a verified link.  A bucket's most common component meets the rest of the bucket only,
    never itself, so a hot bucket costs its size times the number of its strays.  Cells hold registers first; only the nodes
    that have a likely mate there come again with their full sets.  A cell keeps its own components while it goes, so one
    link joins two of them and their other pairs are passed over.  A pair in one bucket is then either linked by a path or
    was estimated, so stars lose no connection.

The chance that a pair of similarity 0.75 shares none of 32 bands of 4 registers is (1 - 0.75 ** 4) ** 32, about 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import Tables, text_slices
from panelyard.llm.words import BLANKS, words

SHINGLE = 5
REGISTERS, BAND = 128, 4
#: SetSketch: base of the levels, rate of the variates, highest level.
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
#: Links are 100 * intersection >= PERCENT * union; estimates below MAYBE (4.4 standard errors lower, missed at 5e-6) are not verified.
PERCENT, MAYBE = 75, 0.58
#: Buckets of up to SMALL_BUCKET nodes pair them by a join; larger ones meet in blocks of about BUCKET_BLOCK nodes.
SMALL_BUCKET, BUCKET_BLOCK = 16, 256
#: Shingles of a block, about, so that long texts make smaller blocks: 64 MB of sets.
BLOCK_SHINGLES = 8_000_000
_MIX = np.random.default_rng(20_240_117)
_MULTIPLY = (_MIX.integers(0, 2**32, (REGISTERS, 2), np.uint64) | 1).astype(np.uint32)


def shingle_sets(texts: pa.StringArray) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: five words, or all words of a text that has fewer; none without words."""
    found = words(texts, BLANKS)
    spelled = np.array([xxhash.xxh3_64_intdigest(s) for s in found.spellings.to_pylist()], np.uint64)
    row = spelled[found.ids] if len(found.ids) else np.zeros(0, np.uint64)
    n = max(0, len(row) - SHINGLE + 1)
    with np.errstate(over="ignore"):
        mixed = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            mixed = (mixed ^ row[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
    out = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(mixed[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(row[a:b].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(own: np.ndarray) -> np.ndarray:
    """SetSketch registers (levels 0 to TOP + 1) of a set of hashes; an empty set has zeros."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(own), 2048):
        part = own[k : k + 2048]
        a, b = (part >> np.uint64(32)).astype(np.uint32), part.astype(np.uint32)
        low = np.minimum(low, (a[None, :] * _MULTIPLY[:, :1] + b[None, :] * _MULTIPLY[:, 1:]).min(1))
    if not len(own):
        return np.zeros(REGISTERS, np.uint16)
    least = -np.log1p(-(low.astype(float) + 1) / 2.0**32 * (1 - 1e-12)) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, steps: int = 40) -> np.ndarray:
    """Maximum likelihood of the similarity J, for each row of two register matrices and the sets' known sizes.

    A register is larger on the left with probability p(u - v J), smaller with p(v - u J), where u and v are the sizes' shares
    and p(x) = -log_b(1 - x (b - 1) / b); the log likelihood is concave, so a ternary search finds its peak.
    """
    more, less = (left > right).sum(1), (left < right).sum(1)
    same = left.shape[1] - more - less
    u = n_left / (n_left + n_right)
    v = 1 - u
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = likelihood(a) < likelihood(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def reaches(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, least: float) -> np.ndarray:
    """Whether :func:`estimate` is at least ``least``: the likelihood, being concave, still rises there."""
    more, less = (left > right).sum(1), (left < right).sum(1)
    same = left.shape[1] - more - less
    u = n_left / (n_left + n_right)
    v = 1 - u
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-x * c) / np.log(BASE)
    slope = lambda x: c / (1 - x * c) / np.log(BASE)
    x, y = np.maximum(u - v * least, 1e-12), np.maximum(v - u * least, 1e-12)
    a, b, da, db = p(x), p(y), -v * slope(x), -u * slope(y)
    rising = more * da / a + less * db / b - same * (da + db) / np.maximum(1 - a - b, 1e-12) >= 0
    return rising & (np.minimum(u / v, v / u) >= least)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches):
        sets = shingle_sets(texts)
        marks = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())],
            names=["doc_id", "text_hash", "n_shingles", "mark", "registers"],
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_bands = REGISTERS // BAND
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint64).reshape(batch.num_rows, n_bands)  # four registers a band
        with np.errstate(over="ignore"):
            key = (rows ^ (np.arange(n_bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None, :]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        node = np.repeat(batch.column("node").to_numpy(), n_bands)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], names=["bucket", "node"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 4096):
            batch = whole.slice(k, 4096)
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("registers_a", "registers_b"))
            near = pa.array(reaches(left, right, batch.column("n_a").to_numpy().astype(float), batch.column("n_b").to_numpy().astype(float), MAYBE))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], names=["a", "b"])


def _likely_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimate is not a clear miss."""
    for side in ("a", "b"):
        own = nodes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("registers").alias(f"registers_{side}"))
        pairs = pairs.join(own, side)
    sized = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")  # else the union is too large already
    return pairs.where(sized).select("a", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(_likely, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return pairs.where(100 * common >= PERCENT * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def components(links: DataFrame, tables: Tables, labels: DataFrame | None = None) -> DataFrame:
    """node, root for every node of the links (a, b) and of earlier labels: the least node it is connected with.

    Each round hooks every node to its least neighbour, follows the hooks to their ends and replaces the links' ends by them;
    links whose ends have met go.  A round's tables are written to the shared folder, so lineage stays short.
    """
    edges = links.select("a", "b")
    if labels is None:
        nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
        labels = nodes.withColumn("root", F.col("node"))
    else:
        more = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct().join(labels, "node", "left_anti")
        labels = labels.union(more.withColumn("root", F.col("node")))
        edges = _moved(edges, labels)
    edges = tables.kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        hook = _contracted(edges, tables)
        higher = hook.select(F.col("node").alias("root"), F.col("root").alias("lower"))
        labels = labels.join(higher, "root", "left").select("node", F.coalesce("lower", "root").alias("root"))
        edges = tables.kept(_moved(edges, hook).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return tables.kept(labels, "labels")


def _moved(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges between their ends' roots (an end that has none stays)."""
    for side in ("a", "b"):
        edges = edges.join(roots.select(F.col("node").alias(side), F.col("root").alias("_root")), side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
    return edges


def _contracted(edges: DataFrame, tables: Tables) -> DataFrame:
    """For the higher end of each edge its least neighbour, followed down to a node that has none."""
    hook = tables.kept(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hook")
    while True:
        onward = hook.select(F.col("node").alias("root"), F.col("root").alias("lower"))
        moved = tables.kept(hook.join(onward, "root", "left").select("node", F.coalesce("lower", "root").alias("root"), F.col("lower").isNotNull().alias("moved")), "hook")
        hook = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return hook


def _split_buckets(shared: DataFrame, labels: DataFrame, tables: Tables) -> DataFrame:
    """bucket, node, root, size of the buckets that hold several components; one of those with the same nodes."""
    rooted = tables.kept(shared.select("bucket", "node", "size").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    same = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"nodes_{seed}") for seed in (0, 1)]
    several = rooted.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.max("size").alias("n"), *same).where("r <> s")
    return rooted.join(several.groupBy("nodes_0", "nodes_1", "n").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket", "left_semi")


def _crossing_pairs(members: DataFrame, small_bucket: int) -> DataFrame:
    """All pairs (a, b) of different components in buckets of up to ``small_bucket`` nodes."""
    small = members.where(F.col("size") <= small_bucket)
    left = small.select("bucket", F.col("node").alias("a"), F.col("root").alias("root_a"))
    right = small.select("bucket", F.col("node").alias("b"), F.col("root").alias("root_b"))
    return left.join(right, "bucket").where("a < b and root_a <> root_b").select("a", "b").distinct()


def _crossing_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, tables: Tables, small_bucket: int, bucket_block: int) -> DataFrame:
    """Verified links (a, b) between components in the larger buckets, enough to join what can be joined.

    Blocks 0 to strays - 1 hold the nodes outside the bucket's most common component, the blocks after them hold that one's.
    Every block meets every block of strays.
    """
    large = members.where(F.col("size") > small_bucket).join(nodes.select("node", "n_shingles"), "node")
    shares = large.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    first = F.max(F.struct("n", "root", "s"))  # the most nodes, then the greater root
    most = shares.groupBy("bucket").agg(first.alias("first"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    blocks = lambda n, s: F.ceil(F.greatest(n / bucket_block, s / BLOCK_SHINGLES)).cast("int")
    strays = blocks(F.col("n") - F.col("first.n"), F.col("s") - F.col("first.s"))
    most = tables.kept(most.select("bucket", F.col("first.root").alias("most"), strays.alias("strays"), blocks(F.col("first.n"), F.col("first.s")).alias("common")), "most")
    strays, common, number = F.col("strays"), F.col("common"), F.xxhash64("node")
    block = F.when(F.col("root") == F.col("most"), strays + F.pmod(number, common)).otherwise(F.pmod(number, strays)).cast("int")
    met = F.sequence(F.lit(0), F.when(F.col("root") == F.col("most"), strays - 1).otherwise(strays + common - 1))
    dealt = large.join(most, "bucket").select("bucket", "node", "root", block.alias("block"), F.explode(met).alias("other"))
    cells = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root")
    held = nodes.select("node", "n_shingles", "registers")
    likely = tables.kept(cells.join(held, "node").groupBy("bucket", "i", "j").applyInArrow(_likely_nodes, "bucket long, i int, j int, block int, node long, root long, own_band int"), "likely-nodes")
    whole = likely.join(held, "node").join(sets, "node")
    return whole.groupBy("bucket", "i", "j").applyInArrow(_cell, "a long, b long").distinct()


class _Cell:
    """The nodes of blocks i and j of a bucket (or of one block, if they are the same), by node number.

    A pair is looked at where all nodes share the first band that it shares, which is one bucket of all that hold it.
    """

    def __init__(self, key: tuple, held: pa.Table, own_band: int | None = None):
        self.held = held.sort_by("node")
        self.node, self.root, self.size, self.block = (self.held[c].to_numpy() for c in ("node", "root", "n_shingles", "block"))
        self.rows = np.frombuffer(b"".join(self.held["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        self.bands = np.ascontiguousarray(self.rows).view(np.uint64)
        self.own_band = int((self.bands == self.bands[0]).all(0).argmax()) if own_band is None else own_band
        self.comp = np.unique(self.root, return_inverse=True)[1]
        i, j = key[1].as_py(), key[2].as_py()
        self.left, self.right, self.crossing = np.flatnonzero(self.block == i), np.flatnonzero(self.block == j), i != j

    def mates(self, k: int) -> np.ndarray:
        """Nodes of other components whose estimate is not a clear miss, those with more equal registers first."""
        m = self.right[(self.comp[self.right] != self.comp[k]) & ((self.right > k) | self.crossing)]
        m = m[100 * np.minimum(self.size[m], self.size[k]) >= PERCENT * np.maximum(self.size[m], self.size[k])]
        m = m[(self.bands[m] == self.bands[k]).argmax(1) == self.own_band]
        share = (self.rows[m] == self.rows[k]).mean(1)
        m, share = m[share >= MAYBE - 0.1], share[share >= MAYBE - 0.1]  # equal registers: near the estimate, and cheap
        if not len(m):
            return m
        near = reaches(np.broadcast_to(self.rows[k], (len(m), REGISTERS)), self.rows[m], np.full(len(m), self.size[k], float), self.size[m].astype(float), MAYBE)
        return m[near][np.argsort(-share[near], kind="stable")]


def _likely_nodes(key: tuple, held: pa.Table) -> pa.Table:
    """The nodes of a cell that have a likely mate in it."""
    cell = _Cell(key, held)
    use = np.zeros(len(cell.node), bool)
    for k in cell.left.tolist():
        mates = cell.mates(k)
        use[mates] = True
        use[k] |= len(mates) > 0
    out = cell.held.select(["bucket", "i", "j", "block", "node", "root"]).filter(pa.array(use))
    return out.append_column("own_band", pa.array(np.full(len(out), cell.own_band, np.int32)))


def _cell(key: tuple, held: pa.Table) -> pa.Table:
    """Verified links of a cell's likely nodes."""
    cell = _Cell(key, held, held["own_band"][0].as_py())
    lists = cell.held["shingles"].combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    shingles = lambda k: flat[ends[k] : ends[k + 1]]
    node, size, comp = cell.node, cell.size, cell.comp
    links: list[tuple[int, int]] = []
    for k in cell.left.tolist():
        for m in cell.mates(k).tolist():
            if comp[m] == comp[k]:
                continue
            common = len(np.intersect1d(shingles(k), shingles(m), assume_unique=True))
            if 100 * common >= PERCENT * (size[k] + size[m] - common):
                links.append((min(node[k], node[m]), max(node[k], node[m])))
                comp[comp == comp[m]] = comp[k]
    return pa.table({c: pa.array([x[side] for x in links], pa.int64()) for side, c in enumerate("ab")})


def near_duplicates(docs: DataFrame, small_bucket: int = SMALL_BUCKET, bucket_block: int = BUCKET_BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A text of fewer than five words is one shingle; a text without
    words (null text too) has none and is linked with nothing.  component_id is the smallest doc_id reachable over links of
    similarity 0.75 and more (the row's own without links), kept whether it is the row's doc_id.  Exactly repeated rows share
    their answer, and all of them are kept or none; a null doc_id stands below no other id and its row is kept only if the
    whole group has none (component_id is null then).  Other columns are not read.  small_bucket and bucket_block shape the
    work, not the rows.
    """
    return _grouped(docs, small_bucket, bucket_block).drop("text_hash")


def _grouped(docs: DataFrame, small_bucket: int = SMALL_BUCKET, bucket_block: int = BUCKET_BLOCK) -> DataFrame:
    """``near_duplicates`` with the hash of each row's text.  What it writes on the way is deleted, but for the two tables that
    the result reads."""
    own, work = Tables(docs.sparkSession, "near"), Tables(docs.sparkSession, "near-work")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = own.kept(base.mapInArrow(_sketches, "doc_id long, text_hash long, n_shingles long, mark binary, registers binary").withColumn("row_id", F.monotonically_increasing_id()), "sketches")

    # one node for each set: its row of the least number
    first = F.min(F.struct("row_id", "doc_id", "text_hash"))
    marks = work.kept(rows.where("mark is not null").groupBy("mark").agg(first.alias("first"), F.min("doc_id").alias("least_doc")).select("mark", F.col("first.row_id").alias("node"), F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "least_doc"), "marks")
    nodes = work.kept(rows.join(marks.select(F.col("node").alias("row_id")), "row_id", "left_semi").select(F.col("row_id").alias("node"), "n_shingles", "registers"), "nodes")

    buckets = nodes.select("node", "registers").mapInArrow(_bands, "bucket long, node long")
    ends = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.count("*").alias("size")).where("size > 1")
    shared = work.kept(buckets.join(ends, "bucket"), "buckets")
    crowd = shared.groupBy("node").agg(F.sum("size").alias("crowd"))
    hubs = shared.select("bucket", "node").join(crowd, "node").groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("crowd"), "node")).alias("hub"))
    stars = [x.where(f"node <> {end}").select(F.least("node", end).alias("a"), F.greatest("node", end).alias("b")).distinct() for end, x in (("low", shared), ("hub", shared.join(hubs, "bucket")))]
    likely = work.kept(_likely_pairs(reduce(DataFrame.union, stars).distinct(), nodes), "likely")

    sets = work.kept(_sets(base, marks, shared.select("node").distinct()), "sets")
    labels = components(work.kept(_verified(likely, sets), "links"), work)

    members = work.kept(_split_buckets(shared, labels, work), "members")
    pairs = _likely_pairs(_crossing_pairs(members, small_bucket).join(likely, ["a", "b"], "left_anti"), nodes)
    more = work.kept(_verified(pairs, sets).union(_crossing_links(members, nodes, sets, work, small_bucket, bucket_block)), "links")
    labels = components(more, work, labels)

    group = marks.select("mark", "node", "least_doc").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = work.kept(group.groupBy("root").agg(F.min("least_doc").alias("component_id")), "least")  # a table, so that the join below can split a large component
    by_mark = own.kept(group.join(least, "root").select("mark", "component_id"), "answers")
    work.drop()
    out = rows.select("doc_id", "text_hash", "n_shingles", "mark").join(by_mark, "mark", "left")
    component = F.when(F.col("mark").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("doc_id", "text_hash", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sets(base: DataFrame, marks: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles of the wanted nodes, from their texts."""
    own = marks.select("node", F.col("doc_id").alias("own_doc"), F.col("text_hash").alias("own_hash")).join(wanted, "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            found = shingle_sets(texts)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))], names=["node", "shingles"])

    texts = base.join(own, F.col("doc_id").eqNullSafe(F.col("own_doc")) & (F.col("text_hash") == F.col("own_hash"))).select("node", "text")
    return texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def distinct_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group; all columns stay.

    The one that stays has the group's smallest doc_id.  Rows are told apart by doc_id and text, so exactly repeated rows stay
    or go together.
    """
    columns = docs.columns
    gone = _grouped(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["gone_hash"])
    return docs.join(gone, same, "left_anti").select(*columns)
