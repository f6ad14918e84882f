"""A Merkle manifest of a dataset: leaves of rows, a tree of three-fold nodes for each source, one over the sources' roots.

Rows are numbered within their source by ranges, and aligned blocks of 3**LEVELS leaves are subtrees of their own.  On the way
up each block becomes its root, block roots are leaves of the next round of blocks, until a source has one node; the roots of
the sources go the same way.  On the way down each block gets the proof of its root from the round above and emits one for each
of its leaves: a fractal traversal keeps, for every band of BAND levels, the existing subtree around the current leaf and the
desired one that comes next, to which each step adds one leaf.  So a block holds a few dozen nodes beside its leaves, whatever
the size of the tree, and no task holds more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.shared import Tables

ARITY = 3
#: Levels of a block's tree, and of one band of its traversal.
LEVELS, BAND = 6, 2
BLOCK = ARITY**LEVELS
#: Rows that one range of the numbering is cut for.
RANGE_ROWS = 200_000


def node(parts: list[str]) -> str:
    """H: lowercase hex sha256 of the parts laid end to end."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves; a lone leaf has none."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Subtree:
    """The nodes of levels ``low`` to ``top`` - 1 over a range of leaves, built by adding one leaf at a time."""

    def __init__(self, low: int, top: int):
        self.low, self.top = low, top
        self.kept: list[list[str]] = [[] for _ in range(top - low)]
        self.open: list[list[str]] = [[] for _ in range(top)]
        self.root: str | None = None

    def add(self, digest: str, level: int = 0) -> None:
        if level == self.top:
            self.root = digest
            return
        if level >= self.low:
            self.kept[level - self.low].append(digest)
        self.open[level].append(digest)
        if len(self.open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        parent = node(self.open[level])
        self.open[level] = []
        self.add(parent, level + 1)

    def finish(self) -> None:
        """No more leaves: runs that are not full become nodes as they are."""
        for level in range(self.top):
            if self.open[level]:
                self._close(level)


def block_root(leaves: list[str], levels: int) -> str:
    tree = Subtree(levels, levels)
    for leaf in leaves:
        tree.add(leaf)
    tree.finish()
    return tree.root


class _Band:
    """One band of the traversal: its existing subtree, and the desired one with the leaf that it takes next."""

    def __init__(self, leaves: list[str], low: int, top: int):
        self.leaves, self.low, self.top, self.width = leaves, low, top, ARITY**top
        self.next, self.end, self.desired = 0, self.width, Subtree(low, top)
        while self.next < min(self.end, len(leaves)):
            self.step()
        self._turn()

    def step(self) -> None:
        """The desired subtree takes one leaf, if one is left of its range."""
        if self.next < min(self.end, len(self.leaves)):
            self.desired.add(self.leaves[self.next])
            self.next += 1

    def _turn(self) -> None:
        self.desired.finish()
        self.existing, self.desired = self.desired, Subtree(self.low, self.top)
        self.end += self.width

    def advance(self, leaf: int) -> None:
        """The traversal comes to ``leaf``."""
        if leaf % self.width == 0:
            self._turn()

    def siblings(self, leaf: int) -> Iterator[tuple[int, list[str]]]:
        for level in range(self.low, self.top):
            here = leaf % self.width // ARITY**level
            run = self.existing.kept[level - self.low][here - here % ARITY : here - here % ARITY + ARITY]
            yield here % ARITY, run[: here % ARITY] + run[here % ARITY + 1 :]


def authentication_paths(leaves: list[str], levels: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf of a block in turn, level by level: its place in its run and the run's others."""
    bands = [_Band(leaves, low, min(low + BAND, levels)) for low in range(0, levels, BAND)]
    for leaf in range(len(leaves)):
        if leaf:
            for band in bands:
                band.advance(leaf)
        yield [x for band in bands for x in band.siblings(leaf)]
        for band in bands:
            band.step()


def packed(path: list[tuple[int, list[str]]]) -> str:
    """A path as text: for each level the place, the number of others, and the others."""
    return "".join(f"{place}{len(others)}{''.join(others)}" for place, others in path)


def unpacked(text: str) -> list[tuple[int, list[str]]]:
    path, at = [], 0
    while at < len(text):
        place, n = int(text[at]), int(text[at + 1])
        path.append((place, [text[k : k + 64] for k in range(at + 2, at + 2 + 64 * n, 64)]))
        at += 2 + 64 * n
    return path


def folded(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its path lead to."""
    for place, others in path:
        leaf = node([*others[:place], leaf, *others[place:]])
    return leaf


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """H of the five values, each ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (c.cast("string") for c in (doc_id, source, lang, n_chars, text))]
    return F.sha2(F.concat(*parts), 256)


def _numbered(df: DataFrame, order: list[str], tables: Tables) -> DataFrame:
    """Adds pos, the place (from 0) within ``tree`` in the order given, and n, the rows of the tree.

    Ranges of (tree, order) number their rows; a tree's rows in the ranges before are added.  ``order`` must be total but for
    equal rows.
    """
    n = max(1, -(-df.count() // RANGE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            more = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(k, k + batch.num_rows))]
            k += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "k"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    by = [F.asc_nulls_first(c) for c in ("tree", *order)]
    dealt = tables.kept(df.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(run, f"{fields}, part int, k long"), "dealt")
    sizes = dealt.groupBy("part", "tree").agg(F.count("*").alias("own"), F.min("k").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("own").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = tables.kept(sizes.select("part", "tree", (before - F.col("first")).alias("shift"), F.sum("own").over(tree).alias("n")), "shifts")
    placed = dealt.join(shifts, ["part", "tree"]).withColumn("pos", F.col("k") + F.col("shift"))
    return tables.kept(placed.drop("part", "k", "shift"), "numbered")


def _block() -> Column:
    return F.expr(f"pos div {BLOCK}").alias("block")


def _block_levels(n: int) -> int:
    return LEVELS if n > BLOCK else height(n)


def _roots(key: tuple, rows: pa.Table) -> pa.Table:
    rows, n = rows.sort_by("pos"), rows["n"][0].as_py()
    root = block_root(rows["digest"].to_pylist(), _block_levels(n))
    return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": [root]})


def _climb(nodes: DataFrame, tables: Tables) -> list[DataFrame]:
    """The nodes and the rounds of block roots above them; the last round has one node for each tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        own = rounds[-1].select("tree", "pos", "n", "digest", _block())
        rounds.append(tables.kept(own.groupBy("tree", "block").applyInArrow(_roots, "tree string, pos long, n long, digest string"), "roots"))
    return rounds


def _paths(rows: pa.Table, upper: pa.Table) -> Iterator[tuple[int, str]]:
    """Each row's place among the sorted rows, with its packed path: the block's part and then the block's own path."""
    above = upper["path"][0].as_py()
    for k, path in enumerate(authentication_paths(rows["digest"].to_pylist(), _block_levels(rows["n"][0].as_py()))):
        yield k, packed(path) + above


def _descend(rounds: list[DataFrame], upper: DataFrame, tables: Tables) -> DataFrame:
    """tree, pos, path, subroot, root of the nodes in all rounds but the first, from those of the last round's."""

    def run(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        paths = [p for _, p in _paths(rows, above)]
        same = {c: pa.array([above[c][0].as_py()] * len(rows), pa.string()) for c in ("subroot", "root")}
        return pa.table({"tree": rows["tree"], "pos": rows["pos"], "path": pa.array(paths, pa.string())} | same)

    for own in reversed(rounds[1:-1]):
        blocks = own.select("tree", "pos", "n", "digest", _block()).groupBy("tree", "block")
        upper = tables.kept(blocks.cogroup(upper.groupBy("tree", "pos")).applyInArrow(run, "tree string, pos long, path string, subroot string, root string"), "paths")
    return upper


_OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
    """The answers of a block of rows."""
    rows = rows.sort_by("pos")
    subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
    told = rows["told"].to_pylist()
    proofs, roots = [], []
    for k, text in _paths(rows, above):
        path = unpacked(text)
        proofs.append(node([x for _, others in path for x in others]))
        roots.append(folded(told[k], path))
    n = len(rows)
    columns = [rows["doc_id"], rows["digest"], [subroot] * n, [root] * n, proofs, roots, [r == root for r in roots]]
    return pa.table(dict(zip(["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"], columns, strict=True)))


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is H of the row's doc_id, source, lang, n_chars and text.  Within a source (null is one of its own, before the
    others) leaves are in the order of doc_id, null ids first, equal ids by their leaves; every three neighbours become their
    H, a last run of fewer too, until one node is left, the subroot.  Subroots in the order of their sources' bytes go the same
    way to the root.  proof_sha256 is H of the siblings on the way from the leaf to the root.  folded_root is recomputed from
    the siblings and the leaf that a tampered row has (its text without line feeds where the crc32 of doc_id is even; rows
    without id or text are not tampered with), verified tells whether it is the root.  Repeated rows are leaves each; an empty
    table gives no row.  Other columns are not read.
    """
    own, work = Tables(docs.sparkSession, "merkle"), Tables(docs.sparkSession, "merkle-work")
    cast = {c: F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("n_chars", "long"), ("text", "string"))}
    base = docs.select(*cast.values())
    columns = [F.col(c) for c in cast]
    odd = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains(F.col("text"), F.lit("\n")), F.lit(False))
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree")
    leaf = leaf_digest(*columns)
    told = F.when(odd, leaf_digest(*columns[:-1], F.replace("text", F.lit("\n"), F.lit("")))).otherwise(leaf)
    hashed = work.kept(base.select(tree, "doc_id", leaf.alias("digest"), told.alias("told")), "leaves")
    leaves = _numbered(hashed, ["doc_id", "digest", "told"], own)

    rounds = _climb(leaves, own)
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest"))
    tops = _climb(_numbered(subroots, ["name"], work), work)
    root = tops[-1].select("tree", "pos", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))

    def above_sources(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n = len(rows)
        return pa.table({"tree": rows["name"], "pos": pa.array([0] * n, pa.int64()), "path": pa.array([p for _, p in _paths(rows, above)], pa.string()), "subroot": rows["digest"], "root": pa.array([above["root"][0].as_py()] * n, pa.string())})

    held = tops[0].select("tree", "pos", "n", "digest", "name", _block()).groupBy("tree", "block")
    upper = held.cogroup(_descend(tops, root, work).groupBy("tree", "pos")).applyInArrow(above_sources, "tree string, pos long, path string, subroot string, root string")
    upper = own.kept(_descend(rounds, own.kept(upper, "sources"), own), "blocks")
    work.drop()
    blocks = leaves.select("tree", "pos", "n", "digest", "doc_id", "told", _block()).groupBy("tree", "block")
    return blocks.cogroup(upper.groupBy("tree", "pos")).applyInArrow(_proofs, _OUT)
