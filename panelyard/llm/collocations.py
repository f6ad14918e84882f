"""Phrase collocations per language: frequent phrases of 2 to 5 words, scored by their weakest cut.

1.  A shard (some megabytes of text) counts its phrases in a trie of limited depth, level by level: a node is its parent and a
    word.  Its levels are serialised in trie order, in blocks.
2.  Blocks are cut at the borders of prefix ranges, and each range is merged from the sorted blocks of all shards; phrases
    below the threshold go.  The borders come from a sample of the blocks' first phrases and only shape the work.
3.  Three such passes: words, pairs of frequent words, phrases of 3 to 5 words all of whose pairs are frequent.  A pass knows the
    frequent phrases of the one before by a bitmap of FILTER_BITS bits, whatever the size of the corpus; a false hit costs
    a node and changes no count.
4.  A walk along the frequent phrases in trie order gives each the counts of its ancestors, which are its left parts (the root's
    count is the number of words).  A suffix link leads from a phrase to itself without its first word, and the links of a
    phrase are its ancestors in the trie of reversed phrases, so the same walk there gives the right parts.  Walks go by ranges,
    to which the ancestors of their first phrase are added.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import Tables, raw, text_slices
from panelyard.llm.words import CLAUSE_ENDS, CLAUSES, words
from panelyard.operators.scans import scanned

LONGEST = 5
LEAST = 100
BEST = 2000
#: Bytes of text in a shard, entries in a block, entries of a prefix range (about), and ranges at most.
SHARD_BYTES, BLOCK_ENTRIES, RANGE_ENTRIES, MOST_RANGES = 8 << 20, 4096, 250_000, 20_000
#: First phrases that are looked at for each border.
SAMPLED = 16
#: Bits of the filter that a pass hands to the next; 8 MB.
FILTER_BITS = 1 << 26
#: Between the words of a phrase's key, below every byte of a word, so that keys sort in trie order.
GAP = b"\x00"
#: Frequent phrases in a range of a walk.
WALK_ROWS = 250_000

_BLOCKS = "lang string, first string, last string, n long, keys binary, counts binary"


def _escaped(words_: pa.BinaryArray) -> pa.BinaryArray:
    """Without GAP within words, in the same order."""
    return pa.array([w.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") for w in words_.to_pylist()], pa.binary())


def _phrase(key: str) -> str:
    return key.replace("\x00", " ").replace("\x01\x01", "\x00").replace("\x01\x02", "\x01")


def _pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ right
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def _word_hashes(langs: list[str], keys: list[bytes]) -> np.ndarray:
    seeds = {lang: xxhash.xxh64_intdigest(lang.encode()) for lang in set(langs)}
    return np.fromiter((xxhash.xxh64_intdigest(k, seeds[lang]) for lang, k in zip(langs, keys, strict=True)), np.uint64, len(keys))


class Filter:
    """Which hashes were set, by their low bits: a set one is always found, another one seldom."""

    def __init__(self, rows: list, bits: int):
        self.bits, self.data = bits, np.zeros(bits // 8, np.uint8)
        for bucket, bitmap in rows:
            self.data[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(bitmap)] = np.frombuffer(bitmap, np.uint8)[: bits // 8]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.data[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


class Level:
    """One level of a shard's trie: nodes in trie order, with their languages, keys and counts; node: of each token, or -1."""

    def __init__(self, key: np.ndarray, at: np.ndarray, n_tokens: int, n_words: int, spelled: pa.BinaryArray, above: Level | None = None):
        if above is None:  # keys are languages times words: few enough to count them in place
            n = np.bincount(key, minlength=1)
            found = np.flatnonzero(n)
            self.counts, own = n[found], (np.cumsum(n > 0) - 1)[key]
        else:
            found, own, self.counts = np.unique(key, return_inverse=True, return_counts=True)
        parent, word = found // max(n_words, 1), found % max(n_words, 1)
        self.node = np.full(n_tokens, -1, np.int64)
        self.node[at] = own
        self.lang = parent if above is None else above.lang[parent]
        last = spelled.take(pa.array(word))
        self.keys = last if above is None else pc.binary_join_element_wise(above.keys.take(pa.array(parent)), last, GAP)

    def blocks(self, langs: list[str]) -> Iterator[tuple]:
        for code in np.unique(self.lang).tolist():
            a, z = np.searchsorted(self.lang, [code, code + 1])
            for k in range(a, z, BLOCK_ENTRIES):
                b = min(k + BLOCK_ENTRIES, z)
                yield block(langs[code], self.keys.slice(k, b - k), self.counts[k:b])


def block(lang: str, keys: pa.BinaryArray, counts: np.ndarray) -> tuple:
    pack = zstandard.ZstdCompressor(level=3)
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(keys)], keys), b"\n")[0].as_py()  # no word holds a line feed
    return lang, keys[0].as_py().decode(), keys[-1].as_py().decode(), len(keys), pack.compress(joined), pack.compress(np.asarray(counts, "<i8").tobytes())


def opened_block(keys: bytes, counts: bytes) -> tuple[list[bytes], np.ndarray]:
    return zstandard.decompress(keys).split(b"\n"), np.frombuffer(zstandard.decompress(counts), "<i8")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StringArray, list[str]]]:
    """Texts of some megabytes together with their languages; a longer text is cut where clauses end."""
    for batch, texts in text_slices(batches, most=SHARD_BYTES):
        langs = batch.column("lang").to_pylist()
        data, _ = raw(texts)
        if len(texts) > 1 or len(data) <= 2 * SHARD_BYTES:
            yield texts, langs
            continue
        at = 0
        while at < len(data):
            stop = min(at + SHARD_BYTES, len(data))
            while stop < len(data) and not (ends := np.flatnonzero(CLAUSE_ENDS[data[stop : stop + SHARD_BYTES]])).size:
                stop = min(stop + SHARD_BYTES, len(data))
            stop = stop + int(ends[0]) if stop < len(data) else stop
            yield pa.array([data[at:stop].tobytes().decode()], pa.string()), langs
            at = stop


def trie(texts: pa.StringArray, langs: list[str], low: int, high: int, pairs: Filter | None, singles: Filter | None) -> Iterator[tuple]:
    """The blocks of levels ``low`` to ``high`` of a shard's trie, and with level 1 its root for each language."""
    found = words(texts, CLAUSES)
    data, _ = raw(texts)
    names, code = np.unique(np.array(langs, object), return_inverse=True)
    names = names.tolist()
    doc = found.doc_of()
    lang, n_tokens = code[doc], len(found.ids)
    clause = np.cumsum(CLAUSE_ENDS[data], dtype=np.int32)[found.starts]
    joined = np.zeros(n_tokens, bool)  # with the next one
    joined[:-1] = (doc[1:] == doc[:-1]) & (clause[1:] == clause[:-1])
    escape = bool((data < 2).any())
    del data, clause, doc
    spelled = _escaped(found.spellings) if escape else found.spellings
    order = pc.sort_indices(spelled).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    spelled, word, n_words = spelled.take(pa.array(order)), rank[found.ids], len(order)
    if low == 1:
        for k, n in enumerate(np.bincount(lang, minlength=len(names)).tolist()):
            yield block(names[k], pa.array([b""], pa.binary()), np.array([n]))
    level = Level(lang * n_words + word, np.arange(n_tokens), n_tokens, n_words, spelled)
    if low == 1:
        yield from level.blocks(names)
    if singles is not None or pairs is not None:
        hashes = _word_hashes([names[k] for k in level.lang.tolist()], level.keys.to_pylist())
        if singles is not None:
            good = singles.holds(hashes)[level.node]
            joined[:-1] &= good[:-1] & good[1:]
        if pairs is not None:
            at = np.flatnonzero(joined)
            joined[at] = pairs.holds(_pair_hash(hashes[level.node[at]], hashes[level.node[at + 1]]))
    reach = np.ones(n_tokens, bool)  # tokens from which a phrase of this length goes
    for size in range(2, high + 1):
        reach[: n_tokens - size + 1] &= joined[size - 2 : n_tokens - 1]
        reach[max(0, n_tokens - size + 1) :] = False
        at = np.flatnonzero(reach)
        level = Level(level.node[at] * n_words + word[at + size - 1], at, n_tokens, n_words, spelled, level)
        if size >= low:
            yield from level.blocks(names)


def _tabled(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=["lang", "first", "last", "n", "keys", "counts"])


def _counted(docs: DataFrame, low: int, high: int, singles: Filter | None, pairs: Filter | None, tables: Tables, least: int) -> DataFrame:
    """lang, key, a of the phrases of ``low`` to ``high`` words that stand ``least`` times, and with words the roots."""
    held = docs.sparkSession.sparkContext.broadcast((singles, pairs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = held.value
        for texts, langs in _shards(batches):
            rows = []
            for row in trie(texts, langs, low, high, two, one):
                rows.append(row)
                if len(rows) == 64:
                    yield _tabled(rows)
                    rows = []
            yield _tabled(rows)

    blocks = tables.kept(docs.mapInArrow(count, _BLOCKS), f"tries-{low}")
    ranges = min(MOST_RANGES, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // RANGE_ENTRIES))
    cuts: list[tuple[bytes, bytes]] = []
    if ranges > 1:
        sample = blocks.select("lang", "first", F.xxhash64("lang", "first", "last", "keys").alias("h")).orderBy("h").limit(SAMPLED * ranges).select("lang", "first").collect()
        firsts = sorted({(r.lang.encode(), r.first.encode()) for r in sample})
        cuts = [firsts[len(firsts) * k // ranges] for k in range(1, ranges)] if len(firsts) >= ranges else firsts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, rows = [], []
            for lang, first, last, n, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "first", "last", "n", "keys", "counts")), strict=True):
                own = lang.encode()
                a, z = bisect_right(cuts, (own, first.encode())), bisect_right(cuts, (own, last.encode()))
                if a == z:
                    where.append(a)
                    rows.append((lang, first, last, n, keys, counts))
                    continue
                names, numbers = opened_block(keys, counts)
                at = [0, *(bisect_left(names, cut) for _, cut in cuts[a:z]), len(names)]
                for k in range(a, z + 1):
                    b, e = at[k - a], at[k - a + 1]
                    if b < e:
                        where.append(k)
                        rows.append(block(lang, pa.array(names[b:e], pa.binary()), numbers[b:e]))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), *_tabled(rows).columns], names=["range", "lang", "first", "last", "n", "keys", "counts"])

    def run(keys: bytes, counts: bytes) -> Iterator[tuple[bytes, int]]:
        names, numbers = opened_block(keys, counts)
        return zip(names, numbers.tolist(), strict=True)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        names, totals, held, total = [], [], None, 0
        for name, n in heapq.merge(*(run(k, c) for k, c in zip(rows["keys"].to_pylist(), rows["counts"].to_pylist(), strict=True))):
            if name == held:
                total += n
                continue
            if held is not None and (total >= least or held == b""):
                names.append(held)
                totals.append(total)
            held, total = name, n
        if held is not None and (total >= least or held == b""):
            names.append(held)
            totals.append(total)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(names), pa.string()), "key": pa.array([n.decode() for n in names], pa.string()), "a": pa.array(totals, pa.int64())})

    dealt = blocks.mapInArrow(deal, f"range long, {_BLOCKS}")
    return tables.kept(dealt.groupBy("lang", "range").applyInArrow(merge, "lang string, key string, a long"), f"frequent-{low}")


def _filter(frequent: DataFrame, pairs: bool, bits: int) -> Filter:
    """The filter of frequent words, or of frequent pairs of words."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys = batch.column("lang").to_pylist(), [k.encode() for k in batch.column("key").to_pylist()]
            if pairs:
                hashes = _pair_hash(*(_word_hashes(langs, [k.split(GAP)[side] for k in keys]) for side in (0, 1)))
            else:
                hashes = _word_hashes(langs, keys)
            yield pa.RecordBatch.from_arrays([pa.array((hashes & np.uint64(bits - 1)).astype(np.int64) + 1)], names=["slot"])

    found = frequent.where("key <> ''").mapInArrow(slots, "slot long")
    rows = found.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap"))
    return Filter([(r.bucket, bytes(r.bitmap)) for r in rows.collect()], bits)  # bits / 8 bytes at most


def _walked(frequent: DataFrame, by: str, out: str, tables: Tables) -> DataFrame:
    """Adds ``out``: the counts of a phrase's ancestors in the trie of the keys ``by``, from the root down."""
    n = max(1, -(-frequent.count() // WALK_ROWS))
    dealt = tables.kept(frequent.repartitionByRange(n, "lang", by).withColumn("part", F.spark_partition_id()).withColumn("carried", F.lit(False)), f"{out}-dealt")
    firsts = dealt.groupBy("part").agg(F.min(F.struct("lang", by)).alias("first")).collect()  # one a range
    wanted = []
    for r in firsts:
        parts = r.first[by].split("\x00")
        wanted += [(r.part, r.first.lang, "\x00".join(parts[:k])) for k in range(len(parts))] if r.first[by] else []
    ends = frequent.sparkSession.createDataFrame(wanted, "part int, end_lang string, end_key string")
    ends = frequent.join(F.broadcast(ends), (F.col("lang") == F.col("end_lang")) & (F.col(by) == F.col("end_key"))).withColumn("carried", F.lit(True))
    fields = frequent.schema.fields

    def walk(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("lang", "ascending"), (by, "ascending")])
        path: list[tuple[str, int]] = []
        above, lang = [], None
        for own, name, a in zip(rows["lang"].to_pylist(), rows[by].to_pylist(), rows["a"].to_pylist(), strict=True):
            if own != lang:
                path, lang = [], own
            while path and path[-1][0] and not name.startswith(path[-1][0] + "\x00"):
                path.pop()
            above.append([n for _, n in path])
            path.append((name, a))
        rows = rows.append_column(out, pa.array(above, pa.list_(pa.int64())))
        return rows.filter(pc.invert(rows["carried"])).select([f.name for f in fields] + [out])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return tables.kept(dealt.unionByName(ends.select(*dealt.columns)).groupBy("part").applyInArrow(walk, f"{shape}, {out} array<long>"), out)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weakest cut of each phrase; whole numbers of any size."""
    for batch in batches:
        rows = []
        for lang, key, a, left, right in zip(*(batch.column(c).to_pylist() for c in ("lang", "key", "a", "left", "right")), strict=True):
            n, k = left[0], len(left)
            score, cut = min((1000 * a * n // (left[j] * right[k - j]), j) for j in range(1, k))
            rows.append((lang, _phrase(key), a, left[cut], right[k - cut], n, score))
        types = (pa.string(), pa.string(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=["lang", "phrase", "a", "l", "r", "n", "score"])


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts split at ``[.,;:!?\\x0A-\\x0D]`` and the pieces into words ``[^\\x20\\x09]+``.  A phrase is 2 to 5
    words within a piece, a how often it stands in its language (``und`` where that is null), n the language's words.  A cut
    gives l and r, the counts of its two parts, and floor(1000 a n / (l r)); the lowest counts, ties to the shortest left part.
    Phrases of at least ``least`` places are candidates; one that stands within a longer candidate as often as that goes.
    The first ``best`` by score, then a, then the phrase's bytes are returned.  Null and empty texts have no words, repeated
    rows count each, an empty table gives no row.  Other columns are not read.  filter_bits shapes the work, not the rows.
    """
    tables = Tables(docs.sparkSession, "collocations")
    base = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    single = _counted(base, 1, 1, None, None, tables, least)
    ones = _filter(single, False, filter_bits)
    double = _counted(base, 2, 2, ones, None, tables, least)
    longer = _counted(base, 3, LONGEST, None, _filter(double, True, filter_bits), tables, least)
    frequent = reduce(DataFrame.union, [single, double, longer]).withColumn("back", F.array_join(F.reverse(F.split("key", "\\x00")), "\x00"))
    walked = _walked(_walked(frequent, "key", "left", tables), "back", "right", tables)
    size = F.size("left")  # the root has none, a word its root, a phrase as many as it has words
    candidates = walked.where(size >= 2)
    parts = F.array(F.expr("substring_index(key, char(0), size(left) - 1)"), F.expr("substring_index(key, char(0), 1 - size(left))"))
    covered = walked.where(size >= 3).select("lang", F.explode(parts).alias("key"), "a").distinct()
    kept = candidates.join(covered, ["lang", "key", "a"], "left_anti")
    scored = kept.select("lang", "key", "a", "left", "right").mapInArrow(_scored, "lang string, phrase string, a long, l long, r long, n long, score long")
    ordered = scored.withColumns({"_score": -F.col("score"), "_a": -F.col("a")})
    ranked = scanned(ordered, ["lang"], ["_score", "_a", "phrase"], sums={"rank": F.lit(1).cast("long")}).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
