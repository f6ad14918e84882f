"""SimHash groups, the Merkle manifest and collocations against brute force, on odd rows too."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from panelyard.llm import collocations, merkle, simhash
from panelyard.llm.queries import ORACLE, QUERIES
from panelyard.llm.shared import Tables
from tests.parity import SF, duck_rows, spark_rows

WORDS = ["red", "blue", "stone", "river", "of", "the", "a", "walks", "sings", "été", "STRASSE", "x1"]
ODD = [None, "", " ", "a", "\n\n", "The the THE", "é" * 50, "word " * 3000, "a  b\t\tc d　e ×!", "a\x00b \x01 a\x00 \x01\x01 b.\x00", "x" * 6000, "one\ntwo\nthree"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 60))) for _ in range(80)]
    texts += [t + "\n" + rng.choice(WORDS) for t in texts[:30]] + texts[:6] + ODD
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "é", None])) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "the river sings of the stone", "en", "lone"), (-7, "a\nb", "en", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    names = ["node", "root", "mask", "key", "low", "size", "tree", "pos", "n", "digest", "told", "block", "part", "k", "left", "a", "score", "rank", "phrase"]
    return df.withColumns({c: F.lit("clash") for c in names} | {"n_chars": F.char_length("text").cast("long")})


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("name", ["op12_merkle", "op13_collocations"])
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(ORACLE[name])


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    own = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    """The least member of each member's component."""
    label = list(range(len(prints)))
    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    return label


def expected_groups(found):
    label = linked([p for _, p in found])
    least = {}
    for (doc_id, _), x in zip(found, label, strict=True):
        if doc_id is not None:
            least[x] = min(least.get(x, doc_id), doc_id)
    return sorted(repr((doc_id, f"{p:016x}", least.get(x))) for (doc_id, p), x in zip(found, label, strict=True))


@pytest.mark.parametrize("tree_nodes", [simhash.TREE_NODES, 3])
def test_simhash(spark, docs, tree_nodes):
    found = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    assert rows(simhash.simhash(docs, tree_nodes)) == expected_groups(found)
    assert simhash.simhash(docs.where("false")).count() == 0


def test_simhash_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = [(r.doc_id, fingerprint(r.text)) for r in table.collect()]
    assert rows(QUERIES["op11_simhash"](spark, SF)) == expected_groups(found)
    assert len({r.component_id for r in QUERIES["op11_simhash"](spark, SF).collect()}) < len(found)


def test_fingerprints_add_long_runs():
    text = " ".join(random.Random(3).choices(WORDS, k=2000))
    assert simhash.fingerprints(pa.array([text, "", "a", None and ""], pa.string()).fill_null(""))[0] == fingerprint(text)


@pytest.mark.parametrize("tree_nodes", [8, 64])
def test_crowded_shards_lose_no_link(spark, tmp_path, tree_nodes):
    """Dense groups, chains and strays that agree on most of their bits: shards are dealt again and again."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base ^ rng.getrandbits(14) for _ in range(150)}  # all within 14 bits
    for _ in range(10):
        at = rng.getrandbits(64)
        for _ in range(8):
            prints.add(at)
            at ^= sum(1 << b for b in rng.sample(range(64), 4))  # a chain
    prints |= {base & ~0xFFFFFFFF | rng.getrandbits(32) for _ in range(100)}
    prints = sorted(prints, key=lambda x: x - (1 << 64) if x >> 63 else x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    table = spark.createDataFrame([(x,) for x in signed], "node long").repartition(3)
    out = {r.node: r.root for r in simhash.components_within(table, Tables(spark, "crowded"), tree_nodes).collect()}
    assert [out.get(x, x) for x in signed] == [signed[k] for k in linked(prints)]


def test_forest_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    shard = np.sort(rng.integers(0, 5, 400))
    prints = np.unique(rng.integers(0, 1 << 12, 4000).astype(np.uint64))[:400]
    rng.shuffle(prints)
    query, row = simhash.Forest(shard[: len(prints)], prints).search(np.arange(len(prints)))
    expected = {(a, b) for a in range(len(prints)) for b in range(len(prints)) if a != b and shard[a] == shard[b] and int(prints[a] ^ prints[b]).bit_count() <= 4}
    assert set(zip(query.tolist(), row.tolist(), strict=True)) == expected


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rise(digests):
    """All levels of a tree."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + 3])) for k in range(0, len(last), 3)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 3 * 3
        out.append((level[run:at], level[at + 1 : run + 3]))
        at //= 3
    return out


def plain_manifest(table):
    leaf = lambda r, text: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r.doc_id, r.source, r.lang, r.n_chars, text)))
    by_source = {}
    for r in table:
        by_source.setdefault((r.source is not None, (r.source or "").encode()), []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    sources = sorted(by_source)
    trees = {s: rise([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources}
    top = rise([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, _, own, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = way(trees[s], at) + way(top, k)
            told = own
            if r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                told = leaf(r, r.text.replace("\n", ""))
            for left, right in path:
                told = sha("".join([*left, told, *right]))
            root = top[-1][0]
            out.append((r.doc_id, own, trees[s][-1][0], root, sha("".join(x for left, right in path for x in left + right)), told, told == root))
    return sorted(map(repr, out))


def test_merkle(spark, docs):
    assert rows(merkle.manifest(docs)) == plain_manifest(docs.collect())
    assert merkle.manifest(docs.where("false")).count() == 0
    one = docs.where("doc_id = 1")
    assert rows(merkle.manifest(one)) == plain_manifest(one.collect())
    assert not docs.join(merkle.manifest(docs).where("not verified"), "doc_id").where("text not like '%\n%'").count()


def test_merkle_over_many_blocks(spark):
    """Sources of several blocks and rounds beside small ones; more sources than a block has leaves."""
    n = merkle.BLOCK * merkle.ARITY + 5
    table = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t\n"), "id").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 2 == 0, F.lit("big")).otherwise(F.concat(F.lit("s"), (F.col("id") % 1800).cast("string"))).alias("source"), F.lit(3).cast("long").alias("n_chars"))
    assert rows(merkle.manifest(table)) == plain_manifest(table.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 80, 81, 82, 243, 244, 500, 729])
def test_traversal_keeps_little(n):
    leaves = [sha(str(k)) for k in range(n)]
    levels = rise(leaves)
    paths = list(merkle.authentication_paths(leaves, merkle.height(n)))
    assert [merkle.folded(leaf, p) for leaf, p in zip(leaves, paths, strict=True)] == [levels[-1][0]] * n
    assert [[(x[:place], x[place:]) for place, x in p] for p in paths] == [way(levels, k) for k in range(n)]
    assert all(merkle.unpacked(merkle.packed(p)) == p for p in paths)
    assert merkle.block_root(leaves, merkle.height(n)) == levels[-1][0]


def plain_collocations(table, least, best):
    f, n = Counter(), Counter()
    for r in table:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r.text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        found = []
        own = {p: a for (g, p), a in f.items() if g == lang and a >= least and len(p) > 1}
        for p, a in own.items():
            if any(own.get(q) == a for q in own if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("least", "best", "bits", "entries"), [(2, 2000, 1 << 26, 250_000), (5, 40, 1 << 15, 40), (1, 300, 1 << 20, 7)])
def test_collocations(spark, docs, monkeypatch, least, best, bits, entries):
    monkeypatch.setattr(collocations, "RANGE_ENTRIES", entries)
    monkeypatch.setattr(collocations, "WALK_ROWS", entries)
    monkeypatch.setattr(collocations, "BLOCK_ENTRIES", min(entries, 4096))
    assert rows(collocations.collocations(docs, least, best, bits)) == plain_collocations(docs.collect(), least, best)
    assert collocations.collocations(docs.where("false"), least, best, bits).count() == 0


def test_long_texts_are_cut_between_clauses(monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_BYTES", 40)
    text = "the red stone, " * 30 + "x" * 200 + " é. " + "a b c\n" * 5
    batch = pa.record_batch([pa.array([text, "short"]), pa.array(["en", "en"])], names=["text", "lang"])
    shards = [t for texts, _ in collocations._shards(iter([batch])) for t in texts.to_pylist()]
    assert "".join(shards) == text + "short" and max(map(len, shards)) < 300
    assert all(s[0] in ".,\n" for s in shards[1:-1])
