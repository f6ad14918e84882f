"""Transcript positions, edits on a chunked genome and coordinates through edits, by hand and by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from panelyard.functions import coordinates, sequence
from panelyard.operators import genome

FLIP = str.maketrans("ACGT", "TGCA")


def chunked(spark, contigs, chunk):
    return spark.createDataFrame([(c, k, s[k : k + chunk]) for c, s in contigs.items() for k in range(0, len(s), chunk)], "chrom string, chunk_start long, seq string")


TRANSCRIPTS = "id string, chrom string, strand string, exons array<struct<start: long, stop: long>>, cds_start long, cds_end long"


@pytest.fixture(scope="module")
def contigs():
    rng = random.Random(1)
    return {"chr1": "".join(rng.choices("ACGT", k=200)), "chr2": "".join(rng.choices("ACGT", k=150))}


@pytest.fixture(scope="module")
def transcripts(spark):
    """Coding bases 26 to 30, 51 to 60 and 81 to 84 of chr1 on either strand, one without coding bases, one on chr2."""
    exons = [(21, 30), (51, 60), (81, 95)]
    rows = [("plus.1", "chr1", "+", exons, 25, 84), ("minus.1", "chr1", "-", exons, 25, 84), ("none.1", "chr1", "+", exons, None, None), ("two.1", "chr2", "-", [(11, 140)], 20, 110)]
    return spark.createDataFrame(rows, TRANSCRIPTS)


def test_positions_by_hand(spark, contigs, transcripts):
    """id, coding position, genomic one."""
    cases = [
        ("plus.1", "1", 26), ("plus.1", "5", 30), ("plus.1", "6", 51), ("plus.1", "19", 84), ("plus.1", "-1", 25), ("plus.1", "-5", 21), ("plus.1", "-6", 20), ("plus.1", "5+2", 32), ("plus.1", "6-3", 48), ("plus.1", "-2+1", 25),
        ("plus.1", "*1", 85), ("plus.1", "*11", 95), ("plus.1", "*12", 96), ("plus.1", "16-1", 80), ("plus.1", "20", 85),
        ("minus.1", "1", 84), ("minus.1", "4", 81), ("minus.1", "5", 60), ("minus.1", "14", 51), ("minus.1", "15", 30), ("minus.1", "19", 26), ("minus.1", "-1", 85), ("minus.1", "-11", 95), ("minus.1", "-12", 96), ("minus.1", "4+2", 79),
        ("minus.1", "5-3", 63), ("minus.1", "*1", 25), ("minus.1", "*5", 21), ("minus.1", "*6", 20), ("none.1", "1", 21), ("none.1", "11", 51), ("none.1", "0", None), ("plus.1", "*-1", None), ("nobody", "1", None),
    ]
    rows = [(k, f"{t}(GENE):c.{p}{base}>{alt}", at and (base, alt)) for k, (t, p, at) in enumerate(cases) for base in "ACGT" for alt in "ACGT" if alt != base]
    changes = spark.createDataFrame([(k, text) for k, text, _ in rows], "k int, t string")
    out = {(r.k, r.t): (r.chrom, r.pos, r.ref, r.alt) for r in genome.transcript_alleles(changes, "t", transcripts, chunked(spark, contigs, 7), 7).collect()}
    for k, text, change in rows:
        t, _, at = cases[k]
        ref, alt = (x.translate(FLIP) for x in change) if change and t.startswith("minus") else change or (None, None)
        assert out[k, text] == (("chr1", at, ref, alt) if at and contigs["chr1"][at - 1] == ref else (None,) * 4), (text, at)


def normal(s, pos, ref, alt):
    return sequence.normalise(s, pos, ref, alt)


def test_kinds_of_changes(spark, contigs, transcripts):
    s = contigs["chr1"]
    back = lambda a, z: s[a - 1 : z].translate(FLIP)[::-1]
    cases = {
        "plus.1:c.2_4del": (27, s[26:29], ""), f"plus.1:c.2_4del{s[26:29]}": (27, s[26:29], ""), "plus.1:c.2_3insTT": (28, "", "TT"), "plus.1:c.6dup": (52, "", s[50]), "plus.1:c.2_4delinsGG": (27, s[26:29], "GG"),
        f"plus.1:c.2_4del{s[26:29]}insca": (27, s[26:29], "CA"), "plus.1:c.5+1_6-1del": (31, s[30:50], ""), "plus.1:c.-6_-5del": (20, s[19:21], ""), "plus.1:c.*1_*2dup": (87, "", s[84:86]), "minus.1:c.1_2del": (83, s[82:84], ""),
        f"minus.1:c.1_2del{back(83, 84)}": (83, s[82:84], ""), "minus.1:c.1_2insAC": (84, "", "GT"), "minus.1:c.1_3dup": (82, "", s[81:84]), "minus.1:c.1delinsAAC": (84, s[83], "GTT"), "NC_000001.11:g.10_12del": (10, s[9:12], ""),
        "NC_000001.11:g.10dup": (11, "", s[9]),
        "plus.1:c.2_4insT": None, "plus.1:p.Val5Gly": None, "plus.1:c.2=": None, "plus.1:n.2del": None, "NC_000099.1:g.5del": None, "plus.1:c.500del": None, "plus.1:c.2_4del\n": None, "NC_000001.11:g.*5del": None, f"plus.1:c.1{s[25]}>{s[25]}": None,
        "plus.1:c.2_4delAAAAA": None, "": None, None: None,
    }
    changes = spark.createDataFrame([(t,) for t in cases], "t string")
    out = {r.t: (r.chrom, r.pos, r.ref, r.alt) for r in genome.transcript_alleles(changes, "t", transcripts, chunked(spark, contigs, 13), 13).collect()}
    for text, edit in cases.items():
        assert out[text] == (("chr1", *normal(s, *edit)) if edit else (None,) * 4), text
    assert genome.transcript_alleles(changes.where("false"), "t", transcripts, chunked(spark, contigs, 13), 13).count() == 0


@pytest.mark.parametrize("chunk", [3, 10, 1000])
def test_edits_move_left_over_chunks(spark, chunk):
    """Repeats of one, two and three bases over many chunks, up to the contig's start."""
    rng = random.Random(chunk)
    contigs = {"r1": "A" * 45, "r2": "G" + "CT" * 25 + "AAG" * 12, "r3": "".join(rng.choices("AC", k=60)), "r4": "ACGT"}
    rows = []
    for c, s in contigs.items():
        for _ in range(60):
            pos = rng.randint(1, len(s))
            ref = s[pos - 1 : pos - 1 + rng.randint(0, 5)]
            alt = rng.choice([ref[:1], "", ref + ref, s[pos - 1 : pos + 2], "".join(rng.choices("ACGT", k=rng.randint(0, 4)))])
            if ref != alt:
                rows.append((len(rows), c, pos, ref, alt))
    out = {r.k: (r.pos, r.ref, r.alt) for r in genome.left_aligned(spark.createDataFrame(rows, "k int, chrom string, pos int, ref string, alt string"), ["k"], chunked(spark, contigs, chunk), chunk).collect()}
    for k, c, pos, ref, alt in rows:
        assert out.get(k) == normal(contigs[c], pos, ref, alt), (c, pos, ref, alt)


def through(length, pos, ref, alt):
    """Original position at each edited one, None for new bases."""
    head = 0
    while head < min(len(ref), len(alt)) and ref[head] == alt[head]:
        head += 1
    a, b = ref[head:], alt[head:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    start, both = pos + head, min(len(a), len(b))
    return [*range(1, start + both), *[None] * (len(b) - both), *range(start + len(a), length + 1)]


def test_coordinates_through_edits(spark):
    rng = random.Random(3)
    rows = []
    for k in range(150):
        pos = rng.randint(1, 15)
        ref, alt = ("".join(rng.choices("AC", k=rng.randint(1, 5))) for _ in range(2))
        first = through(20, pos, ref, alt)
        at = rng.randint(1, len(first) - 4)
        ref2, alt2 = ("".join(rng.choices("AC", k=rng.randint(1, 4))) for _ in range(2))
        rows.append((k, pos, ref, alt, at, ref2, alt2, len(first)))
    df = spark.createDataFrame(rows, "k int, pos int, ref string, alt string, at int, ref2 string, alt2 string, n int")
    maps = df.withColumn("m", coordinates.edit_map(F.lit(20), F.col("pos"), F.col("ref"), F.col("alt"))).withColumn("b", coordinates.composed(F.col("m"), coordinates.edit_map(F.col("n"), F.col("at"), F.col("ref2"), F.col("alt2"))))
    places = F.sequence(F.lit(1), F.lit(20))
    out = maps.select("k", F.transform(places, lambda p: coordinates.mapped(F.col("m"), p)).alias("there"), F.transform(places, lambda p: coordinates.mapped(coordinates.turned(F.col("m")), p)).alias("back"), F.transform(places, lambda p: coordinates.mapped(F.col("b"), p)).alias("both"), coordinates.junctions(F.col("m")).alias("j")).collect()
    for r, (_, pos, ref, alt, at, ref2, alt2, n) in zip(sorted(out), rows, strict=True):
        first, second = through(20, pos, ref, alt), through(n, at, ref2, alt2)
        where = lambda line, p: line.index(p) + 1 if p in line else None
        assert r.there == [where(first, p) for p in range(1, 21)]
        assert r.back == [first[p - 1] if p <= n else None for p in range(1, 21)]
        assert r.both == [where(second, q) if (q := where(first, p)) else None for p in range(1, 21)]
        assert [(x.left, x.right) for x in r.j] == [(x, y) for x, y in zip(first, first[1:]) if x and y and y != x + 1]


def test_dna_ends_where_the_text_does(spark):
    df = spark.createDataFrame([("ACGT",), ("ACGT\n",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(sequence.is_dna(F.col("s"))).collect()] == [True, False, False, False]
    assert df.limit(1).select(sequence.hgvs_allele(F.lit("ACGTACGT"), F.lit("c.5del"))).first()[0] is None


def test_pattern_of_changes_is_matched_once(spark):
    texts = ["T1:c.5A>C", "T1.2(G):c.-3_*4delAinsGG", "NC_1:g.1_2insac", "T:c.5+1_6-2dup", "T:c.5delinsT", "T:c.5", "T:c.5insA\n", "T(a\nb):c.7del", "", None, "p.Val5Gly", "\nT:c.5A>C"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(sequence.transcript_parts(F.col("t")).alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_") == 1
    flat = [None if (p := r.p) is None else (p.id, p.kind, tuple(p.first), tuple(p.last), p.type, p.ref, p.alt) for r in df.collect()]
    assert flat == [
        ("T1", "c", (False, 5, 0), (False, 5, 0), ">", "A", "C"),
        ("T1.2", "c", (False, -3, 0), (True, 4, 0), "delins", "A", "GG"),
        ("NC_1", "g", (False, 1, 0), (False, 2, 0), "ins", None, "AC"),
        ("T", "c", (False, 5, 1), (False, 6, -2), "dup", None, None),
        ("T", "c", (False, 5, 0), (False, 5, 0), "delins", None, "T"),
        None, None, ("T", "c", (False, 7, 0), (False, 7, 0), "del", None, None), None, None, None, None,
    ]
