"""Changes told by a transcript as edits of the genome, and edits moved left on a genome that lies in chunks.

No row ever holds a sequence: bases come from chunks of a few thousand by equality joins.
"""

from __future__ import annotations

import os.path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions import sequence
from panelyard.sources import readers
from panelyard.sources.folders import as_table

CHUNK = 10_000


def transcript_index(transcripts: DataFrame) -> DataFrame:
    """Transcripts (id, chrom, strand, exons of 1-based spans, cds_start and cds_end 0-based and half open) with what their own
    positions need: exons in the order of transcription, each with the transcript position that it begins with (first), utr5
    (bases before the coding ones), coding and length (bases), low and high (the span).

    A transcript without coding bases counts from its first base.
    """
    e = F.col("exons")
    size = lambda x: x["stop"] - x["start"] + 1
    total = lambda array, each: F.aggregate(array, F.lit(0).cast("long"), lambda n, x: n + each(x))
    zero, high = F.lit(0).cast("long"), F.array_max(F.transform(e, lambda x: x["stop"]))
    spanned = transcripts.select("id", "chrom", "strand", "exons", F.coalesce("cds_start", high).alias("_a"), F.coalesce("cds_end", high).alias("_z"), F.array_min(F.transform(e, lambda x: x["start"])).alias("low"), high.alias("high"))
    minus, a, z = F.col("strand") == "-", F.col("_a"), F.col("_z")
    ordered = F.when(minus, F.reverse("exons")).otherwise(e)
    first = lambda x, k: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), (total(F.slice(ordered, F.lit(1), k), size) + 1).alias("first"))
    before = F.when(minus, total(e, lambda x: F.greatest(zero, x["stop"] - F.greatest(x["start"] - 1, z)))).otherwise(total(e, lambda x: F.greatest(zero, F.least(x["stop"], a) - x["start"] + 1)))
    coding = total(e, lambda x: F.greatest(zero, F.least(x["stop"], z) - F.greatest(x["start"] - 1, a)))
    return spanned.select("id", "chrom", "strand", F.transform(ordered, first).alias("exons"), F.when(a < z, before).otherwise(zero).alias("utr5"), coding.alias("coding"), total(e, size).alias("length"), "low", "high")


def _located(end: Column) -> Column:
    """The genomic position of one end of a change on a row of the index."""
    n = F.when(end["after_stop"], F.when(end["n"] > 0, F.col("coding") + end["n"])).when(end["n"] > 0, end["n"]).when(end["n"] < 0, end["n"] + 1)
    at, offset = F.col("utr5") + n, end["offset"]
    exon = F.get(F.filter("exons", lambda x: (at >= x["first"]) & (at <= x["first"] + x["stop"] - x["start"])), F.lit(0))
    plus = F.when(at < 1, F.col("low") - 1 + at).when(at > F.col("length"), F.col("high") + at - F.col("length") + offset).otherwise(exon["start"] + at - exon["first"] + offset)
    minus = F.when(at < 1, F.col("high") + 1 - at).when(at > F.col("length"), F.col("low") - (at - F.col("length")) - offset).otherwise(exon["stop"] - (at - exon["first"]) - offset)
    return F.when(F.col("strand") == "+", plus).when(F.col("strand") == "-", minus)


def transcript_alleles(changes: DataFrame, text: str, transcripts: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds chrom, pos, ref, alt: the left-most edit of the genome that a change of a transcript (c.) or contig (g.) stands for.

    Positions count coding bases (c.1 is the first), bases before them (c.-1) and after them (c.*1) along the exons, and
    intronic ones as an offset from an exon's base; outside the transcript they go on along the genome.  Nulls for texts that
    are not such a change, unknown transcripts, spans outside the genome and bases that do not stand there.  chunks: chrom,
    chunk_start, seq as :func:`readers.read_fasta_chunks` gives them; they are read several times.
    """
    dealt = changes.repartition(changes.sparkSession.sparkContext.defaultParallelism)  # a small file is one task, and all that follows too
    rows = as_table(dealt.withColumn("_row", F.monotonically_increasing_id()).withColumn("_p", sequence.transcript_parts(F.col(text))), "changes")
    named = rows.select("_row", "_p").join(transcript_index(transcripts).withColumnRenamed("id", "_id"), F.col("_p.id") == F.col("_id"), "left")
    coding = F.col("_p.kind") == "c"
    first, last = (F.when(coding, _located(F.col(f"_p.{side}"))).when(~F.col(f"_p.{side}.after_stop") & (F.col(f"_p.{side}.offset") == 0), F.col(f"_p.{side}.n")) for side in ("first", "last"))
    chrom = F.when(coding, F.col("chrom")).otherwise(readers.contig_name("_p.id"))
    placed = named.select("_row", chrom.alias("chrom"), (~coding | (F.col("strand") == "+")).alias("forward"), F.least(first, last).alias("low"), F.greatest(first, last).alias("high"), "_p.type", F.col("_p.ref").alias("told"), F.col("_p.alt").alias("new"), (first.isNotNull() & last.isNotNull()).alias("_known"))
    placed = as_table(placed.where(F.col("chrom").isNotNull() & F.col("_known") & (F.col("low") >= 1)).drop("_known"), "placed")

    spans = readers.fetch_intervals(placed.select(F.col("_row").alias("id"), "chrom", (F.col("low") - 1).alias("start"), F.col("high").alias("stop")), chunks, chunk)
    met = placed.join(spans.select(F.col("id").alias("_row"), F.col("seq").alias("span")), "_row")
    turned = lambda c: F.when(F.col("forward"), F.col(c)).otherwise(sequence.reverse_complement(F.col(c)))
    kind = F.col("type")
    pos = F.when(kind == "ins", F.when(F.col("high") == F.col("low") + 1, F.col("high"))).when(kind == "dup", F.when(F.col("forward"), F.col("high") + 1).otherwise(F.col("low"))).otherwise(F.col("low"))
    ref = F.when(kind.isin("ins", "dup"), F.lit("")).otherwise(F.col("span"))
    alt = F.when(kind == "del", F.lit("")).when(kind == "dup", F.col("span")).otherwise(turned("new"))
    edits = met.where(F.col("told").isNull() | (turned("told") == F.col("span"))).select("_row", "chrom", pos.alias("pos"), ref.alias("ref"), alt.alias("alt"))
    fits = F.col("pos").isNotNull() & sequence.is_dna(F.concat("ref", "alt")) & (F.col("ref") != F.col("alt"))
    found = left_aligned(edits.where(fits), ["_row"], chunks, chunk)
    return rows.drop("_p").join(found, "_row", "left").drop("_row")


@F.pandas_udf(T.LongType())
def _steps(seq: pd.Series, upto: pd.Series, bases: pd.Series) -> pd.Series:
    """How far an insertion or deletion of ``bases`` moves left over the first ``upto`` bases of a chunk: as long as the base before
    it is its last one, which then comes first."""

    def one(s: str, n: int, b: str) -> int:
        back = s[:n][::-1]
        return len(os.path.commonprefix([back, b[::-1] * (n // len(b) + 1)]))

    return pd.Series([one(*x) for x in zip(seq, upto, bases, strict=True)], dtype="int64")


def left_aligned(edits: DataFrame, key: list[str], chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edits (``key``, chrom, pos, ref, alt) in their left-most minimal form, anchored on a base where one side would be empty.

    Shared bases go, those at the end first.  What is a pure insertion or deletion then moves left within the chunk that holds
    the base before it; edits that reach their chunk's start go on in the chunk before, in the next round, so there are as
    many rounds as the longest repeat has chunks.  Edits without a base to anchor them on are left out.
    """
    own = "_bases"
    cut = sequence.trimmed_back(F.col("ref"), F.col("alt"))
    plain = edits.select(*key, "chrom", F.col("pos").cast("long").alias("pos"), cut.alias("_c")).select(*key, "chrom", (F.col("pos") + F.col("_c.offset")).alias("pos"), "_c.ref", "_c.alt")
    pure = (F.col("ref") == "") != (F.col("alt") == "")
    plain = as_table(plain.where("ref <> alt").withColumn("_pure", pure), "edits")
    done = [plain.where("not _pure").drop("_pure")]
    deletes = F.col("alt") == ""
    going = plain.where("_pure").select(*key, "chrom", "pos", deletes.alias("_deletes"), F.concat("ref", "alt").alias(own))
    settled = []
    while True:
        at = F.floor((F.col("pos") - 2) / chunk).cast("long") * chunk  # the chunk of the base before
        met = going.withColumn("chunk_start", at).join(chunks, ["chrom", "chunk_start"], "left")
        upto = F.when(F.col("seq").isNull() | (F.col("pos") < 2), 0).otherwise(F.col("pos") - 1 - F.col("chunk_start"))
        stepped = met.withColumn("_n", _steps(F.coalesce("seq", F.lit("")), upto.cast("long"), F.col(own))).withColumn("_on", (F.col("_n") == upto) & (upto > 0) & (F.col("chunk_start") > 0))
        turn = (F.col("_n") % F.char_length(own)).cast("int")
        moved = F.concat(F.expr(f"right({own}, cast(_n % char_length({own}) as int))"), F.substring(own, F.lit(1), F.char_length(own) - turn))
        stepped = as_table(stepped.select(*key, "chrom", (F.col("pos") - F.col("_n")).alias("pos"), "_deletes", moved.alias(own), "_on"), "moved")
        settled.append(stepped.where("not _on").drop("_on"))
        going = stepped.where("_on").drop("_on")
        if going.isEmpty():
            break
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    # the base before, or at a contig's start the one after
    base_at = F.when(F.col("pos") > 1, F.col("pos") - 1).otherwise(F.when(F.col("_deletes"), F.col("pos") + F.char_length(own)).otherwise(F.col("pos")))
    based = every.withColumn("_at", base_at).withColumn("chunk_start", F.floor((F.col("_at") - 1) / chunk).cast("long") * chunk).join(chunks, ["chrom", "chunk_start"])
    base = F.substring("seq", (F.col("_at") - F.col("chunk_start")).cast("int"), F.lit(1))
    with_base = based.withColumn("_b", base).where("_b <> ''")
    join = lambda s: F.when(F.col("pos") > 1, F.concat("_b", s)).otherwise(F.concat(s, F.col("_b")))
    kept, gone = join(F.lit("")), join(F.col(own))
    anchored = with_base.select(*key, "chrom", F.greatest(F.col("pos") - 1, F.lit(1)).alias("pos"), F.when(F.col("_deletes"), gone).otherwise(kept).alias("ref"), F.when(F.col("_deletes"), kept).otherwise(gone).alias("alt"))
    return done[0].unionByName(anchored)
