"""Streams over files in the shared folder, and work that resumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions import payloads, sequence
from panelyard.operators import scans, strata
from panelyard.plans.registry import query, table
from panelyard.sources.folders import new_folder
from panelyard.streaming import messages, tables


def _streamed(spark: SparkSession, df: DataFrame, name: str, files: int = 3) -> tuple[DataFrame, str]:
    """A stream over a table's rows, a file at a time, and a folder for what comes of it."""
    source = new_folder(spark, name)
    df.repartition(files).write.parquet(source)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source), f"{source}-out"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of the conversations, numbered in order from 1: a turn that stands on several rows has a number for each."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return scans.scanned(turns, ["conv_id"], ["turn", "role", "text"], sums={"seq": F.lit(1).cast("long")})


@query("""
with c as (select conv_id, turn, role, text from conversations)
select conv_id::varchar as message_id, sha256(coalesce(string_agg(text, '' order by turn, role, text), '')) as content_sha256, 'stop' as finish_reason, if(conv_id % 9 = 4, 'error', 'completed') as status from c group by conv_id
""")
def streamed_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of messages that arrive file by file in any order, folded with state; some messages hold an error event."""
    turns, k = _turns(spark, sf_dir), F.col("conv_id")
    parts = turns.select(k.cast("string").alias("message_id"), "seq", F.to_json(F.struct(F.col("text").alias("content"))).alias("data"))
    ends = F.array_compact(F.array(F.struct(F.lit(1_000_000).cast("long").alias("seq"), F.lit('{"finish_reason": "stop"}').alias("data")), F.when(k % 9 == 4, F.struct(F.lit(1_000_001).cast("long").alias("seq"), F.lit('{"error": 1}').alias("data")))))
    tails = turns.select("conv_id").distinct().select(k.cast("string").alias("message_id"), F.explode(ends).alias("e")).select("message_id", "e.seq", "e.data")
    source = new_folder(spark, "deltas")
    rows = parts.unionByName(tails)
    rows.repartition(3).write.parquet(source)
    done = turns.select("conv_id").distinct().select(k.cast("string").alias("message_id"), F.lit(2_000_000).cast("long").alias("seq"), F.lit(messages.DONE).alias("data"))
    stream = spark.readStream.schema(rows.schema).parquet(source)
    target = f"{source}-out"
    for more in (None, done):  # the terminal marks come last, in a run that goes on from the first one's state
        if more is not None:
            more.coalesce(1).write.mode("append").parquet(source)
        run = messages.fold_stream(stream, timeout=None).writeStream.foreachBatch(lambda batch, epoch: batch.write.mode("append").parquet(target)).outputMode("append").option("checkpointLocation", f"{source}-log").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(target).select("message_id", F.sha2("content", 256).alias("content_sha256"), "finish_reason", "status")


@query("""
with t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as seq from conversations),
d as (select conv_id, 0 as place, 'note' as type, string_agg(text, '' order by seq) as text, max(seq) as id from t group by conv_id
      union all select conv_id, 1, role, string_agg(substr(text, 1, 1), '' order by seq), null from t where role is not null group by conv_id, role)
select conv_id::varchar as message_id, place, type, sha256(coalesce(text, '')) as text_sha256, id::bigint as id, 'completed' as status from d
""")
def assembled_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning details that come in parts: a note that every delta goes on with, and one detail for each role."""
    turns, k = _turns(spark, sf_dir), F.col("conv_id").cast("string").alias("message_id")
    note = F.struct(F.lit(0).alias("index"), F.lit("note").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.col("seq").alias("id"))
    own = F.when(F.col("role").isNotNull(), F.struct(F.lit(1).alias("index"), F.col("role").alias("type"), F.substring(F.coalesce("text", F.lit("")), 1, 1).alias("text"), F.lit(None).cast("long").alias("id")))
    deltas = turns.select(k, "seq", F.to_json(F.struct(F.array_compact(F.array(note, own)).alias("reasoning_details"))).alias("data"))
    ends = turns.groupBy("conv_id").agg(F.max("seq").alias("n"))
    last = ends.select(k, F.explode(F.array(F.struct((F.col("n") + 1).alias("seq"), F.lit('{"finish_reason": "stop"}').alias("data")), F.struct((F.col("n") + 2).alias("seq"), F.lit(messages.DONE).alias("data")))).alias("e")).select("message_id", "e.seq", "e.data")
    details = F.from_json("details", "array<struct<index: int, type: string, text: string, id: long>>")
    each = messages.assembled(deltas.unionByName(last)).select("message_id", "status", F.explode(details).alias("d"))
    return each.select("message_id", F.col("d.index").alias("place"), "d.type", F.sha2(F.coalesce("d.text", F.lit("")), 256).alias("text_sha256"), "d.id", "status")


@query("""
select event_type, date_trunc('hour', ts) as start, count(*) as n, round(sum(value), 6) as total from events group by 1, 2
""")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by hour of a stream that arrives in three files."""
    stream, target = _streamed(spark, table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "windows")
    counted = tables.windowed_counts(stream, "ts", ["event_type"], "1 hour", "10000 days")
    run = counted.writeStream.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(target)).outputMode("complete").option("checkpointLocation", f"{target}-log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(target).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 6).alias("total"))


@query("""
with r as (select distinct sha256('q' || o_custkey % 500) as digest, o_custkey % 500 as q from orders)
select digest, q, if(q % 3 = 0, 'cached', 'fresh') as answer from r
""")
def resumed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of which a third was answered before; each other one is asked once, however often it stands there."""
    q = F.col("o_custkey") % 500
    requests = table(spark, sf_dir, "orders").select(F.sha2(F.concat(F.lit("q"), q.cast("string")), 256).alias("digest"), q.alias("q"))
    cache = requests.where("q % 3 = 0").distinct().withColumn("answer", F.lit("cached"))
    return tables.resumable(lambda fresh: fresh.withColumn("answer", F.lit("fresh")), requests, cache, "digest")


@query("""
select o_orderkey, case when o_orderpriority like '1%' then strftime(o_orderdate, '%Y-%m-%d') when o_orderkey % 3 = 1 then strftime(least(o_orderdate, timestamp '1995-01-01'), '%Y-%m-%d') end as public_date from orders
""")
def public_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of records that a registry dates itself, and of others by their first release."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    event = lambda kind, date: F.struct(F.lit(kind).alias("kind"), date.alias("date"))
    released = F.when(F.col("o_orderkey") % 3 == 1, F.array(event("released", day), event("revised", F.lit("1900-01-01")), event("released", F.lit("1995-01-01")))).otherwise(F.array(event("revised", day)))
    registry = F.when(F.col("o_orderpriority").startswith("1"), "archive").otherwise("other")
    return table(spark, sf_dir, "orders").select("o_orderkey", payloads.public_date(registry, day, released).alias("public_date"))


@query("select doc_id, translate(sha256(doc_id::varchar), '0123456789abcdef', 'ACGTACGTACGTACGT') as dna from documents")
def rna_as_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as RNA, in lower case and padded, as DNA."""
    rna = F.concat(F.lit(" "), F.lower(F.translate(F.sha2(F.col("doc_id").cast("string"), 256), "0123456789abcdef", "ACGUACGUACGUACGU")), F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", sequence.normal_dna(rna).alias("dna"))


@query("""
select l_returnflag, count(*) as n_panels, count(*) filter (not ok) as n_invalid, round(avg(if(ok, v, 0)), 6) as mean_score from (select l_returnflag, l_suppkey, avg(l_quantity) as v, count(*) % 5 <> 0 as ok from lineitem group by 1, 2) group by 1
""")
def stratum_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("v"), (F.count("*") % 5 != 0).alias("ok"))
    return strata.stratum_means(per, ["l_returnflag"], "v", "ok").withColumn("mean_score", F.round("mean_score", 6))
