"""Deterministic JSON lines: canonical records in key order, with the digests of what was written."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.digests import canonical
from panelyard.sources.committed import write_committed


def _finite(value: Column, kind: T.DataType) -> Column | None:
    """Whether all numbers of a value, at any depth, are finite; None where it has no doubles."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(True))
    if isinstance(kind, T.StructType):
        parts = [p for f in kind.fields if (p := _finite(value[f.name], f.dataType)) is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None
    if isinstance(kind, T.ArrayType) and _finite(F.lit(None), kind.elementType) is not None:
        return F.coalesce(F.forall(value, lambda x: _finite(x, kind.elementType)), F.lit(True))
    if isinstance(kind, T.MapType) and _finite(F.lit(None), kind.valueType) is not None:
        return F.coalesce(F.forall(F.map_values(value), lambda x: _finite(x, kind.valueType)), F.lit(True))
    return None


def record_json(df: DataFrame) -> Column:
    """A row of ``df`` as JSON with its null fields, at any depth; a number that isn't finite is an error."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    for field in df.schema.fields:
        finite = _finite(F.col(f"`{field.name}`"), field.dataType)
        if finite is not None:
            text = F.when(finite, text).otherwise(F.raise_error(F.lit(f"not a finite number in {field.name}")).cast("string"))
    return text


def canonical_lines(df: DataFrame, key: str) -> DataFrame:
    """key and line: each row as canonical JSON (sorted keys, compact, nulls as null); NaN and infinities are errors."""
    return df.select(F.col(key).alias("key"), canonical(record_json(df)).alias("line"))


def write_jsonl(df: DataFrame, key: str, folder: str, partition_rows: int = 1_000_000, codec: str = "gzip") -> DataFrame:
    """Writes packed JSON lines in key order; returns path, records, content_sha256, content_bytes, artifact_sha256, artifact_bytes.

    Rows are range-partitioned by key; a part's file is the same whenever it is written (no time stamp in it).  codec: gzip or
    zstd.  Lines go into the packer batch by batch, so a task holds a batch, whatever the part's size.  Files appear when every
    task has ended, and nothing of failed attempts stays; the rows returned are a manifest beside them.
    """
    n = max(1, -(-df.count() // partition_rows))
    ordered = canonical_lines(df, key).repartitionByRange(n, "key").sortWithinPartitions("key", "line").select("line")
    return write_committed(ordered, folder, "path string, records long, content_sha256 string, content_bytes long, artifact_sha256 string, artifact_bytes long", codec=codec)


def set_digest(df: DataFrame, key: str) -> DataFrame:
    """Identity of a set of records: SHA-256 over its records' digests in key order (one row: set_sha256, records).

    Such a digest has one order, so the records' digests, 64 characters each, run through one task, which holds a batch of
    them; :func:`tree_digest` is for sets that are too large for that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, n = hashlib.sha256(), 0
        for batch in batches:
            for d in filter(None, batch.column("d").to_pylist()):
                whole.update(b"\n" * (n > 0) + d.encode())
                n += 1
        yield pa.RecordBatch.from_pylist([{"set_sha256": whole.hexdigest(), "records": n}])

    each = canonical_lines(df, key).select("key", F.sha2("line", 256).alias("d"))
    mark = df.sparkSession.range(1).select(F.lit(None).cast(each.schema["key"].dataType).alias("key"), F.lit(None).cast("string").alias("d"))  # so that no records give a row too
    return each.unionByName(mark).orderBy("key", "d").coalesce(1).mapInArrow(run, "set_sha256 string, records long")


def tree_digest(df: DataFrame, key: str, parts: int = 256) -> DataFrame:
    """Identity of a set of records (one row): SHA-256 over the digests of ``parts`` parts, each over its records' digests in order.

    A record's part is a hash of its key, so the identity depends on the records alone, and a task gathers the digests of one
    part; raise ``parts`` with the table.
    """
    each = canonical_lines(df, key).select(F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(parts)).alias("part"), F.sha2("line", 256).alias("d"))
    whole = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    per = each.groupBy("part").agg(whole("d").alias("d"), F.count("*").alias("n"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: F.concat(x["part"].cast("string"), F.lit(":"), x["d"]))
    return per.agg(F.sha2(F.array_join(named, "\n"), 256).alias("set_sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"))


def write_files(df: DataFrame, folder: str, replace: bool = False) -> DataFrame:
    """One file for each row of (name, content); returns name, bytes, sha256.

    All files appear when every task has ended, or none (:mod:`committed`).  One that is there already with other content is an
    error, or is replaced.
    """
    named = df.select(F.col("name").cast("string").alias("name"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))
    return write_committed(named, folder, "name string, bytes long, sha256 string", replace=str(replace).lower())


def promoted(descriptors: DataFrame, path: str, source: str, target: str) -> DataFrame:
    """Descriptors of a version tree as those of the tree it is promoted to: paths below ``source`` are below ``target``.

    A path outside ``source`` is an error, as it would point back into the old tree.
    """
    below = F.startswith(F.col(path), F.lit(source.rstrip("/") + "/"))
    moved = F.concat(F.lit(target.rstrip("/")), F.substring(F.col(path), F.lit(len(source.rstrip("/")) + 1), F.char_length(path)))
    return descriptors.withColumn(path, F.when(below, moved).otherwise(F.raise_error(F.concat(F.lit("outside the version: "), F.coalesce(F.col(path), F.lit("null")))).cast("string")))


def version_tree(files: DataFrame, version: str) -> DataFrame:
    """The files (family, name, sha256, records) of a version by their place in its tree, and the version's own row: path, sha256,
    records.  Its digest is made from its files' digests and paths in order; rows are files, so one task can gather them."""
    placed = files.select(F.concat_ws("/", F.lit(version), F.col("family"), F.col("name")).alias("path"), "sha256", "records")
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "sha256", "path")))
    root = placed.agg(F.concat_ws("/", F.lit(version), F.lit("version.json")).alias("path"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))
    return placed.unionByName(root)


def write_split(df: DataFrame, by: str, folder: str, run: str | None = None, tasks: int = 1) -> None:
    """One folder for each value of a column, so that readers of one value open its files only.

    ``run`` names an identity column: each part becomes a run of its own (run-value), its origin stays in source_<run>.
    ``tasks`` deals a value's rows over that many tasks, for values that hold a large share of all rows.
    """
    if run:
        df = df.withColumns({f"source_{run}": F.col(run), run: F.concat_ws("-", F.col(run).cast("string"), F.col(by).cast("string"))})
    dealt = df.repartition(by, F.pmod(F.xxhash64(*df.columns), F.lit(tasks))) if tasks > 1 else df.repartition(by)
    dealt.write.mode("overwrite").partitionBy(by).parquet(folder)


def write_csv(df: DataFrame, order: list[str], folder: str) -> None:
    """Quoted CSV with a header in each part, sorted over all parts; quotes within values are doubled, nulls are empty."""
    df.orderBy(*order).write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(folder)
