"""A log in the shared folder to which one writer at a time appends: what a table consists of, and how far work has come.

Entry n is the file of that number.  It appears whole, by a rename that fails where the number is taken, so of two writers that
saw the same log one wins and the other has to look again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators import joins
from panelyard.sources.folders import hadoop_path, qualified


class Log:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, qualified(spark, folder)

    def _at(self, name: str):
        return hadoop_path(self.spark, f"{self.folder}/{name}")

    def entries(self) -> list[dict]:
        """All entries in order; an entry for each epoch or step."""
        whole, store = hadoop_path(self.spark, self.folder)
        if not store.exists(whole):
            return []
        names = sorted(s.getPath().getName() for s in store.listStatus(whole) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith("."))
        rows = self.spark.read.text([f"{self.folder}/{n}" for n in names]).select("value").collect() if names else []
        return sorted((json.loads(r.value) for r in rows), key=lambda e: e["version"])

    def append(self, version: int, entry: dict) -> bool:
        """Adds an entry as number ``version``; False if that number is taken."""
        own, store = self._at(f".{uuid.uuid4().hex}")
        target, _ = self._at(f"{version:012d}.json")
        out = store.create(own, True)
        out.write(bytearray(json.dumps(entry | {"version": version}).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.valueOf("NONE")
        try:
            context.rename(own, target, how)
        except Exception as e:
            store.delete(own, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True


class KeyedTable:
    """A table of rows with distinct keys, to which epochs are appended; its log names the files that count.

    Files hold ranges of the keys' hashes, and their entries the range, so an epoch looks for its keys in the files that can hold
    them, and in those only.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], files: int = 8):
        self.spark, self.path, self.key, self.files = spark, qualified(spark, path), key, files
        self.log = Log(spark, f"{path}/_log")

    def rows(self, entries: list[dict] | None = None) -> DataFrame | None:
        """The table as its log has it; None before the first epoch with rows."""
        paths = [f["path"] for e in (self.log.entries() if entries is None else entries) for f in e["files"]]
        return self.spark.read.parquet(*paths) if paths else None

    def holding(self, entries: list[dict], batch: DataFrame) -> list[str]:
        """The files that can hold keys of a batch, by the ranges of their hashes."""
        ranges = [(0, f["low"], f["high"], f["path"]) for e in entries for f in e["files"]]
        if not ranges:
            return []
        files = self.spark.createDataFrame(ranges, "one int, low long, high long, file string")
        hashes = batch.select(F.lit(0).alias("one"), F.xxhash64(*self.key).alias("hash"))
        met = joins.containment_join(hashes, files, ["one"], "hash", None, "low", "high")
        return sorted(r.file for r in met.select("file").distinct().collect())  # files, not keys

    def append(self, batch: DataFrame, epoch: int, writer: str = "stream", on_step: Callable[[str], None] = lambda step: None) -> bool:
        """Appends the rows whose key is new, the first of each; an epoch that its writer has appended already adds nothing (False).

        Files are written first and count once the log names them, so a writer that dies in between leaves files that nobody
        reads; the epoch's next run writes its own.  ``on_step`` is told where it is.
        """
        while True:
            entries = self.log.entries()
            if any((e["writer"], e["epoch"]) == (writer, epoch) for e in entries):
                return False
            on_step("read")
            fresh = batch.dropDuplicates(self.key)
            if paths := self.holding(entries, fresh):
                fresh = fresh.join(self.spark.read.parquet(*paths).select(*self.key), self.key, "left_anti")
            folder = f"{self.path}/epoch={writer}-{epoch}-{uuid.uuid4().hex}"
            hashed = fresh.withColumn("_hash", F.xxhash64(*self.key))
            hashed.repartitionByRange(self.files, "_hash").sortWithinPartitions("_hash").write.parquet(folder)
            on_step("written")
            per = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("_hash").alias("low"), F.max("_hash").alias("high"), F.count("*").alias("n_rows"))
            files = [{"path": qualified(self.spark, r.path), "low": r.low, "high": r.high, "n_rows": r.n_rows} for r in per.collect()]
            if self.log.append(len(entries), {"writer": writer, "epoch": epoch, "files": files}):
                on_step("logged")
                return True


def run_steps(log: Log, steps: list[tuple[str, Callable[[], None]]]) -> list[str]:
    """Work in named steps that survives its driver: a step's start is in the log before it runs, its end after.

    Steps that have ended are not run again; the one that had begun is, so it must bear repetition.  Returns the steps run.  Where
    another driver has gone on in the meantime, an error.
    """
    ran = []
    for name, work in steps:
        entries = log.entries()
        if any(e["step"] == name and e["state"] == "ended" for e in entries):
            continue
        for state in ("started", "ended"):
            if state == "ended":
                work()
                ran.append(name)
            if not log.append(len(entries), {"step": name, "state": state}):
                raise RuntimeError(f"another driver is at work: {name} {state}")
            entries = log.entries()
    return ran
