"""A Python data source that writes files with a commit: tasks write to a staging folder and tell the driver what they wrote; the
driver moves the files of the attempts that count to their places, lists them in a manifest, and deletes the staging folder.

Files of attempts that failed or ran beside another are in no message, so nothing of them is left, in place or hidden; where the
job fails, nothing is.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from panelyard.functions.parsing import PLAIN_FILE
from panelyard.sources.folders import opened

SUFFIXES = {"gzip": ".gz", "zstd": ".zst"}


@dataclass
class Written(WriterCommitMessage):
    """What one attempt wrote: for each file its place in the staging folder, its name, and its row of the manifest."""

    files: list[tuple[str, str, dict]] = field(default_factory=list)


class _Packed:
    """A packed file that is written line by line; what it holds and what it became are digested on the way."""

    def __init__(self, store, at: str, codec: str):
        self.at, self.out, self.n = at, store.open_output_stream(at, compression=None), 0
        self.content, self.artifact = hashlib.sha256(), hashlib.sha256()
        self.content_bytes = self.artifact_bytes = 0
        self.suffix = SUFFIXES[codec]
        self.pack = zlib.compressobj(6, zlib.DEFLATED, 16 + zlib.MAX_WBITS) if codec == "gzip" else zstandard.ZstdCompressor(level=3).compressobj()

    def add(self, lines: list[str]) -> None:
        content = "".join(line + "\n" for line in lines).encode()
        self.content.update(content)
        self.content_bytes, self.n = self.content_bytes + len(content), self.n + len(lines)
        self._put(self.pack.compress(content))

    def _put(self, packed: bytes) -> None:
        self.artifact.update(packed)
        self.artifact_bytes += len(packed)
        self.out.write(packed)

    def close(self) -> tuple[str, str, dict]:
        """The file is named by its content, so a part that is written again is the same file."""
        self._put(self.pack.flush())
        self.out.close()
        row = {"records": self.n, "content_sha256": self.content.hexdigest(), "content_bytes": self.content_bytes, "artifact_sha256": self.artifact.hexdigest(), "artifact_bytes": self.artifact_bytes}
        return self.at, f"{self.content.hexdigest()}.jsonl{self.suffix}", row


class _CommittingWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.run = options["folder"], options["run"]
        self.codec, self.replace = options.get("codec"), options.get("replace") == "true"

    def _staging(self) -> str:
        return f"{opened(self.folder)[1]}/_staging-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _ = opened(self.folder)
        store.create_dir(self._staging(), recursive=True)
        return Written(list(self._lines(store, iterator) if self.codec else self._files(store, iterator)))

    def _lines(self, store, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, dict]]:
        out = None
        for batch in batches:
            if batch.num_rows:
                out = out or _Packed(store, f"{self._staging()}/{uuid.uuid4().hex}", self.codec)
                out.add(batch.column("line").to_pylist())
        if out:
            yield out.close()

    def _files(self, store, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, dict]]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not PLAIN_FILE.fullmatch(name):
                    raise ValueError(f"not a plain file name: {name!r}")
                packed, at = content.encode(), f"{self._staging()}/{uuid.uuid4().hex}"
                with store.open_output_stream(at, compression=None) as out:
                    out.write(packed)
                yield at, name, {"name": name, "bytes": len(packed), "sha256": hashlib.sha256(packed).hexdigest()}

    def commit(self, messages: list[Written | None]) -> None:
        store, top = opened(self.folder)
        try:
            rows, seen = [], {}
            files = [x for m in messages if m is not None for x in m.files]
            for at, name, row in files:  # all are looked at before the first is moved
                if not self.codec and seen.setdefault(name, row["sha256"]) != row["sha256"]:
                    raise FileExistsError(f"{self.folder}/{name} is written twice")
                if not self.codec and not self.replace and _digest(store, f"{top}/{name}") not in (None, row["sha256"]):
                    raise FileExistsError(f"{self.folder}/{name}")
            for at, name, row in files:
                store.move(at, f"{top}/{name}")
                rows.append({"path": f"{self.folder}/{name}"} | row if self.codec else row)
            store.create_dir(f"{top}/_manifest-{self.run}")
            with store.open_output_stream(f"{top}/_manifest-{self.run}/rows.json", compression=None) as out:
                out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        finally:
            self._clean(store)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(opened(self.folder)[0])

    def _clean(self, store) -> None:
        if store.get_file_info(self._staging()).type.name == "Directory":
            store.delete_dir(self._staging())


def _digest(store, at: str) -> str | None:
    """SHA-256 of a file, None where there is none."""
    if not store.get_file_info(at).is_file:
        return None
    whole = hashlib.sha256()
    with store.open_input_stream(at, compression=None) as source:
        while piece := source.read(1 << 20):
            whole.update(piece)
    return whole.hexdigest()


class CommittedFiles(DataSource):
    """Sink ``committed_files``: packed JSON lines (column line; option codec), or one file for each row of (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _CommittingWriter(dict(self.options))


def write_committed(df: DataFrame, folder: str, manifest: str, **options: str) -> DataFrame:
    """Writes ``df`` through the sink and returns the manifest's rows, of the schema given."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(CommittedFiles)
    df.write.format("committed_files").options(folder=folder, run=run, **options).mode("append").save()
    return spark.read.schema(manifest).json(f"{folder}/_manifest-{run}")
