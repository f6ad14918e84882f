"""Token-id files: independent zstandard frames, a trailing seek table, a checksum for every frame.

A file of a shard is a row of zstandard frames, each with the little-endian unsigned 32-bit ids of whole consecutive
documents, then one skippable frame that holds the seek table: for each frame its offset, size and crc32 (of its
compressed bytes), for each document its id, frame, first token within the frame and number of tokens; then the table's
own length and crc32 and a mark.  Any zstandard decoder reads the ids in one go; a reader with the table decompresses only
the frames of the documents it is asked for.

Shards are ranges of doc_id (of a text's hash and of the row within equal ids), cut by Spark's range partitioning, and a
shard's file is written in that order under its number: a task that runs again writes the same file again (to a name of its
own, then renamed), so lost executors and repeated tasks leave one whole file.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.llm.segments import Coder
from panelyard.llm.shared import SLICE_BYTES, kept, text_slices
from panelyard.sources.folders import new_folder, opened

END_ID = 2
#: Tokens at which a frame is closed; it ends with a document, so a longer document is a frame of its own.
FRAME_TOKENS = 1 << 17
#: Documents a shard holds, about; with more than MOST_SHARDS shards they grow instead.
SHARD_ROWS, MOST_SHARDS = 8192, 20_000
_SKIPPABLE, _MARK, _TAIL = 0x184D2A5E, b"PYTOKS01", struct.Struct("<QI8s")
_FRAME = np.dtype([("offset", "<u8"), ("size", "<u4"), ("crc32", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("known", "<u4"), ("first", "<u8"), ("n_tokens", "<u8")])


class FileWriter:
    """Writes documents one after the other; ``close`` adds the seek table."""

    def __init__(self, out, level: int = 3):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int, int]] = []
        self.held: list[bytes] = []
        self.tokens = self.offset = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, len(self.frames), doc_id is not None, self.tokens, len(ids) // 4))
        self.held.append(ids)
        self.tokens += len(ids) // 4
        if self.tokens >= FRAME_TOKENS:
            self._frame()

    def _frame(self) -> None:
        if self.held:
            packed = self.pack.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((self.offset, len(packed), zlib.crc32(packed)))
            self.offset += len(packed)
            self.held, self.tokens = [], 0

    def close(self) -> None:
        self._frame()
        table = struct.pack("<QQ", len(self.frames), len(self.docs)) + np.array(self.frames, _FRAME).tobytes() + np.array(self.docs, _DOC).tobytes()
        body = table + _TAIL.pack(len(table), zlib.crc32(table), _MARK)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)


class FileReader:
    """Reads documents by their place in the file, decompressing their frames only."""

    def __init__(self, source):
        self.source, self.held = source, (-1, b"")
        size = source.size()
        length, crc, mark = _TAIL.unpack(source.read_at(_TAIL.size, size - _TAIL.size))
        if mark != _MARK:
            raise ValueError("not a token file")
        table = source.read_at(length, size - _TAIL.size - length)
        if zlib.crc32(table) != crc:
            raise ValueError("the seek table is damaged")
        n_frames, n_docs = struct.unpack_from("<QQ", table)
        self.frames = np.frombuffer(table, _FRAME, n_frames, 16)
        self.docs = np.frombuffer(table, _DOC, n_docs, 16 + n_frames * _FRAME.itemsize)

    def frame(self, k: int) -> bytes:
        offset, size, crc = self.frames[k].tolist()
        packed = self.source.read_at(size, offset)
        if zlib.crc32(packed) != crc:
            raise ValueError(f"frame {k} is damaged")
        return zstandard.ZstdDecompressor().decompress(packed)

    def places(self, doc_id: int) -> range:
        """Where the documents of this id stand; they lie together, in the order of ids after those without one."""
        n = int((~self.docs["known"].astype(bool)).sum())
        ids = self.docs["doc_id"][n:]
        return range(n + int(np.searchsorted(ids, doc_id, side="left")), n + int(np.searchsorted(ids, doc_id, side="right")))

    def read(self, places: Iterator[int] | None = None) -> Iterator[tuple[int, int | None, bytes]]:
        """(place, doc_id, ids) of the documents at these places, or of all; neighbours share a frame's decompression."""
        for place in range(len(self.docs)) if places is None else places:
            doc_id, frame, known, first, n = self.docs[place].tolist()
            if n and frame != self.held[0]:
                self.held = frame, self.frame(frame)
            yield place, doc_id if known else None, self.held[1][4 * first : 4 * (first + n)] if n else b""


@lru_cache(maxsize=2)
def _coder(path: str, plain_controls: bool = False) -> tuple[Coder, object, list[str]]:
    """The tokenizers library's ids for segments; the tokenizer; the control strings that it takes for tokens within a text.

    Segments that begin with a space before a surely visible character are encoded as one text, which the pre-tokenizer cuts
    before each of them; token lengths give the ids back to the segments.  Others are encoded each for itself.  A tokenizer
    of another kind than byte-level BPE with its usual pattern gets whole texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_controls
    controls = [] if plain_controls else [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    made = json.loads(tokenizer.to_str())
    cut = made["pre_tokenizer"] or {}
    whole = bool(made["normalizer"]) or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) != ("ByteLevel", False, True)
    if whole:

        def each(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            found = [x.ids for x in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in found)]), np.array([len(x) for x in found], np.int64)

        return Coder(each, whole=True), tokenizer, []
    length = np.array([len(tokenizer.id_to_token(k) or "") for k in range(tokenizer.get_vocab_size())], np.int64)

    def encode(spellings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = np.fromiter((s[:1] == b" " and len(s) > 1 and (0x21 <= s[1] < 0x7F or s[1] == 0xC3) for s in spellings), bool, len(spellings))
        together, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
        sizes, parts = np.zeros(len(spellings), np.int64), []
        for k in range(0, len(together), 4096):
            own = [spellings[i] for i in together[k : k + 4096].tolist()]
            ids = np.array(tokenizer.encode_batch_fast([b"".join(own).decode()], add_special_tokens=False)[0].ids, np.int64)
            stops = np.searchsorted(np.cumsum(length[ids]), np.cumsum([len(s) for s in own])) + 1
            sizes[together[k : k + 4096]] = np.diff(stops, prepend=0)
            parts.append(ids)
        rest = tokenizer.encode_batch_fast([spellings[i].decode() for i in alone.tolist()], add_special_tokens=False)
        sizes[alone] = [len(x.ids) for x in rest]
        flat = np.concatenate([*parts, *(np.array(x.ids, np.int64) for x in rest), np.zeros(0, np.int64)])
        order = np.argsort(np.concatenate([together, alone]), kind="stable")
        held = sizes[np.concatenate([together, alone])]
        begin = (np.cumsum(held) - held)[order]
        at = np.arange(len(flat)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        return flat[at], sizes

    return Coder(encode), tokenizer, controls


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end: bytes, plain_controls: bool) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and ids, the end id included, of each row."""
    for batch, texts in text_slices(batches, most=4 * SLICE_BYTES):
        coder, tokenizer, controls = _coder(path, plain_controls)
        odd = np.zeros(len(texts), bool)
        for control in controls:
            odd |= pc.match_substring(texts, control).to_numpy(zero_copy_only=False)
        ids, at = coder.code(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        packed = ids.astype("<u4").tobytes()
        for k, (doc_id, a, b) in enumerate(zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)):
            own = np.array(tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes() if odd[k] else packed[4 * a : 4 * b]
            yield doc_id, own + end
    _coder(path, plain_controls)[0].forget()  # the worker may serve other stages next


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, shard_rows: int = SHARD_ROWS, most_shards: int = MOST_SHARDS, plain_controls: bool = False) -> DataFrame:
    """Encodes whole texts and writes them to ``folder``; returns the manifest: shard, file, n_docs, n_tokens, first_id, last_id.

    Each document's ids are followed by ``end_id``.  Null and empty texts have the end id alone.  Documents are in ascending
    doc_id order over all shards, null ids first, equal ids by a hash of their texts; repeated rows are written each, and the
    rows of one id may fill several shards.  A vocabulary's control strings within a text are its tokens, as the library's
    plain call has it; with ``plain_controls`` they are ordinary text.  An empty table writes no file.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = min(most_shards, max(1, -(-base.count() // shard_rows)))
    order = [F.asc_nulls_first("doc_id"), F.asc("text_hash"), F.asc("row_id")]
    dealt = base.withColumns({"text_hash": F.xxhash64("text"), "row_id": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, writer = TaskContext.get().partitionId(), None
        for doc_id, ids in _encoded(batches, path, struct.pack("<I", end_id), plain_controls):
            if writer is None:
                store, at = opened(folder)
                store.create_dir(at, recursive=True)
                name, own = f"shard-{number:08d}.tok.zst", f"{at}/.{uuid.uuid4().hex}"
                out = store.open_output_stream(own, compression=None)
                writer, n_docs, n_tokens, first = FileWriter(out), 0, 0, doc_id
            writer.add(doc_id, ids)
            n_docs, n_tokens, last = n_docs + 1, n_tokens + len(ids) // 4, doc_id
        if writer is not None:
            writer.close()
            out.close()
            store.move(own, f"{at}/{name}")
            row = {"shard": number, "file": f"{folder}/{name}", "n_docs": n_docs, "n_tokens": n_tokens, "first_id": first, "last_id": last}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("file", pa.string()), *((c, pa.int64()) for c in ("n_docs", "n_tokens", "first_id", "last_id"))]))

    return kept(dealt.mapInArrow(write, "shard int, file string, n_docs long, n_tokens long, first_id long, last_id long"), "token-manifest")


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents of the ids in ``wanted`` (doc_id): doc_id, n_tokens, ids.  Only the frames that hold them are decompressed.

    Ids are distinct and not null; one that no file holds gives no row, one that stands on several rows gives each of them.
    The manifest (MOST_SHARDS rows at most) tells which files an id can stand in.
    """
    shards = [r for r in manifest.select("shard", "file", "first_id", "last_id").orderBy("shard").collect() if r.last_id is not None]
    first, last = (np.array([least if r[c] is None else r[c] for r in shards], np.int64) for c, least in (("first_id", -(2**63)), ("last_id", 0)))
    files = [r.file for r in shards]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            a, b = np.searchsorted(last, ids, side="left"), np.searchsorted(first, ids, side="right")  # shards a to b - 1
            size = np.maximum(b - a, 0)
            shard = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([pa.array([files[k] for k in shard.tolist()], pa.string()), pa.array(np.repeat(ids, size))], names=["file", "doc_id"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, source, current = None, None, None
        for batch in batches:
            rows = []
            for file, doc_id in zip(batch.column("file").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                if file != current:
                    if source is not None:
                        source.close()
                    store, at = opened(file)
                    source = store.open_input_file(at)
                    reader, current = FileReader(source), file
                rows += [(doc_id, len(ids) // 4, ids) for _, _, ids in reader.read(iter(reader.places(doc_id)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_tokens", "ids"])
        if source is not None:
            source.close()

    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    dealt = asked.mapInArrow(deal, "file string, doc_id long").repartition("file").sortWithinPartitions("file", "doc_id")
    return dealt.mapInArrow(read, "doc_id long, n_tokens long, ids binary")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """All documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, at = opened(file)
                with store.open_input_file(at) as source:
                    rows, held = [], 0
                    for _, doc_id, ids in FileReader(source).read():
                        rows.append((doc_id, base, len(ids) // 4, zlib.crc32(ids), ids))
                        base, held = base + len(ids) // 4, held + len(ids)
                        if held > 1 << 22:
                            yield _rows(rows)
                            rows, held = [], 0
                    yield _rows(rows)

    return files.select("file", "base").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (*[pa.int64()] * 4, pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Written to the shared folder and read back: doc_id, start, n_tokens, ids_crc32."""
    return read_token_files(write_token_files(docs, path, new_folder(spark, "tokens"))).drop("ids")
