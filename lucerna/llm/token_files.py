"""Token-id files of independent zstandard frames (operator 3).

A file is one frame per document (its ids, little-endian, with a content
checksum), then a skippable frame with the index (an Arrow stream of doc_id
and n_tokens, itself compressed), then the seek table of the public seekable
format: a skippable frame of (compressed size, size, low half of XXH64) per
frame and a footer with their number. A reader fetches the table and then
only the frames of the documents it wants.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lucerna.llm import bpe, common, vec
from lucerna.llm.tokens import default_path

#: Fixed values of the seekable format: magic numbers and the flag that entries carry checksums.
INDEX_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = np.dtype([("size", "<u4"), ("raw", "<u4"), ("check", "<u4")])
#: UTF-8 bytes of text a file is made of, and bytes a reader fetches at once.
FILE_BYTES = 32 << 20
READ_BYTES = 4 << 20
LEVEL = 3


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """Appends documents and closes with index and seek table. The file appears under its name only when whole."""

    def __init__(self, uri: str, width: int, attempt: str) -> None:
        self.fs, self.path = _filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.tmp = f"{self.path}.{attempt}"
        self.out = self.fs.open_output_stream(self.tmp)
        self.type = np.dtype(f"<u{width}")
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.counts: list[int] = []
        self.ids: list = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        raw = ids.astype(self.type).tobytes()
        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.counts.append(len(ids))
        self.ids.append(doc_id)

    def close(self, id_type: pa.DataType) -> int:
        sink = pa.BufferOutputStream()
        table = pa.table({"doc_id": pa.array(self.ids, id_type), "n_tokens": pa.array(self.counts, pa.int64())}, metadata={"width": str(self.type.itemsize)})
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        index = self.zstd.compress(sink.getvalue().to_pybytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.entries.append((len(index) + 8, 0, 0))
        body = np.array(self.entries, ENTRY).tobytes()
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(body) + FOOTER.size) + body + FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC))
        self.out.close()
        self.fs.move(self.tmp, self.path)
        return sum(self.counts)


class FileReader:
    def __init__(self, uri: str) -> None:
        self.fs, self.path = _filesystem(uri)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        frames, _, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"no seek table: {uri}")
        body = frames * ENTRY.itemsize
        self.entries = np.frombuffer(self.file.read_at(body, size - FOOTER.size - body), ENTRY)
        self.at = np.concatenate([[0], np.cumsum(self.entries["size"].astype(np.int64))])
        self.zstd = zstandard.ZstdDecompressor()
        index = self.file.read_at(int(self.entries["size"][-1]) - 8, int(self.at[-2]) + 8)
        self.index = pa.ipc.open_stream(self.zstd.decompress(index)).read_all()
        self.type = np.dtype(f"<u{int(self.index.schema.metadata[b'width'])}")

    def _ids(self, k: int, frame: bytes) -> np.ndarray:
        raw = self.zstd.decompress(frame) if self.entries["raw"][k] else b""
        if len(raw) != self.entries["raw"][k] or (xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF) != self.entries["check"][k]:
            raise ValueError(f"frame {k} of {self.path} is damaged")
        return np.frombuffer(raw, self.type)

    def read(self, k: int) -> np.ndarray:
        """Ids of the k-th document; only its frame is fetched."""
        return self._ids(k, self.file.read_at(int(self.entries["size"][k]), int(self.at[k])))

    def __iter__(self) -> Iterator[np.ndarray]:
        k, n = 0, len(self.entries) - 1
        while k < n:
            to = max(k + 1, int(np.searchsorted(self.at[: n + 1], self.at[k] + READ_BYTES, side="right")) - 1)
            block = self.file.read_at(int(self.at[to] - self.at[k]), int(self.at[k]))
            for j in range(k, to):
                yield self._ids(j, block[int(self.at[j] - self.at[k]) : int(self.at[j + 1] - self.at[k])])
            k = to


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes whole texts with the tokenizers library, adds `end_id` to each, and writes them in ascending id order.

    Returns one row per file: file (number in order), uri, n_docs, n_tokens.
    Rows with equal ids follow in an order given by their texts; null ids come
    first; a null text is the end id alone; other columns are ignored; an
    empty table gives no file. A task that runs again writes the same file.
    """
    path = path or default_path()
    rows = common.named(docs, doc_id=id_col, text=text_col)
    total = rows.agg(F.sum(common.bytes_of("text") + 16)).first()[0] or 0
    files = max(1, math.ceil(total / file_bytes))
    spread = F.xxhash64("text")  # many rows of one id still go to several files
    ordered = rows.repartitionByRange(files, "doc_id", spread).sortWithinPartitions("doc_id", spread)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["doc_id"].dataType)

    def run(batches):
        encoder = bpe.library_encoder(path) if bpe.splits_by_pretoken(path) else None
        task = TaskContext.get()
        number = task.partitionId()
        uri = f"{folder}/tokens-{number:06d}.zst"
        width = 2 if max(bpe.description(path)["model"]["vocab"].values()) < 65_000 and end_id < 65_536 else 4
        out = None
        for part, data, offsets in vec.text_slices(batches):
            out = out or FileWriter(uri, width, f"tmp{task.taskAttemptId()}")
            if encoder:
                ids, first = encoder.encode(data, offsets)
            else:
                got = bpe.library_words(path)(vec.text_array(part.column("text")).to_pylist())
                first = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
                ids = np.fromiter((t for x in got for t in x), np.int32, int(first[-1]))
            for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                out.add(doc_id, np.append(ids[first[k] : first[k + 1]], end_id))
        if out is not None:
            n_docs, n_tokens = len(out.ids), out.close(id_type)
            yield pa.RecordBatch.from_pydict({"file": [number], "uri": [uri], "n_docs": [n_docs], "n_tokens": [n_tokens]}, pa.schema([("file", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return common.stored(ordered.mapInArrow(run, "file long, uri string, n_docs long, n_tokens long"), "token-files")


def read_tokens(files: DataFrame, id_type: str = "bigint", ids: bool = False) -> DataFrame:
    """One row per document of the files, in their order: doc_id, start (ids before it), n_tokens, ids_crc32; with `ids` the ids too."""
    base = F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    # one small row per file; each becomes a task of its own
    listed = files.select("file", "uri", F.coalesce(base, F.lit(0)).alias("base"))
    n = max(1, files.count())
    listed = listed.repartition(n, "file")

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
                reader = FileReader(uri)
                counts = reader.index.column("n_tokens").to_numpy()
                start = base + np.cumsum(counts) - counts
                crc, kept, at = [], [], 0
                for k, values in enumerate(reader):
                    crc.append(zlib.crc32(values.astype("<u4").tobytes()))
                    if ids:
                        kept.append(values.astype(np.int64))
                    if ids and len(crc) - at >= 512 or k + 1 == len(counts):
                        columns = [reader.index.column("doc_id").slice(at, k + 1 - at).combine_chunks(), pa.array(start[at : k + 1], pa.int64()), pa.array(counts[at : k + 1], pa.int64()), pa.array(crc[at:], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if ids:
                            columns.append(pa.array(kept, pa.list_(pa.int64())))
                            names.append("ids")
                            kept = []
                        yield pa.RecordBatch.from_arrays(columns, names)
                        at = k + 1

    return listed.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * ids)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_tokens(common.table(spark, sf_dir, "documents"), common.scratch(spark, "tokens"))
    return read_tokens(files)
