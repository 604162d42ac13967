"""Token-id files made of independent zstandard frames.

A file is a run of zstandard frames, then a skippable frame with the directory
(for each frame: first doc_id, documents, ids), then a skippable frame with the
seek table in the public seekable layout (compressed size, plain size and
checksum of each frame, then a footer). A reader takes the tail, and decompresses
only the frames that hold the documents it wants.

A frame's plain bytes: documents and null ids (two unsigned 32-bit integers),
doc_ids (64-bit), lengths (32-bit), then all ids as unsigned 16-bit integers, or
32-bit where the vocabulary needs them (the seek table's directory says which).

Documents are range-partitioned and sorted by (doc_id, hash of the text), so a
doc_id that many rows share can still be split. A task writes one file under a
name of its own and renames it when it is whole; a task that runs again writes
the same bytes. Reading deals out single frames.

Defined results: a null or empty text is one document with the end id alone; null
ids come first; an empty table gives no files and no rows; rows that repeat each
other are written each; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, text_or_empty
from .encode import Encoder

FRAME_BYTES = 1 << 20
#: Fixed values of the public zstandard formats.
SKIPPABLE_DIRECTORY, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENTRY, DIRECTORY, FOOTER = struct.Struct("<III"), struct.Struct("<qIQ"), struct.Struct("<IBI")


def checksum(plain: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


def pack_frame(ids: list[int | None], tokens: list[np.ndarray], wide: bool) -> bytes:
    nulls = sum(i is None for i in ids)
    return b"".join(
        [
            struct.pack("<II", len(ids), nulls),
            np.array([i or 0 for i in ids], dtype="<i8").tobytes(),
            np.array([len(t) for t in tokens], dtype="<u4").tobytes(),
            np.concatenate(tokens).astype("<u4" if wide else "<u2").tobytes(),
        ]
    )


def unpack_frame(plain: bytes, wide: bool) -> tuple[list[int | None], list[np.ndarray]]:
    n, nulls = struct.unpack_from("<II", plain)
    ids = np.frombuffer(plain, "<i8", n, 8).tolist()
    lengths = np.frombuffer(plain, "<u4", n, 8 + 8 * n)
    tokens = np.frombuffer(plain, "<u4" if wide else "<u2", -1, 8 + 12 * n).astype("<u4")
    ends = np.cumsum(lengths.astype(np.int64))
    return [None] * nulls + ids[nulls:], [tokens[e - k : e] for e, k in zip(ends, lengths.tolist(), strict=True)]


class FrameWriter:
    """Writes frames to an open file; ``close`` adds directory and seek table."""

    def __init__(self, out, wide: bool) -> None:
        import zstandard

        self.out, self.wide, self.zstd = out, wide, zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.entries: list[bytes] = []
        self.directory: list[bytes] = []
        self.ids: list[int | None] = []
        self.tokens: list[np.ndarray] = []
        self.held = self.n_docs = self.n_tokens = 0

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.tokens.append(tokens)
        self.held += len(tokens)
        if self.held * (4 if self.wide else 2) >= FRAME_BYTES:
            self.flush()

    def add_all(self, doc_ids: list[int | None], tokens: np.ndarray, ends: np.ndarray) -> None:
        first = 0
        for doc_id, last in zip(doc_ids, ends.tolist(), strict=True):
            self.add(doc_id, tokens[first:last])
            first = last

    def flush(self) -> None:
        if not self.ids:
            return
        plain = pack_frame(self.ids, self.tokens, self.wide)
        frame = self.zstd.compress(plain)
        self.out.write(frame)
        self.entries.append(ENTRY.pack(len(frame), len(plain), checksum(plain)))
        self.directory.append(DIRECTORY.pack(self.ids[0] or 0, len(self.ids), self.held))
        self.n_docs += len(self.ids)
        self.n_tokens += self.held
        self.ids, self.tokens, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        body = struct.pack("<B", self.wide) + b"".join(self.directory)
        self.out.write(struct.pack("<II", SKIPPABLE_DIRECTORY, len(body)) + body)
        table = b"".join(self.entries) + FOOTER.pack(len(self.entries), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def read_tail(file) -> tuple[bool, list[tuple[int, int, int, int, int, int]]]:
    """Width, and (offset, size, checksum, first doc_id, documents, ids) of each frame."""
    end = file.size()
    file.seek(end - FOOTER.size)
    n, _, magic = FOOTER.unpack(file.read(FOOTER.size))
    if magic != SEEK_MAGIC:
        raise ValueError("not a seekable file")
    seek_at = end - FOOTER.size - n * ENTRY.size - 8
    directory_at = seek_at - n * DIRECTORY.size - 1
    file.seek(directory_at)
    tail = file.read(end - directory_at)
    entries = ENTRY.iter_unpack(tail[1 + n * DIRECTORY.size + 8 : -FOOTER.size])
    out, offset = [], 0
    for (size, _, check), (first, docs, tokens) in zip(entries, DIRECTORY.iter_unpack(tail[1 : 1 + n * DIRECTORY.size]), strict=True):
        out.append((offset, size, check, first, docs, tokens))
        offset += size
    return bool(tail[0]), out


def read_frame(file, offset: int, size: int, check: int) -> bytes:
    import zstandard

    file.seek(offset)
    plain = zstandard.ZstdDecompressor().decompress(file.read(size))
    if checksum(plain) != check:
        raise ValueError(f"frame at {offset} is damaged")
    return plain


def write_token_files(docs: DataFrame, root: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Write the files and return (part, path, n_docs, n_tokens), one row a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, out = Encoder(tokenizer), None, None
        wide = encoder.library.get_vocab_size() > 1 << 16
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, folder = open_fs(root)
        path = f"{folder}/part-{part:06d}.zst"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(f"{path}.{attempt}")
                writer = FrameWriter(out, wide)
            rows = batch.column("doc_id").to_pylist()
            for at, ids, ends in encoder.slices(batch.column("text")):
                with_end = np.insert(ids, ends, end_id)
                writer.add_all(rows[at : at + len(ends)], with_end, ends + np.arange(1, len(ends) + 1))
        if writer is not None:
            writer.close()
            out.close()
            fs.move(f"{path}.{attempt}", path)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([writer.n_docs]), pa.array([writer.n_tokens])], names=["part", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = ["doc_id", "order"]
    ordered = rows.withColumn("order", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return cut(ordered.mapInArrow(run, "part int, path string, n_docs long, n_tokens long"))


def list_frames(files: DataFrame, root: str) -> DataFrame:
    """(path, wide, offset, size, check, start) of each frame, from the files' tails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(root)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(path) as file:
                    wide, frames = read_tail(file)
                starts = np.concatenate([[0], np.cumsum([f[5] for f in frames])[:-1]]) + start
                columns = list(zip(*frames, strict=True))
                yield pa.RecordBatch.from_pydict({"path": [path] * len(frames), "wide": [wide] * len(frames), "offset": columns[0], "size": columns[1], "check": columns[2], "start": starts})

    before = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")
    placed = files.select("path", before.alias("start"))
    return placed.mapInArrow(run, "path string, wide boolean, offset long, size long, check long, start long")


def read_token_files(files: DataFrame, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(root)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as file:
                    ids, tokens = unpack_frame(read_frame(file, row["offset"], row["size"], row["check"]), row["wide"])
                lengths = np.array([len(t) for t in tokens], dtype=np.int64)
                starts = np.cumsum(lengths) - lengths + row["start"]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts), pa.array(lengths), pa.array([zlib.crc32(t) for t in tokens], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # rows are tiny but each stands for a frame, so their number of partitions is given and not merged by size
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frames = list_frames(files, root).repartition(n, "path", "offset")
    return frames.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    root = fresh_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, root, tokenizer, end_id), root)
