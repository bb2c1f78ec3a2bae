"""Token-id files: byte planes of fixed-size id blocks, compressed with zstandard, with a chunk index.

A shard file holds ids of documents in ascending id order. Every block of ``BLOCK`` ids is
transposed into its four byte planes; a plane that is zero throughout takes no bytes, the others are
compressed on their own. The footer holds the chunk index (offset, ids and plane lengths of each
block) and the document index (id and number of ids), so any document can be read alone.

    "BPLANE01" | planes of block 0 | planes of block 1 | ... | footer | footer length u64 | "BPLANE01"

A task writes its range of documents to files under a temporary name and renames them, so a
repeated task replaces its own files with equal ones. A file is closed after ``FILE_IDS`` ids.

Defined results: an added token of the tokenizer file inside a text gets its own id, as the library's
``encode`` with ``add_special_tokens=False`` gives it; a null text has only the end id; null ids come first; repeated rows are written
each; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from relaytrail.llm.common import durable_folder, durable_table, out_batches, small_batches
from relaytrail.llm.pieces import PieceEncoder

MAGIC = b"BPLANE01"
BLOCK, FILE_IDS, LEVEL = 1 << 16, 1 << 26, 3
#: Pieces whose tokens are held at a time.
PIECES = 10_000


class PlaneWriter:
    """Writes one file; holds one block and the two indexes (24 bytes a document)."""

    def __init__(self, sink) -> None:
        self.sink, self.held, self.n_held, self.at = sink, [], 0, len(MAGIC)
        self.chunks: list[tuple[int, ...]] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.n_ids = 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            data = np.concatenate(self.held)
            whole = len(data) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(data[i : i + BLOCK])
            self.held, self.n_held = [data[whole:]], len(data) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        packed = [self.pack.compress(p.tobytes()) if p.any() else b"" for p in planes]
        self.chunks.append((self.at, len(ids), *map(len, packed)))
        for p in packed:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        absent = np.array([d is None for d in self.doc_ids], np.uint8)
        arrays = [
            np.array(self.chunks, "<i8").reshape(-1, 6), absent, np.array([d or 0 for d in self.doc_ids], "<i8"), np.array(self.lengths, "<i8"),
        ]
        body = io.BytesIO()
        body.write(json.dumps({"chunks": len(self.chunks), "documents": len(self.doc_ids), "ids": self.n_ids}).encode() + b"\n")
        for a in arrays:
            body.write(a.tobytes())
        footer = self.pack.compress(body.getvalue())
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.sink.close()


class PlaneReader:
    """Reads a file by blocks; ``documents()`` streams (doc_id, ids) in file order."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - 16)
        length, magic = struct.unpack("<Q8s", source.read(16))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(size - 16 - length)
        head, body = zstandard.ZstdDecompressor().decompress(source.read(length)).split(b"\n", 1)
        about = json.loads(head)
        c, d = about["chunks"], about["documents"]
        self.chunks = np.frombuffer(body, "<i8", c * 6).reshape(-1, 6)
        self.absent = np.frombuffer(body, np.uint8, d, c * 48)
        self.doc_ids = np.frombuffer(body, "<i8", d, c * 48 + d)
        self.lengths = np.frombuffer(body, "<i8", d, c * 48 + d * 9)
        self.unpack = zstandard.ZstdDecompressor()

    def block(self, i: int) -> np.ndarray:
        at, n, *sizes = self.chunks[i].tolist()
        planes = np.zeros((4, n), np.uint8)
        self.source.seek(at)
        for p, size in enumerate(sizes):
            if size:
                planes[p] = np.frombuffer(self.unpack.decompress(self.source.read(size)), np.uint8)
        return np.ascontiguousarray(planes.T).view("<u4").ravel()

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        block, at, i = np.empty(0, "<u4"), 0, 0
        for absent, doc_id, n in zip(self.absent.tolist(), self.doc_ids.tolist(), self.lengths.tolist()):
            parts = []
            while n:
                if at == len(block):
                    block, at, i = self.block(i), 0, i + 1
                part = block[at : at + n]
                parts.append(part)
                at, n = at + len(part), n - len(part)
            yield None if absent else doc_id, np.concatenate(parts) if parts else np.empty(0, "<u4")


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def byte_alphabet() -> dict[int, str]:
    """The printable character of each byte: its own in Latin-1, or the next one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class TextEncoder:
    """Texts that hold an added token go to ``encode_whole``, all others to the memo of pieces."""

    def __init__(self, pieces: PieceEncoder, added: list[str], encode_whole: Callable[[str], bytes]) -> None:
        self.pieces, self.added, self.encode_whole = pieces, added, encode_whole

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        whole = [any(a in t for a in self.added) for t in texts]
        plain = iter(self.pieces.encode([t for t, w in zip(texts, whole) if not w]))
        return [self.encode_whole(t) if w else next(plain) for t, w in zip(texts, whole)]


_tokenizers: dict[bytes, TextEncoder] = {}


def text_encoder(tokenizer_file: bytes, pattern: str) -> TextEncoder:
    """The worker's encoder of this tokenizer file, one thread: added tokens in a text get their ids."""
    if tokenizer_file not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_file.decode())

        # pieces in the tokenizer's byte alphabet go straight to its BPE model
        tokenize, letters = tokenizer.model.tokenize, np.array([ord(c) for _, c in sorted(byte_alphabet().items())], "<u4")

        def packed(ids: list[int]) -> bytes:
            return struct.pack(f"<{len(ids)}I", *ids)

        def encode_some(pieces: list[str]) -> list[bytes]:
            raw = [piece.encode() for piece in pieces]
            text = letters[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-32-le")
            found = [tokenize(text[a:b]) for a, b in pairwise(accumulate(map(len, raw), initial=0))]
            ids = packed([t.id for tokens in found for t in tokens])
            return [ids[4 * a : 4 * b] for a, b in pairwise(accumulate(map(len, found), initial=0))]

        def encode_pieces(pieces: list[str]) -> list[bytes]:
            return [ids for at in range(0, len(pieces), PIECES) for ids in encode_some(pieces[at : at + PIECES])]

        def encode_whole(text: str) -> bytes:
            return packed(tokenizer.encode(text, add_special_tokens=False).ids)

        added = [t["content"] for t in json.loads(tokenizer_file)["added_tokens"]]
        _tokenizers.clear()
        _tokenizers[tokenizer_file] = TextEncoder(PieceEncoder(pattern, encode_pieces), added, encode_whole)
    return _tokenizers[tokenizer_file]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write all documents in ascending id order; (file, documents, ids, start) of every file."""
    small_batches(docs.sparkSession, rows=1024)
    with open(tokenizer_path, "rb") as f:
        tokenizer_file = f.read()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_encoder(tokenizer_file, pattern)
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        partition, made, writer, temporary = TaskContext.get().partitionId(), [], None, ""

        def finish() -> None:
            writer.close()
            final = f"{base}/ids-{partition:06d}-{len(made):05d}.bpl"
            system.move(temporary, final)
            made.append((partition, len(made), final.rsplit("/", 1)[1], len(writer.doc_ids), writer.n_ids))

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, packed in zip(batch.column(0).to_pylist(), coder.encode(texts)):
                if writer is None:
                    temporary = f"{base}/_writing-{uuid.uuid4().hex}"
                    writer = PlaneWriter(system.open_output_stream(temporary))
                writer.add(doc_id, np.frombuffer(packed + end, "<u4"))
                if writer.n_ids >= FILE_IDS:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])
        yield from out_batches(made, schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = durable_table(ordered.mapInArrow(run, "part int, number int, file string, documents long, ids long"), "token_files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, read back by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

        def rows():
            for batch in batches:
                for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                    with system.open_input_file(f"{base}/{name}") as source:
                        for doc_id, ids in PlaneReader(source).documents():
                            yield doc_id, start, len(ids), ids.tobytes()
                            start += len(ids)

        yield from out_batches(rows(), schema, size=500)

    # a number, as the rows are too small for the planner to see the files behind them
    tasks = max(1, files.count())
    return files.select("file", "start").repartition(tasks, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_folder(docs: DataFrame) -> str:
    """A new folder for token files beside the shared intermediate tables."""
    folder = durable_folder(docs.sparkSession)
    return f"{folder.rstrip('/')}/token-ids-{uuid.uuid4().hex}"
