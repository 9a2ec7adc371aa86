"""Token ids in files of bit or byte planes, and back.

File: magic, chunks, index, length of the index (8 bytes), magic. A chunk holds up to ``block`` ids. Its ids are
transposed: plane k of the byte form has byte k of every id, plane k of the bit form has bit k of every id; each plane is
compressed by itself with zstandard, so the high planes, nearly all zero, cost next to nothing. The index is JSON, also
compressed: per chunk its place, number of ids and plane sizes, and per document its key and number of ids.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import narrow, saved, tokenizer_definition
from proofline.llm.encoding import chunks, encoder

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
FILE_IDS = 1 << 24
END_ID = 0

MANIFEST = "part int, number int, file string, docs long, ids long, bytes long"
MANIFEST_ARROW = pa.schema(
    {"part": pa.int32(), "number": pa.int32(), "file": pa.string(), "docs": pa.int64(), "ids": pa.int64(), "bytes": pa.int64()}
)
ROWS = "doc_id long, part int, number int, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, form: str) -> list[bytes]:
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if form == "byte":
        return [p.tobytes() for p in np.ascontiguousarray(octets.T)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, form: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes]) if n else np.zeros((4, 0), np.uint8)
    if form == "bit" and n:
        bits = np.unpackbits(rows, axis=1, bitorder="little")[:, :n]
        return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").ravel()
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class PlaneWriter:
    """Ids go in document by document; a chunk is written whenever ``block`` ids are there."""

    def __init__(self, stream, block: int, form: str, level: int) -> None:
        self.stream, self.block, self.form = stream, block, form
        self.zip = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.waiting_ids = self.total = 0
        self.place = len(MAGIC)
        self.index = {"form": form, "chunks": [], "keys": [], "sizes": []}
        stream.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.index["keys"].append(key)
        self.index["sizes"].append(len(ids))
        self.waiting.append(ids)
        self.waiting_ids += len(ids)
        self.total += len(ids)
        if self.waiting_ids >= self.block:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block * self.block
            for at in range(0, whole, self.block):
                self._chunk(ids[at : at + self.block])
            self.waiting, self.waiting_ids = [ids[whole:]], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.form)]
        self.index["chunks"].append([self.place, len(ids), [len(p) for p in planes]])
        for p in planes:
            self.stream.write(p)
            self.place += len(p)

    def close(self) -> None:
        if self.waiting_ids:
            self._chunk(np.concatenate(self.waiting))
        index = self.zip.compress(json.dumps(self.index).encode())
        self.stream.write(index + struct.pack("<Q", len(index)) + MAGIC)
        self.place += len(index) + 8 + len(MAGIC)
        self.stream.close()


def read_index(data: bytes) -> dict:
    if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a whole id-plane file")
    (size,) = struct.unpack("<Q", data[-len(MAGIC) - 8 : -len(MAGIC)])
    end = len(data) - len(MAGIC) - 8
    return json.loads(zstandard.ZstdDecompressor().decompress(data[end - size : end]))


def read_ids(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(key, ids) of each document, one chunk in memory at a time besides the document's own ids."""
    index, unzip = read_index(data), zstandard.ZstdDecompressor()

    def blocks():
        for place, n, sizes in index["chunks"]:
            planes = []
            for size in sizes:
                planes.append(unzip.decompress(data[place : place + size]))
                place += size
            yield from_planes(planes, n, index["form"])

    source, rest = blocks(), np.zeros(0, np.uint32)
    for key, size in zip(index["keys"], index["sizes"], strict=True):
        parts, have = [rest], len(rest)
        while have < size:
            parts.append(next(source))
            have += len(parts[-1])
        if len(parts) > 1:
            rest = np.concatenate(parts)
        yield key, rest[:size]
        rest = rest[size:]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, *, keeps_space: bool = True, id_col: str = "doc_id", text_col: str = "text",
    block: int = BLOCK, form: str = "byte", level: int = 3, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Tokenize whole texts, add the end id to each and write them below ``folder`` in ascending id order.

    Null texts count as empty; null ids come first; rows of equal id are kept, in order of their texts. Returns the
    manifest, one row a file. A file counts only once its row is in the manifest, so a lost or repeated task leaves at
    worst an unread file behind.
    """
    definition = tokenizer_definition(tokenizer)
    spark = docs.sparkSession

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, number, writer, name = TaskContext.get().partitionId(), 0, None, ""
        encode = encoder(definition, keeps_space).encode

        def done():
            docs, total = len(writer.index["keys"]), writer.total
            writer.close()
            row = {"part": part, "number": number, "file": name, "docs": docs, "ids": total, "bytes": writer.place}
            return pa.RecordBatch.from_pylist([row], MANIFEST_ARROW)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for row, texts in chunks(batch.column("text")):
                counts, ids = encode(texts)
                ends = np.cumsum(counts)
                for k in range(len(counts)):
                    if writer is None:
                        name = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.ids"
                        writer = PlaneWriter(store.open_output_stream(f"{root}/{name}"), block, form, level)
                    own = np.append(ids[ends[k] - counts[k] : ends[k]], np.uint32(END_ID))
                    writer.add(keys[row + k], own)
                    if writer.total >= file_ids:
                        yield done()
                        writer, number = None, number + 1
        if writer is not None:
            yield done()

    rows = narrow(docs, doc_id=id_col, text=text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    )
    return saved(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files of the manifest: where its ids begin in the whole stream, how many, and their CRC."""

    def read(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, number, name in zip(*(batch.column(c).to_pylist() for c in ("part", "number", "file")), strict=True):
                with store.open_input_stream(f"{root}/{name}") as stream:
                    data = stream.read()
                keys, sizes, sums = [], [], []
                for key, own in read_ids(data):
                    keys.append(key)
                    sizes.append(len(own))
                    sums.append(zlib.crc32(np.ascontiguousarray(own, "<u4").tobytes()))
                sizes = np.array(sizes, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()), pa.array(np.full(len(sizes), part, np.int32)),
                        pa.array(np.full(len(sizes), number, np.int32)), pa.array(np.cumsum(sizes) - sizes),
                        pa.array(sizes), pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "part", "number", "start", "n_tokens", "ids_crc32"],
                )

    files = max(1, manifest.count())
    each = manifest.select("part", "number", "file").repartition(files)
    # One small row a file: the only thing that is put in one order.
    before = manifest.select(
        "part", "number",
        (F.sum("ids").over(Window.orderBy("part", "number")) - F.col("ids")).alias("ids_before"),
    )
    rows = each.mapInArrow(read, ROWS).join(F.broadcast(before) if files <= 100_000 else before, ["part", "number"])
    return rows.select("doc_id", (F.col("start") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")
