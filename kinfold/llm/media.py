"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as an 8-bit greyscale PNG of 64 samples a row.
Tasks write tar shards into the shared folder; a member is named by its payload's
digest and stored once a shard.  Rows carry digest, shard, offset and length.
Metadata columns are filled by range reads of the image header alone; payloads
are read back by the stored range.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.plans.staging import stage, stage_path

UNIT = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk: what a header read fetches.
HEADER = 33
_IDAT_MOST = 1 << 30


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes) -> bytes:
    """The payload, a positive multiple of 64 bytes, as greyscale samples, 64 a row."""
    rows = len(payload) // UNIT
    lines = np.zeros((rows, UNIT + 1), np.uint8)  # each row starts with filter type 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
    packed = zlib.compress(lines.tobytes(), 1)
    body = b"".join(_chunk(b"IDAT", packed[i : i + _IDAT_MOST]) for i in range(0, len(packed), _IDAT_MOST))
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0))
    return SIGNATURE + head + body + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a stored image")
    return struct.unpack(">IIB", head[16:25])


def decode_png(image: bytes) -> bytes:
    """The payload that encode_png() stored, with all checksums verified."""
    width, rows, _ = png_header(image[:HEADER])
    at, parts = HEADER, []
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))) != image[at + 8 + n : at + 12 + n]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("unknown row filter")
    return lines[:, 1:].tobytes()


def pad_text(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and the bytes before that."""
    raw = (text or "").encode()
    return raw + bytes(UNIT - len(raw) if not raw else -len(raw) % UNIT), len(raw)


def sample_features(payload: bytes) -> str:
    """Statistics of the samples: rows, mean, deviation, share of zeros, distinct values, entropy in bits."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts / counts.sum()
    values = np.arange(256)
    mean = float((share * values).sum())
    spread = float(np.sqrt((share * (values - mean) ** 2).sum()))
    some = share[share > 0]
    entropy = max(0.0, float(-(some * np.log2(some)).sum()))
    return (
        f"rows={len(payload) // UNIT};mean={mean:.4f};std={spread:.4f};zeros={share[0]:.6f}"
        f";distinct={len(some)};entropy={entropy:.4f}"
    )


class _ShardWriter:
    """Tar shards of one task, a new one after ``most`` bytes."""

    def __init__(self, base: str, most: int):
        self.fs, self.root = pafs.FileSystem.from_uri(base)
        self.fs.create_dir(self.root, recursive=True)
        self.most, self.count, self.out = most, 0, None

    def add(self, digest: bytes, image: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > self.most:
            self.close()
            # the attempt in the name keeps a rerun task from touching what another wrote
            task = TaskContext.get()
            self.name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}-{self.count:04d}.tar"
            self.out, self.at, self.count = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0, self.count + 1
            self.known: dict[bytes, tuple[str, int, int]] = {}
        if digest not in self.known:
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(image)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + image + bytes(-len(image) % 512))
            self.known[digest] = (self.name, self.at + len(head), len(image))
            self.at += len(head) + len(image) + (-len(image) % 512)
        return self.known[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()


def _writer(base: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _ShardWriter(base, most)
        for batch in batches:
            rows = []
            for text in batch.column("__text"):
                payload, n = pad_text(text.as_py())
                digest = hashlib.sha256(payload).digest()
                known = getattr(shards, "known", {}).get(digest)
                rows.append((n, digest, *(known or shards.add(digest, encode_png(payload)))))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]],
                names=["__id", "n_bytes", "digest", "shard", "offset", "length"],
            )
        shards.close()

    return write


def store_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 256 << 20
) -> tuple[DataFrame, str]:
    """(the index table, the folder's URI).  Index: id, n_bytes, digest, shard, offset, length.

    Every text is written whole; equal texts of a shard share one member.  Defined
    cases: null and empty texts are 64 zero bytes; rows with null or repeated ids
    are stored like others; an empty table gives no shard and an empty index.  Lost
    tasks write new shards under names of their own, and the index, itself a
    table in the shared folder, only names those of tasks that ended.
    """
    base = stage_path(docs.sparkSession, "media")
    base = base if "://" in base else base.replace("file:", "file://", 1) if base.startswith("file:") else f"file://{base}"
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    id_type = slim.schema["__id"].dataType.simpleString()
    index = slim.mapInArrow(
        _writer(base, shard_bytes),
        f"__id {id_type}, n_bytes long, digest binary, shard string, offset long, length long",
    )
    return stage(index, "index").withColumnRenamed("__id", id_col), base


def _ranges(base: str, batch: pa.RecordBatch, length: Callable[[int], int], open_files: dict) -> Iterator[bytes]:
    fs, root = pafs.FileSystem.from_uri(base)
    for shard, offset, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length"))):
        if shard not in open_files:
            for old in open_files.values():
                old.close()
            open_files.clear()
            open_files[shard] = fs.open_input_file(f"{root}/{shard}")
        yield open_files[shard].read_at(length(n), offset)


def _added(df: DataFrame, fill: Callable, columns: str) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(fill, f"{kinds}, {columns}")


def fill_metadata(index: DataFrame, base: str) -> DataFrame:
    """The index with width, height and bits, from reads of 33 bytes a row."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            found = [png_header(head) for head in _ranges(base, batch, lambda n: HEADER, opened)]
            columns = list(zip(*found)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(list(c), pa.int64()) for c in columns]],
                names=[*batch.schema.names, "width", "height", "bits"],
            )

    return _added(index, fill, "width long, height long, bits long")


def read_payloads(index: DataFrame, base: str) -> DataFrame:
    """The index with what the stored bytes give back: sizes, digests and features."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            rows = []
            for image in _ranges(base, batch, lambda n: n, opened):
                payload = decode_png(image)
                rows.append((
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]),
                    len(image), hashlib.sha256(image).hexdigest(), sample_features(payload),
                ))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(list(c), k) for c, k in zip(columns, kinds)]],
                names=[
                    *batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32",
                    "media_bytes", "media_sha256", "feature",
                ],
            )

    return _added(
        index, fill,
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores all texts, then fills metadata and payload columns from what was stored.

    The index is dealt out by place in the shards, so that each task reads on.
    """
    index, base = store_texts(docs, id_col, text_col)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")
    return read_payloads(fill_metadata(dealt, base), base)
