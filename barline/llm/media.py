"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit greyscale PNG, 64 samples wide, which holds any bytes losslessly and compresses them.
Each task writes shards of its own to the shared folder; a member is named by the SHA-256 of its stored form, and a
payload that a shard already holds isn't stored again. Where several shards hold a payload, all rows of its digest get
the address of one of them, the least by shard and offset, so an address follows from the content; the other members
are spare, which spares shuffling the payloads. A row of the index carries digest, shard, offset and length. A
header-only range read of the first bytes of a member fills the metadata columns; reading a payload fetches all of it,
once for every row.

A task that is run again writes new shards under new names, and only the rows of the attempt that Spark keeps point to
shards, so a lost executor leaves at most shards that no row names.

Defined cases: a null text is the empty payload; payloads are padded with bytes 0 to a positive multiple of 64, so no
image is empty; repeated rows share a member where they share a shard; texts of any length make one member; an empty
table gives an empty index; a null id stays null;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import join_split, shared_folder, table, written
from ._words import slices

WIDTH = 64
#: A shard is closed once it holds so many bytes.
SHARD_BYTES = 256 << 20
#: What a header read fetches: the signature and the header chunk.
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def encode_png(payload: bytes) -> bytes:
    """payload: a positive multiple of WIDTH bytes, one sample each."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    unfiltered = np.zeros((len(rows), WIDTH + 1), np.uint8)
    unfiltered[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(unfiltered.tobytes(), 5)) + chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth of the image that begins with data."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", data[16:25])


def decode_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, parts = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk of an image is damaged")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def store_of(folder: str):
    """pyarrow's file system and path of a folder that Spark may name by another scheme."""
    return fs.FileSystem.from_uri("s3" + folder[3:] if folder.startswith(("s3a://", "s3n://")) else folder)


class Shards:
    """Writes members to tar files below a folder, in any store that pyarrow reaches."""

    def __init__(self, folder: str):
        self.files, self.root = store_of(folder)
        self.files.create_dir(self.root, recursive=True)
        self.out = None

    def put(self, digest: str, data: bytes) -> tuple[str, int]:
        """The shard and the offset in it of a member that holds data."""
        if self.out is not None and self.out.tell() >= SHARD_BYTES:
            self.close()
        if self.out is None:
            self.name, self.members = f"{uuid.uuid4().hex}.tar", {}
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}")
        if digest not in self.members:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
            self.members[digest] = self.out.tell()
            self.out.write(data)
            self.out.write(bytes(-len(data) % tarfile.BLOCKSIZE))
        return self.name, self.members[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def store(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Writes each text of docs to shards in folder; returns the index, itself a table there."""

    def write(batches):
        shards = Shards(f"{folder}/shards")
        try:
            for batch in batches:
                for part in slices(batch):
                    out = []
                    for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                        raw = (text or "").encode()
                        image = encode_png(padded(raw))
                        digest = hashlib.sha256(image).hexdigest()
                        out.append((key, len(raw), digest, *shards.put(digest, image), len(image)))
                    yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "n_bytes", "digest", "shard", "offset", "length"), r, strict=True)) for r in out], INDEX_ARROW)
        finally:
            shards.close()

    rows = written(docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(write, INDEX), folder, "rows")
    one = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset")).alias("_at")).select("digest", "_at.shard", "_at.offset")
    return written(join_split(rows.drop("shard", "offset"), one, "digest", "doc_id").select([f.name for f in rows.schema]), folder, "index")


INDEX_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


class Ranges:
    """Range reads of a folder's shards; keeps the last shard open."""

    def __init__(self, folder: str):
        self.files, self.root = store_of(folder)
        self.name = self.file = None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.files.open_input_file(f"{self.root}/{shard}")
        return self.file.read_at(length, offset)


def fill_metadata(index: DataFrame, folder: str) -> DataFrame:
    """index with width, height, bit_depth and payload_bytes, from the headers alone."""
    added = [("width", pa.int32()), ("height", pa.int32()), ("bit_depth", pa.int32()), ("payload_bytes", pa.int64())]

    def fill(batches):
        ranges = Ranges(f"{folder}/shards")
        for batch in batches:
            heads = [png_header(ranges.read(s, o, min(HEADER_BYTES, n))) for s, o, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True)]
            columns = [[w for w, _, _ in heads], [h for _, h, _ in heads], [d for _, _, d in heads], [w * h for w, h, _ in heads]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, (_, k) in zip(columns, added, strict=True))], [*batch.schema.names, *(n for n, _ in added)])

    return index.mapInArrow(fill, f"{index.schema.simpleString()[7:-1]}, width int, height int, bit_depth int, payload_bytes long")


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and how many of sixteen grey bands hold any."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    mean = float((counts * np.arange(256)).sum() / len(samples))
    spread = float((counts * (np.arange(256) - mean) ** 2).sum() / len(samples)) ** 0.5
    return f"mean={mean:.4f};std={spread:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};bands={int((counts.reshape(16, 16).sum(1) > 0).sum())}"


def read_payloads(described: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes come to, read back: payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches):
        ranges = Ranges(f"{folder}/shards")
        for batch in batches:
            out = []
            for r in batch.select(["doc_id", "n_bytes", "digest", "shard", "offset", "length", "payload_bytes"]).to_pylist():
                data = ranges.read(r["shard"], r["offset"], r["length"])
                payload, found = decode_png(data), hashlib.sha256(data).hexdigest()
                if found != r["digest"] or len(payload) != r["payload_bytes"]:
                    raise ValueError(f"the stored form of document {r['doc_id']} is not what the index says")
                described = (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), found, feature(np.frombuffer(payload, np.uint8)))
                out.append((r["doc_id"], r["n_bytes"], r["payload_bytes"], *described))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return described.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_media_columns(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    index = store(spark, table(spark, sf_dir, "documents"), folder)
    return read_payloads(fill_metadata(index, folder), folder)


QUERIES = {"op1_media_columns": op1_media_columns}
ORACLES: dict[str, str] = {}
