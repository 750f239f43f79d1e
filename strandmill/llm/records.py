"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A shard is a file of records in ascending doc_id order. Each is framed as

    length       8 bytes, little-endian
    check        4 bytes, masked CRC-32C of the length
    data         the ids, little-endian, 2 bytes each if the vocabulary allows, else 4
    check        4 bytes, masked CRC-32C of the data

The index beside it has a row of four little-endian 64-bit integers for each record: doc_id, 1 if doc_id is
not null, the record's offset, its number of ids. A manifest names the shards in order. Tasks write to names
of their own, and only shards of the manifest count, so a lost or repeated task leaves no trace in the data.
"""

from __future__ import annotations

import gc
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.bpe import Encoder, byte_alphabet, load
from strandmill.llm.text import tidied
from strandmill.storage import materialize, new_path, plan_bytes

END_ID = 2
SHARD_BYTES = 32 << 20
#: Rows of the manifest in each of its files.
SHARDS_A_FILE = 4096
U32 = np.uint32


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=U32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ U32(0x82F63B78), t >> 1)
    return t.astype(U32)


def _apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, as four tables by byte."""
    return op[0][x & 255] ^ op[1][x >> 8 & 255] ^ op[2][x >> 16 & 255] ^ op[3][x >> 24]


def _operators() -> tuple[list[np.ndarray], np.ndarray]:
    """Maps that move a checksum past 2^k zero bytes, and the tables of eight bytes in a row."""
    table = _byte_table()
    bits = np.array([np.arange(256) << 8 * k for k in range(4)], np.uint64).astype(U32)
    ops = [(bits >> 8) ^ table[bits & 255]]
    for _ in range(39):
        ops.append(_apply(ops[-1], ops[-1]))
    eight = [table]
    for _ in range(7):
        eight.append(_apply(ops[0], eight[-1]))
    return ops, np.array(eight[::-1])


_OPS, _EIGHT = _operators()


def crc32c(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of consecutive slices of ``data`` (bytes). Zeros in front change no raw checksum, so slices are
    padded there to eights; the checksums of eights are then joined in pairs, for all slices at once."""
    lengths = np.asarray(lengths, np.int64)
    counts = -(-lengths // 8)
    pad = 8 * counts - lengths
    out = np.zeros(8 * int(counts.sum()), np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(pad), lengths)] = data
    out = out.reshape(-1, 8)
    crc = np.zeros(len(out), U32)
    for k in range(8):
        crc ^= _EIGHT[k][out[:, k]]
    level = 3
    while len(counts) and counts.max() > 1:
        odd = counts & 1
        even = np.zeros(int((counts + odd).sum()), U32)
        even[np.arange(len(crc)) + np.repeat(np.cumsum(odd), counts)] = crc
        crc = _apply(_OPS[level], even[0::2]) ^ even[1::2]
        counts = (counts + odd) // 2
        level += 1
    full = np.zeros(len(lengths), U32)
    full[counts > 0] = crc
    start = np.full(len(lengths), 0xFFFFFFFF, U32)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        some = (lengths >> k & 1) == 1
        start[some] = _apply(_OPS[k], start[some])
    return full ^ start ^ U32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> U32(15)) | (crc << U32(17))) + U32(0xA282EAD8)


def frame(parts: list[np.ndarray]) -> list[bytes]:
    """Records of id arrays of one type."""
    sizes = np.array([p.nbytes for p in parts], np.int64)
    data = np.concatenate(parts).view(np.uint8) if parts else np.zeros(0, np.uint8)
    heads = sizes.astype("<u8")
    of_length = masked(crc32c(heads.view(np.uint8), np.full(len(parts), 8))).astype("<u4")
    of_data = masked(crc32c(data, sizes)).astype("<u4")
    return [b"".join((h.tobytes(), c.tobytes(), p.tobytes(), d.tobytes())) for h, c, p, d in zip(heads, of_length, parts, of_data, strict=True)]


def unframe(raw: np.ndarray, offsets: np.ndarray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all records, how many each has), with both checksums of every record verified."""
    head = raw[offsets[:, None] + np.arange(12)]
    sizes = np.ascontiguousarray(head[:, :8]).view("<u8")[:, 0].astype(np.int64)
    ends = np.cumsum(sizes)
    data = raw[np.repeat(offsets + 12 - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
    tail = raw[(offsets + 12 + sizes)[:, None] + np.arange(4)]
    good = np.ascontiguousarray(head[:, 8:]).view("<u4")[:, 0] == masked(crc32c(head[:, :8].ravel(), np.full(len(offsets), 8)))
    good &= np.ascontiguousarray(tail).view("<u4")[:, 0] == masked(crc32c(data, sizes))
    if not good.all():
        raise ValueError(f"{(~good).sum()} records are damaged")
    return data.view(dtype), sizes // np.dtype(dtype).itemsize


def library_encoder(path: str) -> Encoder:
    """Each distinct piece is encoded by the tokenizers library's model, once while it is remembered.

    The model takes a piece as the library's byte-level step hands it over: each byte as its printable stand-in.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenize = Tokenizer.from_file(path).model.tokenize
    shown = {b: c for c, b in byte_alphabet().items()}

    def one(piece: str) -> bytes:
        return array("I", [t.id for t in tokenize(piece.encode().decode("latin-1").translate(shown))]).tobytes()

    return Encoder(load(path), one)


_ENCODERS: dict[str, Encoder] = {}


def id_type(path: str) -> str:
    return "<u2" if len(load(path).bytes) <= 1 << 16 else "<u4"


@tidied
def _write(batches: Iterator[pa.RecordBatch], path: str, folder: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, library_encoder(path))
    gc.disable()  # what is remembered has no cycles, and would be searched for them again and again
    try:
        dtype, part = id_type(path), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        n_docs = n_tokens = at = 0
        with store.open_output_stream(f"{root}/{name}.rec") as records, store.open_output_stream(f"{root}/{name}.idx") as index:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    some = batch.slice(k, 256)
                    ids = [np.append(np.frombuffer(x, "<u4"), end_id).astype(dtype) for x in encoder.encode([t or "" for t in some.column("text").to_pylist()])]
                    framed = frame(ids)
                    rows = np.zeros((len(ids), 4), "<i8")
                    key = some.column("doc_id")
                    rows[:, 0], rows[:, 1] = key.fill_null(0).to_numpy(), key.is_valid().to_numpy(zero_copy_only=False)
                    size = np.array([len(x) for x in framed])
                    rows[:, 2], rows[:, 3] = at + np.cumsum(size) - size, [len(x) for x in ids]
                    records.write(b"".join(framed))
                    index.write(rows.tobytes())
                    at += int(size.sum())
                    n_docs += len(ids)
                    n_tokens += int(rows[:, 3].sum())
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]}, pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
    finally:
        gc.enable()


def write_records(documents: DataFrame, path: str, folder: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encodes and writes all documents; returns the manifest (part, name, n_docs, n_tokens).

    Documents are range-partitioned by doc_id and sorted, null ids first, texts of one id in order of text, so
    shards in order of part are in order of doc_id. A null text is written as its end id alone.
    """
    spark = documents.sparkSession
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), plan_bytes(documents) // SHARD_BYTES + 1)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = rows.mapInArrow(lambda it: _write(it, path, folder, end_id), "part int, name string, n_docs long, n_tokens long")
    return materialize(manifest.repartition(n // SHARDS_A_FILE + 1), "manifest")


@tidied
def _read(batches: Iterator[pa.RecordBatch], folder: str, dtype: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with store.open_input_file(f"{root}/{name}.idx") as f:
                rows = np.frombuffer(f.read(), "<i8").reshape(-1, 4)
            starts = start + np.cumsum(rows[:, 3]) - rows[:, 3]
            with store.open_input_file(f"{root}/{name}.rec") as f:
                ends = np.append(rows[1:, 2], f.size())
                k = 0
                while k < len(rows):
                    to = max(k + 1, int(np.searchsorted(ends, rows[k, 2] + (4 << 20), "right")))
                    raw = np.frombuffer(f.read_at(int(ends[to - 1] - rows[k, 2]), int(rows[k, 2])), np.uint8)
                    ids, counts = unframe(raw, rows[k:to, 2] - rows[k, 2], dtype)
                    if (counts != rows[k:to, 3]).any():
                        raise ValueError(f"{name}: the index does not fit the records")
                    view, edge = memoryview(ids.astype("<u4")), np.append(0, np.cumsum(counts))
                    crc = [zlib.crc32(view[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rows[k:to, 0], pa.int64(), mask=rows[k:to, 1] == 0), pa.array(starts[k:to], pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    k = to


def read_records(manifest: DataFrame, folder: str, dtype: str) -> DataFrame:
    """doc_id, start (ids before it in all shards), n_tokens, ids_crc32 of every record, read from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())
    return shards.select("part", "name", "start").repartition(n, "part").mapInArrow(lambda it: _read(it, folder, dtype), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, path: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Writes all documents to ``folder`` (default: a new one in the shared folder) and reads them back.

    One row per row. A null text is its end id alone; a null doc_id comes first and stays null; rows that repeat a
    doc_id are records of their own, in order of text. A very long text is one record, held whole by its task. An empty
    table gives an empty one. Other columns are not read.
    """
    folder = folder or new_path(documents.sparkSession, "records")
    return read_records(write_records(documents, path, folder, end_id), folder, id_type(path))
