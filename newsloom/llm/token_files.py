"""Token ids in files: frequency-ranked ids, byte-aligned, control bytes apart from data bytes.

A file holds the ids of a run of documents in ascending order of doc_id. Its ids are ranked by how often they occur in it, and each
rank takes as many bytes as it needs; two bits for each rank, four ranks in a control byte, say how many. The layout, all little-endian:

    magic "FRID", u32 documents, u64 ids, u32 table size | u8 has-id and i64 doc_id of each document | u32 length of each
    document | u32 id of each rank | control bytes | data bytes

Reading takes no loop over ids: a table of 256 rows turns control bytes into widths, sums of the widths into places.

Files have unique names and count only once the manifest names them, so a task that runs twice does no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import staged, text_or_empty, text_steps
from newsloom.llm.units import LibraryCoder
from newsloom.session import scratch_path

#: A file is closed when it has this many ids; a longer document fills one alone.
FILE_IDS = 2_000_000
#: Characters of text coded at a time.
STEP = 16_000_000
HEAD = "<4sIQI"
#: The four 2-bit codes of each control byte.
CODES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8)
#: What is kept of four bytes by a width of 1 to 4.
KEEP = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    values = np.ascontiguousarray(values, "<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    quads = np.zeros((len(values) + 3) // 4 * 4, np.uint8)
    quads[: len(values)] = code
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers that ``pack`` was given."""
    code = CODES[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(code, dtype=np.int64) - code + np.arange(n)
    # Four bytes from every place on, as one number.
    raw = np.frombuffer(data + bytes(3), np.uint8)
    return np.ndarray((max(len(data), 1),), "<u4", raw, strides=(1,))[starts] & KEEP[code] if n else np.zeros(0, np.uint32)


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's content."""
    counts = np.bincount(ids)
    table = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    rank = np.zeros(len(counts), np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    control, data = pack(rank[ids])
    return b"".join([
        struct.pack(HEAD, b"FRID", len(doc_ids), len(ids), len(table)),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        lengths.astype("<u4").tobytes(), table.tobytes(), control, data,
    ])


def from_bytes(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """What ``to_bytes`` was given."""
    magic, docs, n, size = struct.unpack_from(HEAD, content)
    if magic != b"FRID":
        raise ValueError("not a file of token ids")
    at = struct.calcsize(HEAD)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, count, at)
        at += out.nbytes
        return out

    known, doc_ids, lengths, table = take("u1", docs), take("<i8", docs), take("<u4", docs), take("<u4", size)
    control = take("u1", (n + 3) // 4).tobytes()
    ids = table[unpack(control, content[at:], n)] if n else np.zeros(0, np.uint32)
    return [int(d) if k else None for k, d in zip(known, doc_ids, strict=True)], lengths, ids


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of whole texts of ``docs`` (doc_id, text), each followed by ``end_id``, to files under ``folder``.

    Gives the manifest, one row per file: partition, number (of the file in it), before (ids of the partition's earlier files), docs, ids,
    path. Files in order of (partition, number) hold documents in ascending order of doc_id, nulls first; rows with the
    same doc_id are in order of their text. A null or empty text has the end id only. An empty table gives no file.
    """
    spark = docs.sparkSession
    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        library = spark.sparkContext.broadcast(f.read())

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        coder, partition = LibraryCoder(library.value), TaskContext.get().partitionId()
        before = number = size = 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal held, size, before, number
            doc_ids = [d for part in held for d in part[0]]
            lengths, ids = (np.concatenate([part[i] for part in held]) for i in (1, 2))
            name = f"{partition:06d}-{number:06d}-{uuid.uuid4().hex}.ids"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(to_bytes(doc_ids, lengths, ids))
            row = [partition, number, before, len(doc_ids), len(ids), name]
            held, size, before, number = [], 0, before + len(ids), number + 1
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["partition", "number", "before", "docs", "ids", "name"])

        for batch in batches:
            for part in text_steps(batch, most=STEP):
                ids, lengths = coder.ids(part.column("text"))
                ends = np.cumsum(lengths)
                ids = np.insert(ids, ends, end_id)
                held.append((part.column("doc_id").to_pylist(), lengths + 1, ids))
                size += len(ids)
                if size >= file_ids:
                    yield close()
        if held:
            yield close()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = rows.mapInArrow(files, "partition int, number int, before long, docs long, ids long, name string")
    return staged(written, "token-manifest").withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "name")).drop("name")


def read(manifest: DataFrame) -> DataFrame:
    """The documents in the files of ``manifest``: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian u32 in a binary)."""
    spark = manifest.sparkSession
    totals = manifest.groupBy("partition").agg(F.sum("ids").alias("ids"), F.count("*").alias("files")).orderBy("partition").collect()
    base, total = [], 0
    for row in totals:  # one row for each partition of the write
        base.append((row["partition"], total))
        total += row["ids"]
    if not base:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    known = spark.createDataFrame(base, "partition int, base long")
    files = manifest.join(known, "partition").select((F.col("base") + F.col("before")).alias("start"), "path")
    tasks = min(sum(row["files"] for row in totals), 10_000)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for start, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place) as file:
                    doc_ids, lengths, ids = from_bytes(file.read())
                ends = np.cumsum(lengths, dtype=np.int64)
                ids = ids.astype("<u4", copy=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(start + ends - lengths),
                        pa.array(lengths.astype(np.int64)),
                        pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, lengths.astype(np.int64), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return files.repartition(tasks).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """``docs`` written to a new folder in the shared folder, and read back."""
    return read(write(docs, scratch_path(docs.sparkSession, "token-files")))


def crc32(ids: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids."""
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: np.ndarray) -> int:
    """The same checksum for a test."""
    return zlib.crc32(ids.astype("<u4").tobytes())
