"""Token ids in files of bit- or byte-plane shuffled chunks.

A file is a range of documents in ascending id order and holds its ids in chunks of a fixed number. A chunk's ids are
transposed into planes (byte k of every id, or bit k of every id) and each plane is compressed with zstandard on its own:
the high planes of small ids are nearly constant. A chunk's row is its entry in the index: where its ids start in the
file, how many there are, the sizes of its planes, which document its first id belongs to and where that one starts, and
which documents start in it and where. So a chunk is read without any other: whole files are decoded chunk by chunk, and
single documents by the entries that name them.

Spark writes and reads the rows as a table in a shared folder, so that the files stand wherever Spark's storage is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import tasks
from .tokens import coder

CHUNK = 1 << 16
CHUNK_SCHEMA = "file_no int, chunk_no int, first_id long, n_ids int, n_planes int, plane_bytes array<int>, payload binary, open_doc long, open_start long, doc_ids array<long>, doc_starts array<long>"
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_NAMES = ["file_no", "chunk_no", "first_id", "n_ids", "n_planes", "plane_bytes", "payload", "open_doc", "open_start", "doc_ids", "doc_starts"]


def split_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The four byte planes, or 32 bit planes, of 32-bit ids."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    each = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(each[:, k], bitorder="little").tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    raw = np.empty((n, 4), np.uint8)
    if len(planes) == 4:
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        each = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw[:] = np.packbits(each, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, chunk: int = CHUNK, bits: bool = False, files: int | None = None) -> None:
    """Encodes every text of docs (doc_id, text), appends end_id, and writes the ids in ascending doc_id order.

    Null text is empty and gives the end id alone; rows of null id come first; rows of equal id keep together in any
    order; an empty table gives an empty folder of files; other columns are ignored.
    """
    files = files or tasks(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        file_no = TaskContext.get().partitionId()
        pack, encode_rows = zstandard.ZstdCompressor(level=3), coder(vocabulary).encode_rows
        waiting, n_waiting, total, done = [], 0, 0, 0
        doc_ids, doc_starts, opened = [], np.zeros(0, np.int64), (None, 0)

        def row(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal done, doc_ids, doc_starts, opened
            first = done * chunk
            here = int(np.searchsorted(doc_starts, first + len(ids)))
            planes = [pack.compress(p) for p in split_planes(ids, bits)]
            values = [file_no, done, first, len(ids), len(planes), [len(p) for p in planes], b"".join(planes), *opened, doc_ids[:here], doc_starts[:here]]
            if here:
                opened = doc_ids[here - 1], int(doc_starts[here - 1])
            doc_ids, doc_starts = doc_ids[here:], doc_starts[here:]
            done += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], names=_NAMES)

        for batch in batches:
            for doc_id, ids, begin in encode_rows(batch, end_id):
                doc_ids += doc_id.to_pylist()
                doc_starts = np.r_[doc_starts, total + begin[:-1]]
                total += len(ids)
                waiting.append(ids)
                n_waiting += len(ids)
                if n_waiting >= chunk:
                    whole = np.concatenate(waiting)
                    n_waiting = len(whole) % chunk
                    for at in range(0, len(whole) - n_waiting, chunk):
                        yield row(whole[at : at + chunk])
                    waiting = [whole[len(whole) - n_waiting :]]
        if n_waiting:
            yield row(np.concatenate(waiting))

    ordered.mapInArrow(encode, CHUNK_SCHEMA).write.parquet(path)


def _parts(chunks: DataFrame, keep: bool = False) -> DataFrame:
    """file_no, doc_id, at (where the document starts in the file), first (where this part of it does), n, and ids (their
    bytes) or, where all of the document is sure to be in the chunk and unless keep is set, crc instead, of every part of a
    document in a chunk."""
    schema = pa.schema([("file_no", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("crc", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in batch.to_pylist():
                ends = np.cumsum(r["plane_bytes"])
                ids = join_planes([unpack.decompress(r["payload"][e - s : e]) for s, e in zip(r["plane_bytes"], ends.tolist())], r["n_ids"])
                raw, low, high = memoryview(ids.tobytes()), r["first_id"], r["first_id"] + r["n_ids"]
                docs, at = r["doc_ids"], np.array(r["doc_starts"], np.int64)
                goes_on = not len(at) or at[0] > low  # the chunk begins inside a document
                if goes_on:
                    docs, at = [r["open_doc"], *docs], np.r_[r["open_start"], at]
                first = np.maximum(at, low)
                edges = np.r_[first, high] - low
                parts = [raw[4 * a : 4 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                # the first part of a document from before, and the last of the chunk, may be less than the document
                open_end = [keep or k == len(parts) - 1 or k == 0 and goes_on for k in range(len(parts))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["file_no"]] * len(parts), pa.int32()),
                        pa.array(docs, pa.int64()),
                        pa.array(at),
                        pa.array(first),
                        pa.array(np.diff(edges)),
                        pa.array([bytes(p) if o else None for p, o in zip(parts, open_end)], pa.binary()),
                        pa.array([None if o else zlib.crc32(p) for p, o in zip(parts, open_end)], pa.int64()),
                    ],
                    schema=schema,
                )

    index = chunks.select("file_no", "first_id", "n_ids", "plane_bytes", "payload", "open_doc", "open_start", "doc_ids", "doc_starts")
    return index.mapInArrow(decode, "file_no int, doc_id long, at long, first long, n long, ids binary, crc long")


def _joined(parts: DataFrame) -> DataFrame:
    """Documents cut by chunk borders put together: file_no, doc_id, at, n, ids; a group is a document."""
    pieces = F.sort_array(F.collect_list(F.struct("first", "ids")))
    whole = parts.where("ids IS NOT NULL").groupBy("file_no", "doc_id", "at").agg(F.sum("n").alias("n"), pieces.alias("p"))
    return whole.select("file_no", "doc_id", "at", "n", F.expr("aggregate(p, CAST('' AS BINARY), (a, x) -> concat(a, x.ids))").alias("ids"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document from the files at path; a task decodes chunk by chunk, and only
    documents that chunk borders cut are shuffled."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = chunks.groupBy("file_no").agg(F.sum("n_ids").alias("n")).select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_of_file"))
    parts = _parts(chunks)
    docs = parts.where("ids IS NULL").select("file_no", "doc_id", "at", "n", "crc").union(_joined(parts).select("file_no", "doc_id", "at", "n", F.crc32("ids").alias("crc")))
    return docs.join(files, "file_no").select("doc_id", (F.col("at") + F.col("first_of_file")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def tokens_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (array of long) of the given documents (a short list): the index says which chunks to decode."""
    wanted = F.array(*[F.lit(i).cast("long") for i in doc_ids])
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path).where(F.arrays_overlap("doc_ids", wanted) | F.col("open_doc").isin(doc_ids))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b, "<u4").astype(np.int64) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], schema=schema)

    return _joined(_parts(chunks, keep=True).where(F.col("doc_id").isin(doc_ids))).select("doc_id", "ids").mapInArrow(numbers, "doc_id long, ids array<long>")
