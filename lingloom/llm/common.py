"""What the operators of this subpackage share: scratch tables and vectorised word handling."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import shared_dir, small_or_shuffled

#: A word is a run of anything but ASCII white space (the same six characters bytes.split() cuts at).
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as a table in the shared folder and read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")  # rows with whole texts or sets
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs, whatever its case, does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key that tells its rows apart and never changes, and the key's name. Rows read straight from Parquet files
    have theirs from their file and place in it, so they are not written again; of others a copy is written with the key."""
    key = fresh(docs, "row_key")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":  # more than a scan of files
        return stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key
    path, file_no, own = (fresh(docs, x) for x in ("path", "file_no", "file_path"))
    place = docs.metadataColumn("_metadata")
    found = docs.select(place.getField("file_path").alias(path)).distinct()
    number = Window.orderBy(path)  # one row a file
    files = small_or_shuffled(stored(found.select(path, F.row_number().over(number).cast("long").alias(file_no)), "files"))
    rows = docs.withColumns({own: place.getField("file_path"), key: place.getField("row_index")}).join(files, F.col(own) == F.col(path))
    return rows.withColumn(key, F.shiftleft(file_no, 40) + F.col(key)).drop(own, path, file_no), key


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x5851F42D4C957F2D
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes hashed at a time.
_STRETCH = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base, and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, step in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            a = np.full(n, np.uint64(step), np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS[0][:n], _POWERS[1][:n]


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte range [start, end) of buf (in order, not overlapping); equal ranges have equal hashes
    wherever they stand. Worked out in stretches, which keeps it in the cache and in little memory."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _STRETCH)))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _powers(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((buf[low:high].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a byte buffer."""
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


def joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, each followed by a newline, and where each begins (with the end of the last)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", np.uint8), at


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ..., starts[1], ...: the index of every element of the given runs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as disjoint, ordered ones that do not touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(e) - 1]]
