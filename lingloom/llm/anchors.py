"""Content-defined anchors: the sampled suffixes that both substring operators exchange.

Every window of a fixed length holds an anchor, the leftmost smallest-hashed gram in it; equal windows hold it at the same
place. So all windows can be compared by meeting only at anchors: an anchor is sent once, with the text of all windows
that chose it, to the part of the cluster that its gram belongs to. Contexts that are equal in a block of documents are
sent once, with the list of their places, which is what keeps large groups of copies from piling up in one task.

Prefixes are of variable length. The bytes of contexts are summed by their gram first; contexts whose gram holds more than a
share of what a part may hold in memory are split by a prefix of half a window, which every window has on one side of its
anchor, and where that holds too much as well, by whole windows. The number of parts follows from the bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import small_or_shuffled
from .common import ranges, stored, tasks

#: Bytes of contexts that a part should hold.
PART_BYTES = 16 << 20
#: Counters for each part that the bytes call for, by gram or longer prefix, and the share of a part above which a counter's
#: contexts are split.
COUNTERS, SHARE = 32, 0.25
#: Bytes of contexts for a byte of text, about.
SPREAD = 3
#: Text of the documents that one block of map-side work holds.
BLOCK_BYTES = 4 << 20
SPAN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("text_key", pa.int64())])
#: Stands for a null id.
NO_ID = -(1 << 63)


def sliding_anchor(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each i, the place of the smallest of hashes[i : i + width] (leftmost of equals, by their upper 40 bits)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    out = np.empty(n, np.int64)
    step = (1 << 24) - 2 * width  # places are packed into 24 bits beside the hash
    for at in range(0, n, step):
        part = hashes[at : min(len(hashes), at + step + width - 1)]
        m = len(part) - width + 1
        packed = np.full(-(-len(part) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        packed[: len(part)] = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        rows = packed.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        out[at : at + m] = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & low).astype(np.int64) + at
    return out


def anchor_runs(anchor: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window of every run of consecutive windows with one anchor. window: places, ascending."""
    if not len(anchor):
        return anchor, window, window
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])
    return anchor[new], window[new], window[np.r_[new[1:] - 1, len(anchor) - 1]]


def rows_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    """(doc_id, text) of a batch's rows, of which only a few are Python objects at a time."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield from zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES, empty: bool = False) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and UTF-8 texts of the documents, in blocks of about size bytes; unless empty is set, rows without id or text
    are left out."""
    ids, texts, total = [], [], 0
    for batch in batches:
        for i, t in rows_of(batch):
            if empty or i is not None and t:
                raw = (t or "").encode()
                ids.append(i)
                texts.append(raw)
                total += len(raw)
                if total >= size:
                    yield ids, texts
                    ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def keyed(docs: DataFrame, nulls: bool) -> DataFrame:
    """own_id, doc_id, text, text_key of docs. text_key is 0 where no other row has the row's id; else it is a hash of the
    text, so that rows of one id and other texts are told apart, and rows of one id and text are one another's equals.
    own_id is the id as it stands; with nulls, rows of null id get one in doc_id (and a hash) to take part like others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), "text")
    again = stored(rows.groupBy("own_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("own_id").alias("again")), "again")  # reads ids only
    own_hash = F.xxhash64("text")
    own_hash = F.when(own_hash == 0, F.lit(1).cast("long")).otherwise(own_hash)
    some = F.col("own_id").isNull()
    if again.where("again IS NOT NULL").limit(1).count():
        rows = rows.join(small_or_shuffled(again.where("again IS NOT NULL")), F.col("own_id") == F.col("again"), "left")
        some = some | F.col("again").isNotNull()
    doc_id = F.coalesce("own_id", F.lit(NO_ID)) if nulls else F.col("own_id")
    return rows.select("own_id", doc_id.alias("doc_id"), "text", F.when(some, own_hash).otherwise(F.lit(0).cast("long")).alias("text_key"))


def keyed_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Ids, keys and UTF-8 texts of the rows with id and text, in blocks of about size bytes."""
    ids, keys, texts, total = [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for i, t, k in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "text_key"))):
                if i is not None and t:
                    ids.append(i)
                    keys.append(k)
                    texts.append(t.encode())
                    total += len(texts[-1])
                    if total >= size:
                        yield ids, keys, texts
                        ids, keys, texts, total = [], [], [], 0
    if ids:
        yield ids, keys, texts


@dataclass
class Runs:
    """Runs of windows with one anchor in a block of texts: places of the anchors and of the first and last windows. size
    gives the bytes of runs (low, high), and gram, half and whole the 64-bit hashes of the gram, of half a window and of a
    whole one that begin at given places."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    window: int
    gram_width: int
    size: Callable[[np.ndarray, np.ndarray], np.ndarray]
    gram: Callable[[np.ndarray], np.ndarray]
    half: Callable[[np.ndarray], np.ndarray]
    whole: Callable[[np.ndarray], np.ndarray]

    @property
    def half_width(self) -> int:
        return (self.window + 1) // 2

    def halves(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, low, high and hash of the runs that which picks, cut in two: windows that hold half a window from their
        anchor on, and those that hold one that ends with the gram."""
        a, low, high = self.anchor[which], self.low[which], self.high[which]
        edge = a - (self.window - self.half_width)
        right, left = np.maximum(low, edge), np.minimum(high, edge - 1)
        r, x = right <= high, low <= left
        start = np.r_[a[r], a[x] + self.gram_width - self.half_width]
        return np.r_[a[r], a[x]], np.r_[right[r], low[x]], np.r_[high[r], left[x]], self.half(start)


@dataclass
class Deal:
    """The number of parts and of counters, and the counters of grams and of half windows whose contexts are too many for one
    part."""

    parts: int
    counters: int
    heavy: np.ndarray
    heavier: np.ndarray

    def counter(self, key: np.ndarray) -> np.ndarray:
        return key % np.uint64(self.counters)

    def hot(self, runs: Runs) -> np.ndarray:
        """Whether the counter of every run is heavy."""
        return np.isin(self.counter(runs.gram(runs.anchor)), self.heavy)

    def apply(self, runs: Runs) -> np.ndarray:
        """Splits runs as far as need be; the part of each."""
        hot, parts = self.hot(runs), np.uint64(self.parts)
        part = runs.gram(runs.anchor) % parts
        if not hot.any():
            return part.astype(np.int64)
        a, low, high, key = runs.halves(hot)
        hotter = np.isin(self.counter(key), self.heavier)
        n = (high - low + 1)[hotter]
        one = ranges(low[hotter], n)
        part = np.r_[part[~hot], key[~hotter] % parts, runs.whole(one) % parts]
        runs.anchor = np.r_[runs.anchor[~hot], a[~hotter], np.repeat(a[hotter], n)]
        runs.low, runs.high = np.r_[runs.low[~hot], low[~hotter], one], np.r_[runs.high[~hot], high[~hotter], one]
        return part.astype(np.int64)


def _heavy(docs: DataFrame, find: Callable, count: Callable[[Runs], tuple[np.ndarray, np.ndarray]], block: int) -> np.ndarray:
    """The counters whose contexts are too many for one part. count: counter and bytes of a block's runs."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for _, texts in blocks(batches, block):
            if (runs := find(texts)) is not None:
                counter, size = count(runs)
                if len(counter):
                    new = np.bincount(counter.astype(np.int64), weights=size).astype(np.int64)
                    new[: len(total)] += total[: len(new)]
                    total = new if len(new) >= len(total) else np.r_[new, total[len(new) :]]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["counter", "size"])

    sums = docs.mapInArrow(measure, "counter long, size long").groupBy("counter").agg(F.sum("size").alias("size"))
    # of counters above a share of a part there are few: not more than parts over that share
    return np.array([r["counter"] for r in sums.where(F.col("size") > int(PART_BYTES * SHARE)).select("counter").collect()], np.uint64)


def dealt(docs: DataFrame, find: Callable, block: int, parts: int | None = None, split: bool = True, spread: int = SPREAD) -> Deal:
    """How the contexts of docs are dealt, from sums over all of them. parts: a number to use in place of the one that the
    bytes call for; without split, every gram's contexts stay together and nothing is summed first. spread: bytes of contexts
    for a byte of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    needed = max(1, -(-spread * total // PART_BYTES))
    none = np.zeros(0, np.uint64)
    deal = Deal(parts or max(tasks(docs.sparkSession), needed), needed * COUNTERS, none, none)

    def by_gram(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
        return deal.counter(runs.gram(runs.anchor)), runs.size(runs.low, runs.high)

    heavy = _heavy(docs, find, by_gram, block) if split else none
    if len(heavy):
        first = replace(deal, heavy=heavy)

        def by_half(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
            _, low, high, key = runs.halves(first.hot(runs))
            return first.counter(key), runs.size(low, high)

        deal = replace(first, heavier=_heavy(docs, find, by_half, block))
    return deal


def spans_of(
    rows: DataFrame, find: Callable, exchange: Callable, meet: Callable, block: int = BLOCK_BYTES, parts: int | None = None,
    split: bool = True, schema: pa.Schema = SPAN_SCHEMA, spread: int = SPREAD,
) -> DataFrame:
    """doc_id, s, e, text_key (as often as found) of rows as keyed() gives them, and what else of long columns schema has: find
    gives the runs of a block's texts, exchange (part, blob) rows of a block's runs once they are dealt, meet the spans of a
    part's blobs."""
    deal = dealt(rows.select("doc_id", "text"), find, block, parts, split, spread)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, own in keyed_blocks(batches, block):
            if (runs := find(own)) is None:
                continue
            part = deal.apply(runs)
            found = exchange(ids, own, runs, part, keys)
            for at in range(0, len(found), 256):
                number, blob = zip(*found[at : at + 256])
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(blob, pa.binary())], names=["part", "blob"])

    def receive(table: pa.Table) -> pa.Table:
        columns = meet(table["blob"].to_pylist())
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    sent = rows.select("doc_id", "text", "text_key").mapInArrow(send, "part long, blob binary")
    return sent.groupBy("part").applyInArrow(receive, ", ".join(f"{n} long" for n in schema.names))


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with every text that is not empty compressed."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = pa.array([pack.compress(t.encode()) if t else None for t in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else part.column(c) for c in part.schema.names], names=part.schema.names)


def with_spans(rows: DataFrame, spans: DataFrame, cut: Callable[[bytes, np.ndarray, np.ndarray], tuple], result: list[tuple[str, pa.DataType, str]], packed: bool = False) -> DataFrame:
    """doc_id and what cut(text, starts, ends of its spans) returns, for every row as keyed() gives them; cut also gets what
    else of columns the spans have. A span is taken once, however many equal rows it was found in. With packed, texts are
    compressed on their way, each for itself."""
    fields = ["s", "e", *(c for c in spans.columns if c not in SPAN_SCHEMA.names)]
    of_doc = spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(*fields)).alias("spans"))
    if packed:
        rows = rows.mapInArrow(pack_texts, "own_id long, doc_id long, text binary, text_key long")
    rows = rows.join(of_doc, ["doc_id", "text_key"], "left").select(F.col("own_id").alias("doc_id"), "text", "spans")
    none = np.zeros(0, np.int64)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            spans = batch.column("spans")
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = [none] * len(fields)
                if spans[k].is_valid:
                    own = [spans[k].values.field(f).to_numpy() for f in fields]
                raw = unpack.decompress(text) if packed and text else (text or "").encode()
                out.append(cut(raw, *own))
            columns = list(zip(*out)) or [()] * len(result)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, (_, t, _) in zip(columns, result))], names=["doc_id", *(n for n, _, _ in result)])

    return rows.mapInArrow(apply, "doc_id long, " + ", ".join(f"{n} {t}" for n, _, t in result))
