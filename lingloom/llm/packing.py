"""Packing token sequences by non-negative least squares.

Documents are cut into windows of the sequence length and a remainder. Remainders are counted in bins of a few tokens; all
combinations of up to three bins that fill a window exactly are enumerated, non-negative least squares fits how often to
repeat each one to the histogram, the counts are rounded down, and what is left is packed greedily, largest first, again
as repeated combinations. Both the histogram and the combinations are bounded by the number of bins, whatever the number
of documents, so they are solved on the driver; a piece finds its place from its rank within its bin.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import coder

#: Tokens in a bin; bins that together fill a window waste half of it a piece on average.
STEP = 8
#: Parts a bin's pieces are numbered in, so that one common length is not one task's work.
SALTS = 64


def shallow_combinations(sizes: np.ndarray, room: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Non-increasing combinations of 1 to depth of the sizes that add up to room."""
    present, out = set(sizes.tolist()), []

    def extend(head: tuple[int, ...], left: int, most: int) -> None:
        if len(head) == depth - 1 or not left:
            if not left:
                out.append(head)
            elif left in present and left <= most:
                out.append((*head, left))
            return
        if left in present and left <= most:
            out.append((*head, left))
        for s in sorted(present, reverse=True):
            if s <= most and s < left:
                extend((*head, s), left - s, s)

    extend((), room, room)
    return list(dict.fromkeys(out))


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that brings a @ x near b: accelerated projected gradient with restarts on the scaled columns."""
    if not a.size:
        return np.zeros(a.shape[1])
    scale = np.sqrt((a * a).sum(0))
    m = a / scale
    v = np.ones(m.shape[1])
    for _ in range(30):  # the largest eigenvalue by power iteration
        v = m.T @ (m @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (1.05 * float(np.linalg.norm(m.T @ (m @ v))) + 1e-12)
    x = y = np.zeros(m.shape[1])
    t, last = 1.0, np.inf
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (m.T @ (m @ y - b)))
        error = float(((m @ new - b) ** 2).sum())
        if error > last:
            t, y, last = 1.0, x, np.inf
            continue
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t, last = new + (t - 1) / u * (new - x), new, u, error
    return x / scale


def plan_patterns(counts: dict[int, int], room: int, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, repeats) that use up counts (bin size: pieces) exactly; no sequence is over room."""
    left = {s: n for s, n in counts.items() if n > 0}
    plan = []
    combinations = shallow_combinations(np.array(sorted(left), np.int64), room, depth)
    if combinations:
        sizes = sorted(left)
        row = {s: i for i, s in enumerate(sizes)}
        a = np.zeros((len(sizes), len(combinations)))
        for j, c in enumerate(combinations):
            for s in c:
                a[row[s], j] += 1
        repeats = non_negative_least_squares(a, np.array([left[s] for s in sizes], float))
        for j in np.argsort(-repeats, kind="stable"):
            need = defaultdict(int)
            for s in combinations[j]:
                need[s] += 1
            n = min(int(repeats[j] + 1e-6), *(left[s] // k for s, k in need.items()))
            if n > 0:
                plan.append((combinations[j], n))
                for s, k in need.items():
                    left[s] -= n * k
    left = {s: n for s, n in left.items() if n}
    while left:  # largest first, each gap filled with the largest that fits; a pattern repeats while its pieces last
        free, need = room, {}
        for s in sorted(left, reverse=True):
            k = min(left[s], free // s)
            if k:
                need[s] = k
                free -= k * s
        n = min(left[s] // k for s, k in need.items())
        plan.append((tuple(s for s, k in need.items() for _ in range(k)), n))
        for s, k in need.items():
            left[s] -= n * k
        left = {s: n for s, n in left.items() if n}
    return plan


def token_pieces(docs: DataFrame, vocabulary: str, room: int, end_id: int, step: int = STEP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and bin of every window and remainder of every text."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_rows = coder(vocabulary).encode_rows
        for batch in batches:
            for doc_id, ids, begin in encode_rows(batch, end_id):
                n = np.diff(begin)
                pieces = -(-n // room)
                row = np.repeat(np.arange(len(n)), pieces)
                start = room * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                length = np.minimum(room, n[row] - start)
                raw, at = memoryview(ids.astype("<u4").tobytes()), begin[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                columns = [doc_id.take(pa.array(row)), *(pa.array(c, pa.int64()) for c in (start, length, crc, n[row]))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    return rows.withColumn("bin", F.ceil(F.col("length") / step).cast("int"))


def pack_documents(docs: DataFrame, vocabulary: str, room: int = 2048, end_id: int = 1, step: int = STEP, depth: int = 3) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row of docs (doc_id, text).

    Null and empty texts have the end id alone; rows of equal id are packed each on its own; a null id is packed as any
    other; an empty table gives no rows; other columns are ignored. room is a multiple of step.
    """
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int")
    pieces = stored(token_pieces(docs, vocabulary, room, end_id, step).withColumn("salt", salt), "pieces")
    cells = pieces.groupBy("bin", "salt").count()
    found = cells.collect()  # at most room / step * SALTS rows
    counts, before = defaultdict(int), {}
    for r in sorted(found, key=lambda r: (r["bin"], r["salt"])):
        before[r["bin"], r["salt"]] = counts[r["bin"]]
        counts[r["bin"]] += r["count"]
    slots, sequence = defaultdict(list), 0  # bin: (first rank, first sequence, slot), ranks of a slot in a row
    used = defaultdict(int)
    for pattern, n in plan_patterns(dict(counts), room // step, depth):
        for slot, b in enumerate(pattern):
            slots[b].append((used[b], sequence, slot))
            used[b] += n
        sequence += n
    tables = {b: tuple(np.array(c, np.int64) for c in zip(*rows)) for b, rows in slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, ranks = batch.column("bin").to_numpy(), batch.column("rank").to_numpy()
            ranks = ranks + np.array([before[k] for k in zip(bins.tolist(), batch.column("salt").to_pylist())], np.int64)
            to, slot = np.empty(len(bins), np.int64), np.empty(len(bins), np.int64)
            for b in np.unique(bins):
                own = np.flatnonzero(bins == b)
                first, sequences, which = tables[int(b)]
                k = np.searchsorted(first, ranks[own], "right") - 1
                to[own], slot[own] = sequences[k] + ranks[own] - first[k], which[k]
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(to), pa.array(slot)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    in_cell = Window.partitionBy("bin", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", (F.row_number().over(in_cell) - 1).cast("long"))
    placed = ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).cast("long")).drop("slot")
