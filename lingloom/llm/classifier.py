"""A quality classifier: histogram gradient-boosted trees over statistics of documents.

Statistics come from whole texts, a block of them at a time. Their values are put into bins at quantiles of the training
rows; a tree grows level by level, each split chosen from sums of gradients by bin. Trees are complete and flattened: at a
level a row's next node is twice its node plus the outcome, so all rows of a batch go down a tree with a few array look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, range_hashes, stored, word_bounds

#: Labelled rows that the trees learn from at most: the sample's size does not grow with the input.
FIT_ROWS = 30_000
TREES, DEPTH, RATE, BINS = 60, 4, 0.15, 64
#: Regularisation of a leaf's value, and the least weight of a leaf.
L2, LEAST = 1.0, 2.0
#: Bytes of text worked on at a time; a longer text is a block of its own.
BLOCK = 1 << 21

STATISTICS = (
    "log_chars", "log_words", "word_chars", "word_chars_sd", "log_longest_word", "upper", "digits", "symbols", "symbol_ends", "shouts", "points",
    "spaces", "lines", "wide", "other", "distinct_words", "top_word", "distinct_pairs", "stutters", "equal_lines", "log_line",
)

# kinds of bytes
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _SYMBOL, _SHOUT, _POINT, _LEAD, _REST, _OTHER = range(11)
_KIND = np.full(256, _OTHER, np.uint8)
for _chars, _kind in ((b"#*$%&|<>", _SYMBOL), (b"!?", _SHOUT), (b".,;:", _POINT), (b"\t\x0b\x0c\r ", _SPACE), (b"\n", _LINE), (range(97, 123), _LOWER), (range(65, 91), _UPPER), (range(48, 58), _DIGIT), (range(128, 192), _REST), (range(192, 256), _LEAD)):
    _KIND[list(_chars)] = _kind


def _runs(group: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n groups: how many distinct hashes it has, and how often its most frequent one occurs."""
    if not len(group):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    key = np.sort((group.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    of = (key[new] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, np.diff(np.r_[new, len(key)]))
    return np.bincount(of, minlength=n), most


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATISTICS for every text; null, empty and blank ones are zeros but for their length."""
    n = len(texts)
    buf, at = joined(texts)
    of = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(of * 11 + _KIND[buf], minlength=n * 11).reshape(n, 11).astype(np.float64)
    kinds[:, _LINE] -= 1  # the line end behind every text
    chars = kinds.sum(1) - kinds[:, _REST]
    start, end = word_bounds(buf)
    doc = of[start] if len(start) else np.zeros(0, np.int64)
    wide = np.r_[0, np.cumsum(_KIND[buf] == _REST)]
    size = (end - start) - (wide[end] - wide[start])
    words = np.bincount(doc, minlength=n).astype(np.float64)
    per_word = lambda x: np.divide(x, words, out=np.zeros(n), where=words > 0)
    total, squares, longest = np.bincount(doc, size, n), np.bincount(doc, size.astype(np.float64) ** 2, n), np.zeros(n)
    np.maximum.at(longest, doc, size)
    mean = per_word(total)
    hashes = range_hashes(buf, start, end)
    distinct, top = _runs(doc, hashes, n)
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    pairs, _ = _runs(doc[inside], hashes[inside] * np.uint64(0x9E3779B97F4A7C15) + hashes[inside + 1], n)
    stutters = np.bincount(doc[inside], hashes[inside] == hashes[inside + 1], n)
    symbol_ends = np.bincount(doc, _KIND[buf[end - 1]] == _SYMBOL, n) if len(end) else np.zeros(n)
    stops = np.flatnonzero(buf == 10)
    begins = np.r_[0, stops[:-1] + 1] if len(stops) else stops
    full = stops > begins
    line_of = of[begins[full]]
    lines = np.bincount(line_of, minlength=n).astype(np.float64)
    own_lines, _ = _runs(line_of, range_hashes(buf, begins[full], stops[full]), n)
    letters, some = kinds[:, _LOWER] + kinds[:, _UPPER], np.maximum(chars, 1)
    per_pair, per_line = np.maximum(words - 1, 1), np.maximum(lines, 1)
    return np.stack(
        [
            np.log1p(chars), np.log1p(words), mean, np.sqrt(np.maximum(per_word(squares) - mean**2, 0)), np.log1p(longest), kinds[:, _UPPER] / np.maximum(letters, 1), kinds[:, _DIGIT] / some,
            per_word(kinds[:, _SYMBOL]), per_word(symbol_ends), per_word(kinds[:, _SHOUT]), per_word(kinds[:, _POINT]), kinds[:, _SPACE] / some, per_word(kinds[:, _LINE]), kinds[:, _LEAD] / some,
            kinds[:, _OTHER] / some, per_word(distinct), per_word(top), pairs / per_pair, stutters / per_pair, (lines - own_lines) / per_line, np.log1p(chars / per_line),
        ],
        axis=1,
    ).astype(np.float32)


@dataclass
class Trees:
    """Complete trees in arrays: by tree and inner node (from the top, level by level) the statistic and the value up to which
    a row goes left; by tree and leaf what is added to a row's log odds."""

    start: float
    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        out = np.full(len(x), self.start)
        for feature, split, value in zip(self.feature, self.split, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > split[node])
            out += value[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _best_splits(g: np.ndarray, h: np.ndarray, binned: np.ndarray, node: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of width nodes the best gain, its statistic and the last bin that goes left. node: of every row, from 0."""
    best, feature, last = np.zeros(width), np.zeros(width, np.int64), np.full(width, BINS)
    for f in range(binned.shape[1]):
        place = node * BINS + binned[:, f]
        left_g = np.cumsum(np.bincount(place, g, width * BINS).reshape(width, BINS), axis=1)
        left_h = np.cumsum(np.bincount(place, h, width * BINS).reshape(width, BINS), axis=1)
        all_g, all_h = left_g[:, -1:], left_h[:, -1:]
        gain = left_g**2 / (left_h + L2) + (all_g - left_g) ** 2 / (all_h - left_h + L2) - all_g**2 / (all_h + L2)
        gain[(left_h < LEAST) | (all_h - left_h < LEAST)] = 0
        at = gain.argmax(axis=1)
        better = gain[np.arange(width), at] > best + 1e-9
        best[better], feature[better], last[better] = gain[np.arange(width), at][better], f, at[better]
    return best, feature, last


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Trees for rows x (statistics) with labels y (0 or 1), by the logistic loss. With labels of one kind only, or none, the
    smoothed share of 1 is all that is learned."""
    share = (y.sum() + 1) / (len(y) + 2)
    start, inner = float(np.log(share / (1 - share))), 2**DEPTH - 1
    out = Trees(start, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1)))
    if not len(y) or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
    odds = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            gain, feature, last = _best_splits(g, h, binned, node - first, 2**level)
            for k in np.flatnonzero(gain > 0).tolist():
                out.feature[t, first + k] = feature[k]
                out.split[t, first + k] = edges[feature[k]][last[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), out.feature[t, node]] > out.split[t, node])
        leaf = node - inner
        out.value[t] = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        odds += out.value[t][leaf]
    return out


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list]]:
    texts = batch.column("text").to_pylist()
    low = size = 0
    for k, t in enumerate(texts):
        if k > low and size + len(t or "") > BLOCK:
            yield low, texts[low:k]
            low, size = k, 0
        size += len(t or "")
    if low < len(texts):
        yield low, texts[low:]


def held_out(doc_id: Column, of: int = 5) -> Column:
    """Whether an id's checksum is divisible; null ids are not held out, and have no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of labelled documents that are not held out: all, or about `rows` chosen by a hash of their ids.
    Several labels of an id count as the one that most of them say (1 if even), several documents of an id as one of them."""
    kept = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    kept = stored(kept.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality")), "labels")
    share = rows / max(kept.count(), 1)
    if share < 1:
        kept = kept.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in _blocks(batch):
                part = batch.slice(low, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(list(statistics(texts)), pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    # the chosen labels are a bounded table
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(kept), "doc_id").select("doc_id", "quality", "text")
    measured = chosen.mapInArrow(measure, "doc_id long, quality int, x array<float>").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
    found = measured.toArrow().sort_by("doc_id")
    x = np.array(found.column("x").to_pylist(), np.float32).reshape(-1, len(STATISTICS))
    return x, found.column("quality").to_numpy().astype(np.float64)


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text), by trees that learn from labels (doc_id,
    quality) of ids that are not held out.

    Null and empty texts have statistics of zero and a score like any; null, repeated and tied ids are rows of their own;
    without labels every score is 0.5; other columns are ignored; an empty table gives no rows.
    """
    trees = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(docs, labels, rows)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in _blocks(batch):
                p = trees.value.score(statistics(texts))
                part = batch.slice(low, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows_.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
