"""Substring dedup over words with prefix-partitioned suffix trees.

Suffixes are word sequences cut at the window length, below which nothing is asked of the tree. They are split by prefix:
first over the cluster, by the gram of words at the anchor their window holds, or by a longer prefix where a gram's suffixes
are more than a task should hold (see anchors), and in a task by as many further words as it takes: the subtree below a gram is built breadth-first, a few words of all its suffixes at a time, and a suffix that is
alone below its node is a leaf and not looked at again. What is left at the window's depth are the deep internal nodes:
repeats. A node's smallest doc_id says in which documents a repeat goes.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import Runs, anchor_runs, keyed, sliding_anchor, spans_of, with_spans
from .common import merged, mix64, range_hashes, ranges, word_bounds

WINDOW = 13
GRAM = 2
#: Text of a block of documents, and how hard its blobs are compressed; larger and harder ones make a smaller shuffle.
BLOCK, LEVEL = 6 << 20, 9
#: Words of all suffixes that one step of the tree's growth looks at.
STEPS = ((0, 4), (4, 8), (8, WINDOW))


def _steps(window: int) -> list[tuple[int, int]]:
    return [(d, min(d + 5, window)) for d in range(0, window, 5)] if window != WINDOW else list(STEPS)


@dataclass
class Words(Runs):
    """Runs over words, with the block's text."""

    text: bytes = b""
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    doc: np.ndarray | None = None
    first_word: np.ndarray | None = None


def find(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> Words | None:
    """The runs of a block's windows."""
    plain = [b" ".join(t.split()) for t in texts]
    text = b"\n".join(plain) + b"\n"
    buf = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(buf)
    if len(starts) < window:
        return None
    doc_end = np.cumsum([len(p) + 1 for p in plain])
    doc = np.searchsorted(doc_end, starts, "right")
    first_word = np.searchsorted(starts, doc_end - np.array([len(p) + 1 for p in plain]))
    words = range_hashes(buf, starts, ends)

    def hashed(at: np.ndarray, width: int) -> np.ndarray:
        """Hashes of width words from each place on."""
        out = words[at].copy()
        for k in range(1, width):
            out = mix64(out + np.uint64(2 * k + 1) * words[at + k])
        return out >> np.uint64(20)

    grams = words[: len(words) - gram + 1].copy()
    for k in range(1, gram):
        grams = mix64(grams + np.uint64(2 * k + 1) * words[k : len(words) - gram + 1 + k])
    anchor = sliding_anchor(grams, window - gram + 1)
    place = np.flatnonzero(doc[: len(anchor)] == doc[window - 1 :])
    anchor, low, high = anchor_runs(anchor[place], place)
    if not len(anchor):
        return None
    return Words(
        anchor, low, high, window, gram,
        size=lambda low, high: ends[high + window - 1] - starts[low],
        gram=lambda at: grams[at] >> np.uint64(20),
        half=lambda at: hashed(at, (window + 1) // 2),
        whole=lambda at: hashed(at, window),
        text=text, starts=starts, ends=ends, doc=doc, first_word=first_word,
    )


def exchange(ids: list[int], texts: list[bytes], runs: Words, part: np.ndarray, keys: list[int] | None = None) -> list[tuple[int, bytes]]:
    """(part, blob) for every part that the block has anchors of."""
    import zstandard

    text, starts, ends, doc, first_word = runs.text, runs.starts, runs.ends, runs.doc, runs.first_word
    anchor, low, high, window, gram = runs.anchor, runs.low, runs.high, runs.window, runs.gram_width
    slices = [text[a:b] for a, b in zip(starts[low].tolist(), ends[high + window - 1].tolist())]
    index: dict[tuple, int] = {}
    at = (anchor - low).tolist()
    of = np.fromiter((index.setdefault(k, len(index)) for k in zip(slices, at)), np.int64, len(slices))
    order = np.argsort(of, kind="stable")
    head = np.flatnonzero(np.r_[True, np.diff(of[order]) > 0])
    rep = order[head]  # first place of each distinct context
    n_places = np.diff(np.r_[head, len(order)])
    part = part[rep]
    gram_at, gram_len = starts[anchor[rep]] - starts[low[rep]], ends[anchor[rep] + gram - 1] - starts[anchor[rep]]
    by_part = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(part[by_part].astype(np.int64)) != 0, True])
    doc_ids, keys = np.array(ids, np.int64), np.array(keys or [0] * len(ids), np.int64)
    pack = zstandard.ZstdCompressor(level=LEVEL)
    rows = []
    for a, b in zip(edges[:-1], edges[1:]):
        own = by_part[a:b]
        places = order[ranges(head[own], n_places[own])]
        content = (
            b"\n".join([slices[k] for k in rep[own].tolist()]),
            gram_at[own].astype(np.uint32),
            gram_len[own].astype(np.uint32),
            n_places[own].astype(np.uint32),
            np.diff(doc_ids[doc[anchor[places]]], prepend=0),
            (low[places] - first_word[doc[anchor[places]]]).astype(np.uint32),
            keys[doc[anchor[places]]] if keys.any() else None,
        )
        rows.append((int(part[own[0]]), pack.compress(pickle.dumps(content, 5))))
    return rows


def _same(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """Whether the byte ranges at a and b are equal."""
    out = length_a == length_b
    for at in range(0, len(a), 1 << 14):
        k = np.flatnonzero(out[at : at + (1 << 14)]) + at
        if len(k):
            n = length_a[k]
            equal = buf[ranges(a[k], n)] == buf[ranges(b[k], n)]
            out[k] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out


def deep_nodes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (indices into first, each the place of a suffix's first word) below internal nodes as deep as the
    window, ordered by node, and where each node begins among them."""
    words = range_hashes(buf, starts, ends)
    alive, node = np.arange(len(first)), np.zeros(len(first), np.int64)
    head = np.zeros(0, np.int64)
    for a, b in _steps(window):
        key = words[first[alive] + a]
        for d in range(a + 1, b):
            key = mix64(key + np.uint64(2 * d + 1) * words[first[alive] + d])
        order = np.lexsort((key, node))
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (node[order][1:] != node[order][:-1])] if len(order) else np.zeros(0, bool)
        node = np.cumsum(new)
        inner = np.bincount(node, minlength=1)[node] > 1
        alive, node = alive[order][inner], node[inner]
        if not len(alive):
            return alive, head
    head = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    # hashes agree below a node; the words themselves must
    at, length = starts[first[alive]], ends[first[alive] + window - 1] - starts[first[alive]]
    lead = np.repeat(head, np.diff(np.r_[head, len(node)]))
    if not _same(buf, at, at[lead], length, length[lead]).all():
        raw = buf.tobytes()
        exact: dict[bytes, int] = {}
        node = np.array([exact.setdefault(raw[s : s + n], len(exact)) for s, n in zip(at.tolist(), length.tolist())])
        order = np.argsort(node, kind="stable")
        alive, node = alive[order], node[order]
        inner = np.bincount(node)[node] > 1
        alive, node = alive[inner], node[inner]
        head = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else node
    return alive, head


def meet(blobs: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, first and last word (exclusive) and text_key of runs of windows that stand in a smaller document too."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    contexts, grams, counts, docs, lows, keys = [], [], [], [], [], []
    for blob in blobs:
        text, gram_at, gram_len, n, doc, low, key = pickle.loads(unpack.decompress(blob))
        own = text.split(b"\n")
        contexts += own
        grams += [c[a : a + k] for c, a, k in zip(own, gram_at.tolist(), gram_len.tolist())]
        counts.append(n)
        docs.append(np.cumsum(doc))
        lows.append(low)
        keys.append(np.zeros(len(low), np.int64) if key is None else key)
    count, doc, low, key = (np.concatenate(x).astype(np.int64) for x in (counts, docs, lows, keys))
    prefix: dict[bytes, int] = {}
    of = np.fromiter((prefix.setdefault(g, len(prefix)) for g in grams), np.int64, len(grams))
    live = np.flatnonzero((np.bincount(of, weights=count)[of] > 1))  # below its prefix it isn't alone
    none = np.zeros(0, np.int64)
    if not len(live):
        return none, none, none, none
    live = live[np.argsort(of[live], kind="stable")]
    place = ranges((np.cumsum(count) - count)[live], count[live])
    count, doc, low, key = count[live], doc[place], low[place], key[place]
    text = b"\n".join([contexts[k] for k in live.tolist()]) + b"\n"
    del contexts, grams
    buf = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(buf)
    word_of = np.searchsorted(starts, np.r_[0, np.flatnonzero(buf == 10) + 1])
    windows = np.diff(word_of) - window + 1
    context_of = np.repeat(np.arange(len(live)), windows)
    first = ranges(word_of[:-1], windows)
    smallest = np.minimum.reduceat(doc, np.cumsum(count) - count)
    least = smallest[context_of]
    below, head = deep_nodes(buf, starts, ends, first, window)
    if len(below):
        by_node = np.minimum.reduceat(least[below], head)
        least[below] = np.repeat(by_node, np.diff(np.r_[head, len(below)]))
    # every place of a context, window by window
    owner = np.repeat(np.arange(len(live)), count)
    n = windows[owner]
    flat = ranges((np.cumsum(windows) - windows)[owner], n)
    place = np.repeat(np.arange(len(owner)), n)
    gone = least[flat] < doc[place]
    at = low[place] + (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n))
    at, place = at[gone], place[gone]
    if not len(at):
        return none, none, none, none
    begin = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.r_[begin[1:] - 1, len(at) - 1]
    return doc[place[begin]], at[begin], at[last] + window, key[place[begin]]


def repeated_words(rows: DataFrame, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """doc_id, s, e, text_key: runs of words covered by windows of rows (keyed) that also start in a smaller doc_id."""
    return spans_of(rows, lambda texts: find(texts, window, min(GRAM, window)), exchange, lambda blobs: meet(blobs, window), BLOCK, parts)


def drop_repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by spaces) for every row of docs.

    Null and empty texts have no words; texts shorter than a window lose nothing; of equal texts the one of the smallest
    id stays; rows of one id, being of no smaller id, leave each other alone, and each loses what its own text repeats;
    rows of null id, which is neither smaller nor larger, are kept as they are and make no other row lose words; an empty table gives no rows; other columns are ignored.
    """

    def cut(text: bytes, s: np.ndarray, e: np.ndarray) -> tuple:
        words = text.split()
        n, removed = len(words), 0
        if len(s):
            s, e = merged(s, np.minimum(e, n))
            removed = int((e - s).sum())
            left, at = [], 0
            for a, b in zip(s.tolist(), e.tolist()):
                left += words[at:a]
                at = b
            words = left + words[at:]
        kept = b" ".join(words)
        return n, removed, hashlib.sha256(kept).hexdigest(), kept.decode()

    result = [("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("kept_sha256", pa.string(), "string"), ("kept", pa.string(), "string")]
    rows = keyed(docs, nulls=False)
    return with_spans(rows, repeated_words(rows, window), cut, result)
