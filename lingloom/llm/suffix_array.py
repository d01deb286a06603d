"""Substring dedup over bytes with a common-prefix-aware distributed merge sort.

Every block of documents sorts the suffixes that start at its anchors and sends each part of the cluster a run: suffixes in
order, front-coded (the length shared with the suffix before, and the rest). A part merges its runs with a loser tree that
carries, for every waiting suffix, the prefix length it is known to share with the last suffix put out: of two such
suffixes the one that shares more comes first, and only suffixes that share equally much are compared, from there on.
The merge puts out the suffix array of the part with its common-prefix lengths.

A suffix travels with the text to its left as far as windows over its anchor reach. Two anchors share a window of W bytes
that begins a bytes to the left of them where their left texts share a bytes and their right texts W - a. So below every
node of the suffix array's tree (an interval of depth D), a window that begins at least W - D to the left repeats where the
left texts of two suffixes of the node share that much, which neighbours in the order of the reversed left texts show.

One exchange serves a second, shorter window as well. The anchor of a long window is that of every short one in it that
holds the anchor, so the short windows need only the anchors that no long window has, with contexts of their own reach;
those of the long ones hold all else. Of the short windows only those count that another row holds, not the same one again.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import SPAN_SCHEMA, SPREAD, Runs, anchor_runs, keyed, sliding_anchor, spans_of, with_spans
from .common import merged, mix64, ranges

WINDOW = 400
#: Bytes of the shorter passages that are counted besides: those of more than 50 words, a word and its space taken as five bytes.
PASSAGE = 256
GRAM = 16
#: Bytes of contexts for a byte of text, about, with both windows.
SPREAD_BOTH = 4
#: Members of nodes that are compared at a time.
MEMBERS = 1 << 18


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A hash of buf[i : i + gram] for every i, by doubling."""
    pieces, width, out, done = buf.astype(np.uint64) + np.uint64(1), 1, None, 0
    n = len(buf) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while True:
        if gram & width:
            piece = pieces[done : done + n]
            out = piece.copy() if out is None else mix64(out * np.uint64(0x9E3779B97F4A7C15) + piece)
            done += width
        if width * 2 > gram:
            return mix64(out)
        pieces = mix64(pieces[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + pieces[width:])
        width *= 2


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, of which the first at bytes are known to be equal."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 16
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return at


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared lengths, rest lengths and rests of sorted suffixes."""
    shared, rests, last = [], [], b""
    for s in suffixes:
        k = common(last, s)
        shared.append(k)
        rests.append(s[k:])
        last = s
    return np.array(shared, np.uint32), np.array([len(r) for r in rests], np.uint32), b"".join(rests)


def decoded(run: tuple[np.ndarray, np.ndarray, bytes]) -> tuple[list[int], list[bytes]]:
    """Shared lengths and suffixes of a run."""
    shared, lengths, raw = run[0].tolist(), run[1].tolist(), run[2]
    out, last, at = [], b"", 0
    for k, n in zip(shared, lengths):
        last = last[:k] + raw[at : at + n]
        at += n
        out.append(last)
    return shared, out


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """(run, place) of all suffixes in order, and what each shares with the one before it.

    Each node of the tree keeps the loser of the match there and how much it shares with that match's winner. On the way
    from a put-out winner's leaf to the root, the challenger and every loser are known by what they share with that
    winner, so a match with unequal knowledge is decided without reading a byte.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * len(runs)
    losers: list[tuple[int, int]] = [(-1, 0)] * k  # run (-1: none left) and shared length
    head: list[bytes | None] = [r[1][0] if r[1] else None for r in runs] + [None] * (k - len(runs))

    def match(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and what it shares, loser and what it shares with the winner."""
        if a < 0 or head[a] is None:
            return b, lb, -1, 0
        if b < 0 or head[b] is None:
            return a, la, -1, 0
        if la != lb:
            return (a, la, b, lb) if la > lb else (b, lb, a, la)
        x, y = head[a], head[b]
        n = common(x, y, la)
        first = n == len(x) and (n < len(y) or a < b) or n < len(x) and n < len(y) and x[n] < y[n]
        return (a, la, b, n) if first else (b, lb, a, n)

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return (node - k, 0) if head[node - k] is not None else (-1, 0)
        (a, la), (b, lb) = build(2 * node), build(2 * node + 1)
        w, lw, losers[node], ln = (lambda m: (m[0], m[1], m[2], m[3]))(match(a, la, b, lb))
        losers[node] = (losers[node], ln)
        return w, lw

    winner, shared = build(1)
    order, lcp = [], []
    while winner >= 0 and head[winner] is not None:
        order.append((winner, place[winner]))
        lcp.append(shared)
        place[winner] += 1
        known, suffixes = runs[winner]
        at = place[winner]
        if at < len(suffixes):
            head[winner] = suffixes[at]
            shared = known[at]  # with the suffix just put out, its forerunner in the run
        else:
            head[winner] = None
            shared = 0
        node = (winner + k) // 2
        while node:
            run, common_with = losers[node]
            if run >= 0:
                winner, shared, run, common_with = match(winner, shared, run, common_with)
                losers[node] = (run, common_with)
            node //= 2
    return order, lcp


@dataclass
class Bytes(Runs):
    """Runs over bytes, with the block's text."""

    text: bytes = b""
    ends: np.ndarray | None = None
    doc: np.ndarray | None = None


def find(texts: list[bytes], window: int = WINDOW, gram: int = GRAM, short: int | None = None) -> Bytes | None:
    """The runs of a block's windows. With short, those of windows of short bytes at other anchors follow, for which high is
    moved so that high + window is where their last window ends; they can not be split."""
    import xxhash

    text = b"".join(texts)
    buf = np.frombuffer(text, np.uint8)
    if len(buf) < (short or window):
        return None
    ends = np.cumsum([len(t) for t in texts])
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    grams = gram_hashes(buf, gram)

    def placed(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        anchor = sliding_anchor(grams, width - gram + 1)
        place = np.flatnonzero(doc[: len(anchor)] == doc[width - 1 :])
        return anchor_runs(anchor[place], place)

    anchor, low, high = placed(window)
    if short:
        a, first, last = placed(short)
        new = ~np.isin(a, anchor)
        anchor, low, high = np.r_[anchor, a[new]], np.r_[low, first[new]], np.r_[high, last[new] + short - window]
    if not len(anchor):
        return None

    def hashed(at: np.ndarray, width: int) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(text[k : k + width]) for k in at.tolist()), np.uint64, len(at)) >> np.uint64(20)

    return Bytes(
        anchor, low, high, window, gram,
        size=lambda low, high: high + window - low,
        gram=lambda at: grams[at] >> np.uint64(20),
        half=lambda at: hashed(at, (window + 1) // 2),
        whole=lambda at: hashed(at, window),
        text=text, ends=ends, doc=doc,
    )


def exchange(ids: list[int], texts: list[bytes], runs: Bytes, part: np.ndarray, keys: list[int] | None = None) -> list[tuple[int, bytes]]:
    """(part, blob): the front-coded run of every part that the block has anchors of, with left texts and places."""
    import zstandard

    text, ends, doc, window = runs.text, runs.ends, runs.doc, runs.window
    anchor, low, high = runs.anchor, runs.low, runs.high
    found: dict[int, dict[tuple[bytes, bytes], list[int]]] = {}
    for k, (p, a, lo, hi) in enumerate(zip(part.tolist(), anchor.tolist(), low.tolist(), high.tolist())):
        found.setdefault(p, {}).setdefault((text[a : hi + window], text[lo:a]), []).append(k)
    begin, of_doc, doc_ids = ends - [len(t) for t in texts], doc[anchor], np.array(ids, np.int64)
    keys = np.array(keys or [0] * len(ids), np.int64)
    pack = zstandard.ZstdCompressor(level=3)
    rows = []
    for p, contexts in found.items():
        order = sorted(contexts)
        places = np.array([k for c in order for k in contexts[c]], np.int64)
        left = [c[1] for c in order]
        rows_here, row = np.unique(of_doc[places], return_inverse=True)
        content = (
            front_coded([c[0] for c in order]),
            np.array([len(x) for x in left], np.uint32),
            b"".join(left),
            np.array([len(contexts[c]) for c in order], np.uint32),
            row.astype(np.uint32),
            (low[places] - begin[of_doc[places]]).astype(np.uint32),
            doc_ids[rows_here],
            keys[rows_here],
        )
        rows.append((p, pack.compress(pickle.dumps(content, 5))))
    return rows


def tree_intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(depth, first, last exclusive) of every internal node of the tree over sorted suffixes, children before parents."""
    out, stack = [], []
    for i, depth in enumerate([*lcp[1:].tolist(), 0], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            out.append((d, first, i))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


def _rows(texts: list[bytes], width: int) -> np.ndarray:
    """Texts as rows of a matrix, ended by a value that differs for each."""
    out = np.full((len(texts), width + 1), -1, np.int16)
    lengths = np.array([len(t) for t in texts])
    cols = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(texts)), lengths), cols] = np.frombuffer(b"".join(texts), np.uint8)
    return out


def _left_common(rows: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What each of the reversed left texts a shares with the one of b beside it."""
    n = np.empty(len(a), np.int64)
    for at in range(0, len(a), 4096):
        differ = rows[a[at : at + 4096]] != rows[b[at : at + 4096]]
        differ[:, -1] = True
        n[at : at + 4096] = differ.argmax(1)
    return np.minimum(n, np.minimum(lengths[a], lengths[b]))


def most_of_others(n: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Most that each text shares with one of another owner (-1: there is none), from what each shares with the next one (-1:
    nothing to do with it)."""
    left, right = np.r_[-1, n], np.r_[n, -1]
    # running minima within texts of one owner in a row, which a lower step for each keeps apart
    step = (int(n.max(initial=0)) + 2) * np.cumsum(np.r_[False, owner[1:] != owner[:-1]])
    left = np.minimum.accumulate(left - step) + step
    right = np.minimum.accumulate((right + step)[::-1])[::-1] - step
    return np.maximum(left, right)


def _node_batches(nodes: np.ndarray, size: int = MEMBERS) -> Iterator[np.ndarray]:
    """Nodes (depth, first, last exclusive) in batches of about size members."""
    if len(nodes):
        batch = np.cumsum(nodes[:, 2] - nodes[:, 1]) // size
        yield from np.split(nodes, np.flatnonzero(np.diff(batch)) + 1)


def meet(blobs: list[bytes], window: int = WINDOW, short: int | None = None) -> tuple[np.ndarray, ...]:
    """doc_id, first and last byte (exclusive) and text_key of runs of windows that stand elsewhere too; with short, also
    whether a run is one of windows of short bytes that stand in another row (0 or 1)."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    runs, lefts_of, fields, n_rows, n_places = [], [], [], 0, 0
    for blob in blobs:
        coded, left_lengths, left, count, row, low, ids, keys = pickle.loads(unpack.decompress(blob))
        runs.append(decoded(coded))
        lefts_of.append([left[e - n : e] for e, n in zip(np.cumsum(left_lengths).tolist(), left_lengths.tolist())])
        first = np.cumsum(count, dtype=np.int64) - count
        # the row that holds a context, or -1 if several do
        least, most = np.minimum.reduceat(row, first), np.maximum.reduceat(row, first)
        owner = np.where(least == most, n_rows + least.astype(np.int64), -1)
        fields.append((count.astype(np.int64), first + n_places, owner, low.astype(np.int64), ids[row], keys[row]))
        n_rows, n_places = n_rows + len(ids), n_places + len(row)
    order, lcp = merge_runs(runs)
    lcp = np.array(lcp, np.int64)
    lefts = [lefts_of[r][i] for r, i in order]
    n_left, n_right = np.array([len(x) for x in lefts], np.int64), np.array([len(runs[r][1][i]) for r, i in order], np.int64)
    count, first, owner, low, ids, keys = (np.concatenate(x) for x in zip(*fields))
    begin = np.cumsum([0, *map(len, lefts_of)])
    place = np.array([begin[r] + i for r, i in order], np.int64)
    count, first, owner = count[place], first[place], owner[place]
    owner = np.where(owner < 0, -1 - np.arange(len(owner)), owner)
    # of window starts a to the left of the anchor, each context has those from window - n_right to n_left
    found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[], []]  # context, first and last byte in it
    for kind, whole in enumerate(((count > 1) & (n_left + n_right >= window), (owner < 0) & bool(short))):
        k = np.flatnonzero(whole)
        found[kind].append((k, np.zeros(len(k), np.int64), (n_left + n_right)[k]))

    def mark(kind: int, members: np.ndarray, depth: np.ndarray, most: np.ndarray, width: int) -> None:
        least = np.maximum(width - np.minimum(depth, n_right[members]), 0)
        hit = most >= least  # windows that begin most to least bytes to the left
        k = members[hit]
        found[kind].append((k, n_left[k] - most[hit], n_left[k] - least[hit] + width))

    width = short or window
    nodes = np.array(tree_intervals(lcp), np.int64).reshape(-1, 3)
    if len(nodes):
        longest = np.maximum.reduceat(np.r_[n_left, 0], nodes[:, 1:].ravel())[::2]
        nodes = nodes[nodes[:, 0] + longest >= width]
    used = np.zeros(len(order) + 1, np.int64)
    np.add.at(used, nodes[:, 1], 1)
    np.add.at(used, nodes[:, 2], -1)
    used = np.flatnonzero(np.cumsum(used) > 0)
    if len(used):
        reverse = [lefts[k][::-1] for k in used.tolist()]
        at = np.full(len(order), -1, np.int64)
        at[used] = np.arange(len(used))
        by_left = np.empty(len(used), np.int64)
        by_left[sorted(range(len(used)), key=reverse.__getitem__)] = np.arange(len(used))
        rows, lengths = _rows(reverse, int(max(map(len, reverse), default=0))), n_left[used]
    for batch in _node_batches(nodes):
        size = batch[:, 2] - batch[:, 1]
        members, node = at[ranges(batch[:, 1], size)], np.repeat(np.arange(len(batch)), size)
        able = lengths[members] >= width - batch[node, 0]
        members, node = members[able], node[able]
        by_node = np.argsort(node * len(used) + by_left[members])
        members, node = members[by_node], node[by_node]
        n = np.full(max(len(members) - 1, 0), -1, np.int64)
        beside = np.flatnonzero(node[1:] == node[:-1])
        n[beside] = _left_common(rows, lengths, members[beside], members[beside + 1])
        k, depth = used[members], batch[node, 0]
        if len(k):
            mark(0, k, depth, np.maximum(np.r_[-1, n], np.r_[n, -1]), window)
            if short:
                mark(1, k, depth, most_of_others(n, owner[k]), short)
    out = []
    step = int((n_left + n_right).max(initial=0)) + 2
    for kind in (0, 1) if short else (0,):
        k, s, e = (np.concatenate(x) for x in zip(*found[kind]))
        s, e = merged(k * step + s, k * step + e)
        k = s // step
        span, of = np.repeat(np.arange(len(k)), count[k]), ranges(first[k], count[k])
        s, e = s - k * step, e - k * step
        out.append((ids[of], low[of] + s[span], low[of] + e[span], keys[of], np.full(len(of), kind)))
    return tuple(np.concatenate(x) for x in zip(*out))[: 5 if short else 4]


def repeated_bytes(rows: DataFrame, window: int = WINDOW, parts: int | None = None, short: int | None = None) -> DataFrame:
    """doc_id, s, e, text_key: runs of bytes covered by strings of window bytes that stand twice or more in rows (keyed). With
    short, a column passage tells them (0) from runs covered by strings of short bytes that stand in two or more rows (1)."""
    if short and not min(GRAM, window) <= short <= window:
        raise ValueError(f"short has to lie between {min(GRAM, window)} and {window}")
    schema, spread = (SPAN_SCHEMA.append(pa.field("passage", pa.int64())), SPREAD_BOTH) if short else (SPAN_SCHEMA, SPREAD)
    return spans_of(
        rows, lambda texts: find(texts, window, min(GRAM, window), short), exchange, lambda blobs: meet(blobs, window, short),
        parts=parts, split=False, schema=schema, spread=spread,
    )


def drop_repeated_bytes(docs: DataFrame, window: int = WINDOW, short: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) for every row of docs.

    Null and empty texts have no bytes; texts shorter than a window lose nothing; all of several equal texts that are long
    enough go, as do repeats within one text; a repeated row is a copy like any other; rows of one id
    or of null id are rows like any other; an empty table gives no rows; other
    columns are ignored. With short, n_shared comes before kept: the bytes, removed or not, covered by strings of short
    bytes that stand in another row as well.
    """

    def cut(text: bytes, s: np.ndarray, e: np.ndarray, *passage: np.ndarray) -> tuple:
        n, more = len(text), ()
        if short:
            of_passage = passage[0] == 1
            a, b = merged(s[of_passage], np.minimum(e, n)[of_passage])
            s, e, more = s[~of_passage], e[~of_passage], (int((b - a).sum()),)
        s, e = merged(s, np.minimum(e, n))
        parts, at = [], 0
        for a, b in zip(s.tolist(), e.tolist()):
            parts.append(text[at:a])
            at = b
        kept = b"".join([*parts, text[at:]])
        return n, n - len(kept), len(s), hashlib.sha256(kept).hexdigest(), *more, kept

    result = [("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")]
    result += [("n_shared", pa.int64(), "long")] if short else []
    rows = keyed(docs, nulls=True)
    return with_spans(rows, repeated_bytes(rows, window, short=short), cut, [*result, ("kept", pa.binary(), "binary")], packed=True)
