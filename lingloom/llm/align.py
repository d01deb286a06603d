"""Alignment of two tokenisations of the same texts.

Both vocabularies are applied to whole texts. Where both have a token that begins with a space at the same byte, which is
verified and not assumed, the text is cut: what lies between two such anchors is a window of ids of either side. Windows are
mostly single words and repeat, so a worker keeps their alignments by the tuple of ids: the groups between shared ends, the
number of links, and the pairs of ids linked. A document is put together from its windows.

How many documents link a pair is counted from the documents' distinct pairs, added up in each task before they are
shuffled. The most frequent pairs (a bounded number) are sent to every task; documents ask for the rare ones in a join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, stored
from .tokens import Coder, vocabulary

#: Text that is aligned at a time; a longer text is a block of its own.
BLOCK = 1 << 20
#: Entries, and bytes of their keys, of a worker's tables of pieces and windows; a full table starts anew.
ENTRIES, KEY_BYTES = 300_000, 24 << 20
#: Pairs that every task gets, and pairs that a task adds up before it passes them on.
FREQUENT, SUMMED = 1 << 21, 1 << 21
#: Links that are spelled out at a time.
STRETCH = 1 << 21
_PIECE = re.compile(rb" +[^ ]*")

_WORKERS: dict[tuple[str, str], Aligner] = {}


class PlainCoder(Coder):
    """Ids of texts by a byte-level vocabulary; added tokens are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = None


class PieceCoder:
    """Ids of texts by a sentencepiece model that puts a space before them. No piece of the model goes on behind a space, so
    a text's ids are those of its parts, each of which begins with a run of spaces; parts are kept with their ids. (Texts
    that hold the model's own sign for a space may get others; their ids never join to them, whatever they are.)"""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.get_piece_size())):
            raise ValueError("pieces with a space behind other characters are not supported")
        self.blank = [self.model.piece_to_id("▁")]
        self._forget()

    def _forget(self) -> None:
        self.entries: dict[bytes, int] = {}
        self.held = 0
        self.at, self.n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode_block(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that have their space before them already, and where each text's begin (with the end of the
        last's). An empty text, which has no space either, has none."""
        parts = [_PIECE.findall(r) for r in raw]
        flat = list(chain.from_iterable(parts))
        new = [p for p in dict.fromkeys(flat) if p not in self.entries]
        if new:
            found = self.model.encode([p[1:].decode() for p in new], num_threads=1)
            found = [ids if p != b" " else self.blank for p, ids in zip(new, found)]  # a space alone is at a text's end
            n = np.fromiter(map(len, found), np.int64, len(found))
            self.entries.update(zip(new, range(len(self.n), len(self.n) + len(new))))
            self.at = np.r_[self.at, len(self.ids) + np.cumsum(n) - n]
            self.n, self.ids = np.r_[self.n, n], np.r_[self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))]
            self.held += sum(map(len, new))
        entry = np.fromiter(map(self.entries.__getitem__, flat), np.int64, len(flat))
        n = self.n[entry]
        out = self.ids[ranges(self.at[entry], n)]
        ends = np.cumsum([0, *map(len, parts)])
        if len(self.entries) > ENTRIES or self.held > KEY_BYTES:
            self._forget()
        return out, np.r_[0, np.cumsum(n)][ends]


class TokenBytes:
    """The bytes of every id of a vocabulary."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in tokens], bool)

    def equal(self, ids: np.ndarray, begin: np.ndarray, buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Whether each text's ids join to its bytes."""
        lengths = self.n[ids]
        total = np.r_[0, np.cumsum(lengths)]
        same = total[begin[1:]] - total[begin[:-1]] == np.diff(edges)
        if same.all():
            off = np.flatnonzero(self.flat[ranges(self.at[ids], lengths)] != buf)
            same[np.searchsorted(edges, off, "right") - 1] = False
            return same
        for k in np.flatnonzero(same).tolist():
            own = ids[begin[k] : begin[k + 1]]
            same[k] = np.array_equal(self.flat[ranges(self.at[own], self.n[own])], buf[edges[k] : edges[k + 1]])
        return same


def byte_level_tokens(tokenizer) -> list[bytes]:
    """The bytes of a byte-level vocabulary's entries: printable Latin-1 characters are their own bytes, and the other bytes,
    in order, are the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    entries = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    return [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in entries]


def piece_tokens(model) -> list[bytes]:
    """The bytes of a sentencepiece model's pieces."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the values of each."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[new], np.add.reduceat(values, new) if len(new) else values


class Aligner:
    """Alignments of blocks of texts by two vocabularies, with a worker's table of windows."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.coder_a, self.coder_b = PlainCoder(path_a), PieceCoder(path_b)
        self.bytes_a, self.bytes_b = TokenBytes(byte_level_tokens(self.coder_a.tokenizer)), TokenBytes(piece_tokens(self.coder_b.model))
        self.size_b = len(self.bytes_b.n)
        self.decimals = TokenBytes([b"%d," % i for i in range(max(len(self.bytes_a.n), self.size_b))])
        self._forget()

    def _forget(self) -> None:
        self.entries: dict[tuple[bytes, bytes], int] = {}
        self.held = 0
        self.texts: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # groups, links, where its pairs begin, how many they are
        self.pairs = np.zeros((2, 0), np.int64)  # pair, links

    def _learn(self, keys: list[tuple[bytes, bytes]]) -> None:
        """Aligns windows that were not met before, all at once: as both sides' windows have the same bytes, one count of bytes
        runs through all of them."""
        a, b = (np.frombuffer(b"".join([k[side] for k in keys]), np.uint32).astype(np.int64) for side in (0, 1))
        end_a, end_b = np.cumsum(self.bytes_a.n[a]), np.cumsum(self.bytes_b.n[b])
        last_a = np.cumsum(np.fromiter((len(k[0]) // 4 for k in keys), np.int64, len(keys)))
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        many_a, many_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
        until = np.searchsorted(shared, end_a[last_a - 1], "right")  # each window's groups end here
        links = np.r_[0, np.cumsum(many_a * many_b)][until]
        # pairs of ids, a stretch of a's tokens at a time where groups are large
        window = np.repeat(np.arange(len(keys)), np.diff(last_a, prepend=0))
        times, first = many_b[group_a], np.cumsum(many_b) - many_b
        stretch = np.cumsum(times) // STRETCH
        pairs, n = [], []
        space = len(self.bytes_a.n) * self.size_b
        for low, high in zip(cuts := np.flatnonzero(np.diff(stretch, prepend=-1)), [*cuts[1:], len(a)]):
            own = slice(low, high)
            pair = np.repeat(window[own] * space + a[own] * self.size_b, times[own]) + b[ranges(first[group_a[own]], times[own])]
            pair, count = np.unique(pair, return_counts=True)
            pairs.append(pair)
            n.append(count)
        pair, n = summed(np.concatenate(pairs), np.concatenate(n))
        upto = np.searchsorted(pair, np.arange(1, len(keys) + 1) * space)
        # the groups as text: each id with a mark behind it
        place_a = np.arange(len(a)) + first[group_a]
        place_b = np.arange(len(b)) + np.cumsum(many_a)[group_b]
        ids, marks = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        marks[place_a[np.cumsum(many_a) - 1]], marks[place_b[np.cumsum(many_b) - 1]] = ord("|"), ord(";")
        size = self.decimals.n[ids]
        out = self.decimals.flat[ranges(self.decimals.at[ids], size)]
        ends = np.cumsum(size)
        out[ends - 1] = marks
        text, to = out.tobytes().decode("ascii"), ends[place_b[np.cumsum(many_b) - 1][until - 1]].tolist()
        self.entries.update(zip(keys, range(len(self.texts), len(self.texts) + len(keys))))
        self.texts += [text[i : j - 1] for i, j in zip([0, *to[:-1]], to)]
        rows = np.stack([np.diff(until, prepend=0), np.diff(links, prepend=0), self.pairs.shape[1] + np.r_[0, upto[:-1]], np.diff(upto, prepend=0)], axis=1)
        self.counts = np.concatenate([self.counts, rows])
        self.pairs = np.concatenate([self.pairs, np.stack([pair % space, n])], axis=1)
        self.held += 4 * len(ids) + len(text) + 16 * len(pair)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """For each text: a row of (n_a, n_b, n_groups, n_links), its groups, its distinct pairs in order (id of a times the
        size of b's vocabulary plus id of b), and the number of links of each."""
        raw = [(" " + t).encode() if t else b"" for t in texts]
        edges = np.cumsum([0, *map(len, raw)], dtype=np.int64)
        joined = b"".join(raw)
        buf = np.frombuffer(joined, np.uint8)
        ids_a, begin_a = self.coder_a.encode_block(joined, edges)
        ids_b, begin_b = self.coder_b.encode_block(raw)
        good = self.bytes_a.equal(ids_a, begin_a, buf, edges) & self.bytes_b.equal(ids_b, begin_b, buf, edges)
        n_a, n_b = np.where(good, np.diff(begin_a), 0), np.where(good, np.diff(begin_b), 0)
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, np.diff(begin_a))], ids_b[np.repeat(good, np.diff(begin_b))]
        size = np.where(good, np.diff(edges), 0)
        first = np.cumsum(size) - size  # where each text begins among the bytes of the good ones
        len_a, len_b = self.bytes_a.n[ids_a], self.bytes_b.n[ids_b]
        start_a, start_b = np.cumsum(len_a) - len_a, np.cumsum(len_b) - len_b
        spaced = np.zeros(int(size.sum()) + 1, bool)
        spaced[start_a[self.bytes_a.spaced[ids_a]]] = True
        anchors = start_b[self.bytes_b.spaced[ids_b]]
        anchors = anchors[spaced[anchors]]
        cut_a, cut_b = 4 * np.searchsorted(start_a, anchors), 4 * np.searchsorted(start_b, anchors)
        raw_a, raw_b = ids_a.astype(np.uint32).tobytes(), ids_b.astype(np.uint32).tobytes()
        low_a, low_b = cut_a.tolist(), cut_b.tolist()
        keys = [(raw_a[i:j], raw_b[k:m]) for i, j, k, m in zip(low_a, [*low_a[1:], len(raw_a)], low_b, [*low_b[1:], len(raw_b)])]
        if new := [k for k in dict.fromkeys(keys) if k not in self.entries]:
            self._learn(new)
        entry = np.fromiter(map(self.entries.__getitem__, keys), np.int64, len(keys))
        row = np.r_[np.searchsorted(anchors, first), len(anchors)]  # each text's first window
        of = np.repeat(np.arange(len(texts)), np.diff(row))
        groups = [";".join([self.texts[e] for e in entry[i:j].tolist()]) for i, j in zip(row[:-1].tolist(), row[1:].tolist())]
        counts = self.counts[entry]
        total = np.zeros((len(entry) + 1, 2), np.int64)
        np.cumsum(counts[:, :2], axis=0, out=total[1:])
        sums = total[row[1:]] - total[row[:-1]]
        pair, links = self.pairs[:, ranges(counts[:, 2], counts[:, 3])]
        space = len(self.bytes_a.n) * self.size_b
        pair = pair + np.repeat(of, counts[:, 3]) * space
        pair, links = summed(pair, links)
        cut = np.searchsorted(pair, np.arange(1, len(texts)) * space)
        if len(self.entries) > ENTRIES or self.held > 4 * KEY_BYTES:
            self._forget()
        return np.c_[n_a, n_b, sums], groups, np.split(pair % space, cut), np.split(links, cut)


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[path_a, path_b] = Aligner(path_a, path_b)
    return _WORKERS[path_a, path_b]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs binary, links binary"


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
    """A record batch in blocks of text."""
    texts = batch.column("text").to_pylist()
    low = size = 0
    for k, t in enumerate(texts):
        if k > low and size + len(t or "") > BLOCK:
            yield batch.slice(low, k - low), texts[low:k]
            low, size = k, 0
        size += len(t or "")
    if low < len(texts):
        yield batch.slice(low), texts[low:]


def aligned(docs: DataFrame, path_a: str, path_b: str, keep: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (null unless keep is set), pairs and links (64-bit integers
    in bytes: the document's distinct pairs in order, id of a times the size of b's vocabulary plus id of b, and how many
    links each has) for every row of docs (doc_id, text).

    A text that is null or empty, or that the ids of either side do not join to, has no tokens: zeros, and '' for groups.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(path_a, path_b)
        for batch in batches:
            for part, texts in _blocks(batch):
                counts, groups, pairs, links = one.align(texts)
                columns = [part.column("doc_id"), *(pa.array(counts[:, k]) for k in range(4))]
                columns.append(pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()))
                columns.append(pa.array(groups if keep else [None] * len(groups), pa.string()))
                columns += [pa.array([x.astype("<i8").tobytes() for x in own], pa.binary()) for own in (pairs, links)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_COUNTS, "groups_sha256", "groups", "pairs", "links"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, _OUT)


def pair_counts(documents: DataFrame) -> DataFrame:
    """pair, n: how many rows of documents (pairs, as aligned() gives them) hold each pair. Tasks add up what they read and
    pass it on whenever it is SUMMED pairs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def meet() -> None:
            nonlocal kept, counts, waiting, size
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            both, place = np.unique(np.concatenate([kept, new]), return_inverse=True)
            kept, counts = both, np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)
            waiting, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kept), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            waiting += [np.frombuffer(b, "<i8") for b in batch.column("pairs").to_pylist()]
            size += sum(map(len, waiting[-batch.num_rows :])) if batch.num_rows else 0
            if size >= SUMMED:
                meet()
                if len(kept) >= SUMMED:
                    yield out()
                    kept, counts = kept[:0], counts[:0]
        if waiting:
            meet()
        if len(kept):
            yield out()

    return documents.select("pairs").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokenizers(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, keep: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs (doc_id, text); with keep
    also groups, the alignment itself as 'a1,a2|b1;a3|b2,b3'.

    A pair's count is the number of rows that hold it linked; n_best: links whose count is the highest of their id of a;
    count_sum: the sum of the counts over all links. Rows of null, empty or unfaithful texts have zeros and ''; null ids,
    repeated ids and repeated rows stay rows of their own; other columns are ignored; an empty table gives no rows.
    """
    path_a, path_b = path_a or vocabulary("byte_bpe_50k.json"), path_b or vocabulary("piece_bpe_32k.model")
    spark = docs.sparkSession
    table = stored(aligned(docs, path_a, path_b, keep).withColumn("row_key", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(table), "pairs")
    size_b = len(aligner(path_a, path_b).bytes_b.n)
    best_rows = counts.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(F.max("n").alias("n")).collect()  # one an id of a vocabulary
    best = np.zeros(max((r["a"] for r in best_rows), default=0) + 1, np.int64)
    for r in best_rows:
        best[r["a"]] = r["n"]
    # the frequent pairs: counts from a power of two on, as many as fit
    powers = {r["p"]: r["c"] for r in counts.groupBy((F.length(F.bin("n")) - 1).alias("p")).agg(F.count("*").alias("c")).collect()}
    least, room = 64, frequent
    while least > 0 and room >= powers.get(least - 1, 0):
        least -= 1
        room -= powers.get(least, 0)
    known = counts.where(F.col("n") >= F.lit(float(2**least))).toArrow() if sum(c for p, c in powers.items() if p >= least) else None
    keys = known.column("pair").to_numpy() if known is not None else np.zeros(0, np.int64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], known.column("n").to_numpy()[order] if known is not None else keys, best))

    def found(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs, links and row of all pairs of a batch; the count of the frequent ones, and which these are."""
        own = [np.frombuffer(b, "<i8") for b in batch.column("pairs").to_pylist()]
        links = [np.frombuffer(b, "<i8") for b in batch.column("links").to_pylist()]
        n = np.fromiter(map(len, own), np.int64, len(own))
        pair, link = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (own, links))
        have, count, _ = shared.value
        place = np.searchsorted(have, pair)
        held = place < len(have)
        held[held] = have[place[held]] == pair[held]
        value = np.zeros(len(pair), np.int64)
        value[held] = count[place[held]]
        return pair, link, np.repeat(np.arange(len(own)), n), value, held

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, link, row, value, held = found(batch)
            top = held & (value == shared.value[2][pair // size_b])
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row[top], link[top])
            np.add.at(sums[1], row, link * value)
            names = ["row_key", "doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256", "groups"]
            columns = {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
            yield pa.RecordBatch.from_arrays([columns[c] if c in columns else batch.column(c) for c in names], names=names)

    schema = "row_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    out = table.mapInArrow(add, schema)
    if least > 0 and any(p < least for p in powers):

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pair, link, row, _, held = found(batch)
                keys = batch.column("row_key").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(x[~held]) for x in (keys, pair, link)], names=["row_key", "pair", "link"])

        tops = F.broadcast(spark.createDataFrame([(int(r["a"]), int(r["n"])) for r in best_rows], "a long, top long"))
        asked = table.select("row_key", "pairs", "links").mapInArrow(rare, "row_key long, pair long, link long")
        met = asked.join(counts.where(F.col("n") < F.lit(float(2**least))), "pair").withColumn("a", F.floor(F.col("pair") / size_b)).join(tops, "a")
        more = met.groupBy("row_key").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("link")).otherwise(0)).alias("more_best"), F.sum(F.col("link") * F.col("n")).alias("more_sum"))
        out = out.join(more, "row_key", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return out.select("doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256", *(["groups"] if keep else []))
