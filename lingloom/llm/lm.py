"""Scores of whole documents by a language model that is trained where the documents are.

1. Blocks of documents are stored as ids into the block's own vocabulary.
2. Each word's training count is summed over all blocks by a shuffle of the vocabularies, dealt by word, and sent back to
   the blocks that have the word. Nothing but the TOP most frequent words and a few sums reaches the driver.
3. The recurrent model is trained in rounds: every task goes on from the shared parameters over the round's stretch of its
   blocks' training tokens, and the tasks' parameters are averaged. The stretches of all rounds make one whole pass.
4. Every block scores its documents from first to last token.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .anchors import blocks
from .common import ranges, stored, tasks

#: The token after a text's last word; no word holds a newline.
END = b"\n"
BLOCK = 12 << 20
ROUNDS = 3
#: Share of the training tokens that a round learns from; ROUNDS * SHARE passes over all of them.
SHARE = 1 / ROUNDS
#: Floats of the parameters in a row.
_PIECE = 4096

BLOCK_SCHEMA = "block long, docs binary, vocab binary, counts binary, tokens binary"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 5 == 1


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _packed(x) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, 5))


def _unpacked(b: bytes):
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks: document ids, lengths and groups; words; training counts by word and group; tokens."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    groups: list[int] = []

    def with_groups():
        for batch in batches:
            groups.extend(zlib.crc32((g or "").encode()) % gru.GROUPS for g in batch.column("group").to_pylist())
            yield batch

    for ids, texts in blocks(with_groups(), BLOCK, empty=True):
        vocabulary = _Vocabulary()
        tokens, lengths = [], []
        for t in texts:
            words = t.lower().split()
            words.append(END)
            tokens.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
            lengths.append(len(words))
        tokens, lengths = np.concatenate(tokens), np.array(lengths, np.int64)
        group, groups[: len(ids)] = np.array(groups[: len(ids)], np.int64), []
        held = np.array([held_out(i) for i in ids])
        learnt = np.repeat(~held, lengths)
        counts = np.bincount((tokens.astype(np.int64) * gru.GROUPS + np.repeat(group, lengths))[learnt], minlength=len(vocabulary) * gru.GROUPS)
        row = [number, _packed((ids, lengths, held)), _packed(list(vocabulary)), _packed(counts.reshape(-1, gru.GROUPS).astype(np.uint32)), _packed(tokens)]
        types = [pa.int64(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["block", "docs", "vocab", "counts", "tokens"])
        number += 1


def _counted(table: DataFrame, parts: int) -> DataFrame:
    """kind, a, b, blob. 0: the counts and groups of the words of part b that block a has, in its order; 1: of part b, counts
    and words by class; 2: a frequent word (blob), its count a and group b."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocab, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "vocab", "counts"))):
                words, counts = _unpacked(vocab), _unpacked(counts)
                part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
                order = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0, True])
                rows = [(int(part[order[a]]), block, _packed(([words[k] for k in order[a:b]], counts[order[a:b]]))) for a, b in zip(edges[:-1], edges[1:])]
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), (pa.int32(), pa.int64(), pa.binary()))], names=["part", "block", "blob"])

    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("blob", pa.binary())])

    def count(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        known = _Vocabulary()
        own = []
        total = np.zeros((1 << 12, gru.GROUPS), np.int64)
        for block, blob in zip(table["block"].to_pylist(), table["blob"].to_pylist()):
            words, counts = _unpacked(blob)
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            if len(known) > len(total):
                total = np.concatenate([total, np.zeros((len(known), gru.GROUPS), np.int64)])
            total[ids] += counts
            own.append((block, ids))
        total = total[: len(known)]
        n, group = total.sum(1), total.argmax(1)
        rows = [(0, block, part, _packed((n[ids], group[ids].astype(np.uint8)))) for block, ids in own]
        once = (n == 1).astype(np.int64)
        cell = once * gru.GROUPS + group
        seen = n > 0
        rows.append((1, 0, part, _packed((np.bincount(cell[seen], weights=n[seen], minlength=2 * gru.GROUPS), np.bincount(cell[seen], minlength=2 * gru.GROUPS)))))
        words = list(known)
        best = np.argsort(-n, kind="stable")[: gru.TOP]
        rows += [(2, int(n[k]), int(group[k]), words[k]) for k in best.tolist() if n[k] > 1]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    dealt = table.select("block", "vocab", "counts").mapInArrow(deal, "part int, block long, blob binary")
    return dealt.groupBy("part").applyInArrow(count, "kind int, a long, b long, blob binary")


def _sums(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts and words by class, over all parts; added up in tasks first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2 * gru.GROUPS))
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                total += np.array(_unpacked(blob))
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.reshape(-1).astype(np.int64))], names=["k", "v"])

    rows = counted.where("kind = 1").select("blob").mapInArrow(add, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(4 * gru.GROUPS, np.int64)
    for r in rows:
        out[r["k"]] = r["v"]
    return out.reshape(2, -1)


def _indexed(table: DataFrame, counted: DataFrame, parts: int, model: dict) -> DataFrame:
    """block, docs, codes (of the tokens), words (by token of the block's vocabulary: count, log share in its class), tokens."""
    top, sums, kinds = model["top"], model["sums"], model["kinds"]

    def index(own: pa.Table, counts: pa.Table) -> pa.Table:
        rows = []
        by_part = {b: _unpacked(x) for b, x in zip(counts["b"].to_pylist(), counts["blob"].to_pylist())}
        for block, docs, vocab, tokens in zip(*(own[c].to_pylist() for c in ("block", "docs", "vocab", "tokens"))):
            words = _unpacked(vocab)
            part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            there = sorted(by_part)
            n, group = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            n[order] = np.concatenate([by_part[b][0] for b in there])
            group[order] = np.concatenate([by_part[b][1] for b in there])
            cell = (n == 1) * gru.GROUPS + group
            code = np.where(n > 0, gru.TOP + cell, gru.UNSEEN)
            log = np.where(n > 0, np.log(n + 0.5) - np.log(sums[cell] + 0.5 * (kinds[cell] + 1)), 0.0)
            for k, w in enumerate(words):
                if n[k] >= model["least"] and w in top:
                    code[k], log[k] = top[w], 0.0
            rows.append((block, docs, _packed((code.astype(np.int16), n, log)), tokens))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "docs", "words", "tokens"])

    left = table.select("block", "docs", "vocab", "tokens").groupBy("block")
    right = counted.where("kind = 0").select(F.col("a").alias("block"), "b", "blob").groupBy("block")
    return left.cogroup(right).applyInArrow(index, "block long, docs binary, words binary, tokens binary")


def round_stretch(lengths: np.ndarray, round_no: int, share: float) -> list[tuple[int, int]]:
    """The token ranges, of documents laid end to end, that a round learns from: share of all tokens, from where the round
    before it ended, and from the first token again after the last."""
    total = int(lengths.sum())
    at, end = round(round_no * share * total), round((round_no + 1) * share * total)
    out = []
    while at < end:
        first = at % total
        n = min(end - at, total - first)
        out.append((first, first + n))
        at += n
    return out


def _trained(indexed: DataFrame, flat: np.ndarray, round_no: int, share: float) -> np.ndarray:
    """The mean of what the tasks make of the shared parameters, weighted by tokens."""
    shared = indexed.sparkSession.sparkContext.broadcast(flat)  # N_PARAMETERS floats

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, 0
        for batch in batches:
            for docs, words, tokens in zip(*(batch.column(c).to_pylist() for c in ("docs", "words", "tokens"))):
                _, lengths, held = _unpacked(docs)
                mine = np.flatnonzero(~held)
                if not len(mine):
                    continue
                mine = np.random.default_rng(11).permutation(mine)
                first = np.cumsum(lengths) - lengths
                n = lengths[mine]
                start = np.zeros(int(n.sum()), bool)
                start[np.cumsum(n) - n] = True
                place = ranges(first[mine], n)
                codes, tokens = _unpacked(words)[0], _unpacked(tokens)
                for a, b in round_stretch(n, round_no, share):
                    part = codes[tokens[place[a:b]]].astype(np.int64)
                    own = gru.train(own, part, start[a:b])
                    seen += len(part)
        if seen:
            pieces = [(own[k : k + _PIECE].astype(np.float64) * seen).tobytes() for k in range(0, len(own), _PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([seen] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], names=["piece", "n", "sum"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b) for b in table["sum"].to_pylist()], axis=0)
        return pa.table({"piece": table["piece"][:1].cast(pa.int32()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "sum": pa.array([total.tobytes()], pa.binary())})

    schema = "piece int, n long, sum binary"
    parts = indexed.select("docs", "words", "tokens").mapInArrow(learn, schema).withColumn("salt", F.spark_partition_id() % 64)
    summed = parts.groupBy("piece", "salt").applyInArrow(add, schema).groupBy("piece").applyInArrow(add, schema).collect()
    out = flat.copy()
    for r in summed:
        out[r["piece"] * _PIECE : (r["piece"] + 1) * _PIECE] = np.frombuffer(r["sum"]) / r["n"]
    return out


def score_documents(docs: DataFrame, group: str | None = "lang", rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text, and the
    column by which rarer words are put into classes, if one is given).

    Null and empty texts are the end token alone; a null id counts as the text "null" for the split; repeated rows count
    as often as they stand there; without training documents all words are unseen; an empty table gives no rows; other
    columns are ignored. group is looked at in training documents only.
    """
    spark = docs.sparkSession
    parts = tasks(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(group).cast("string") if group else F.lit("")).alias("group"))
    table = stored(text.mapInArrow(_block_rows, BLOCK_SCHEMA), "blocks")
    counted = stored(_counted(table, parts), "counts")
    sums, kinds = _sums(counted)
    train_tokens, n_words = int(sums.sum()), int(kinds.sum())
    frequent = counted.where("kind = 2").orderBy(F.desc("a"), "blob").limit(gru.TOP).collect()
    order = sorted(frequent, key=lambda r: (r["b"], -r["a"], bytes(r["blob"])))  # classes of one group, as far as it goes
    top = {bytes(r["blob"]): k for k, r in enumerate(order)}
    word_counts = np.zeros(gru.TOP)
    for k, r in enumerate(order):
        word_counts[k] = r["a"]
        sums[r["b"]] -= r["a"]
        kinds[r["b"]] -= 1
    class_counts = np.concatenate([word_counts.reshape(gru.OWN_CLASSES, -1).sum(1), sums])
    model = {"top": top, "sums": sums, "kinds": kinds, "least": min((r["a"] for r in frequent), default=1)}
    unseen = np.log(0.5) - np.log(sums[gru.GROUPS :] + 0.5 * (kinds[gru.GROUPS :] + 1))
    indexed = stored(_indexed(table, counted, parts, model), "indexed")
    flat = gru.initial(word_counts, class_counts)
    for k in range(rounds):
        flat = _trained(indexed, flat, k, share)
    shared = spark.sparkContext.broadcast(flat)
    scale = np.log10(train_tokens + 0.5 * (n_words + 1))
    types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, words, tokens in zip(*(batch.column(c).to_pylist() for c in ("docs", "words", "tokens"))):
                ids, lengths, held = _unpacked(docs)
                code, n, log = _unpacked(words)
                tokens = _unpacked(tokens)
                p = gru.score(shared.value, code.astype(np.int64)[tokens], lengths, unseen.astype(np.float32)).astype(np.float64) + log[tokens]
                at = np.cumsum(lengths) - lengths
                base = (np.log10(n + 0.5) - scale)[tokens]
                columns = [ids, held, lengths, np.add.reduceat((n > 0)[tokens].astype(np.int64), at), np.full(len(ids), train_tokens), np.add.reduceat(base, at), np.add.reduceat(p, at) / np.log(10)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return indexed.select("docs", "words", "tokens").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
