"""Packing texts into batches in order, with a book spread over many tasks.

A batch is filled greedily, so where one begins depends on all before it in its book. Rows are cut into chunks by ranges of
their order. With sums over a book's rows known, a batch that begins at one row says by a binary search where the next one
begins; in a chunk this is followed to its last batch, whatever row the first one may begin at. What leaves a chunk is a
threshold that the sums have to pass, and there are few: those of the rows within a batch's length of the chunk's end. So the
chunks form a small graph of (chunk, threshold), along which each book's way is found by doubling: in every round, joins
carry it twice as far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Rows of a chunk, about; a row is its length.
CHUNK_ROWS = 1 << 20
#: Threshold of a batch that begins with the first row of a chunk, whatever its length.
FIRST = -1


def batch_numbers(lengths: list[int], limit: int, sep: int, count_first: bool) -> list[int]:
    """Greedy batches in order. The separator counts between items, or with count_first once for every item."""
    out, batch, size, n = [], 0, 0, 0
    for k in lengths:
        add = k + (sep if count_first or n else 0)
        if n and size + add > limit:
            batch, size, n = batch + 1, 0, 0
            add = k + (sep if count_first else 0)
        size, n = size + add, n + 1
        out.append(batch)
    return out


class Chunk:
    """Rows of a book in order: the sum of lengths and separators up to each, and for a batch that begins at each row, what
    the sum may reach (room) and the row at which the next batch begins (after; beyond the last where it is in a later
    chunk)."""

    def __init__(self, sizes: np.ndarray, base: int, limit: int, sep: int, count_first: bool) -> None:
        steps = sizes.astype(np.int64) + sep
        self.upto = base + np.cumsum(steps)
        self.room = self.upto - steps + limit + (0 if count_first else sep)
        self.after = np.maximum(np.searchsorted(self.upto, self.room, "right"), np.arange(1, len(sizes) + 1))

    def leaving(self, row: int) -> int:
        """The threshold that the next chunks get from a last batch that begins at row."""
        return FIRST if self.upto[-1] > self.room[row] else int(self.room[row])

    def first(self, threshold: int) -> int:
        return 0 if threshold == FIRST else int(np.searchsorted(self.upto, threshold, "right"))

    def starts(self, threshold: int) -> list[int]:
        """The rows at which batches begin, once the sums have passed threshold."""
        out, at = [], self.first(threshold)
        while at < len(self.upto):
            out.append(at)
            at = int(self.after[at])
        return out


def _in_order(g: pd.DataFrame, order: str) -> pd.DataFrame:
    return g.sort_values([order, "size"], kind="stable")


def _chunked(df: DataFrame, by: str, order: str, text: str, sep: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Lengths with the chunk that each belongs to, and chunks: chunk, book, part (its place), base (the sum before it), upto (the
    sum at its end), following (the next chunk of the book)."""
    lengths = df.select(F.col(by).alias("book"), F.col(order).alias("place"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("size"))
    parts = max(1, -(-lengths.count() // rows))
    placed = stored(lengths.repartitionByRange(parts, "book", "place", "size").withColumn("part", F.spark_partition_id()), "lengths")
    sums = placed.groupBy("book", "part").agg(F.sum(F.col("size") + sep).alias("step")).withColumn("chunk", F.monotonically_increasing_id())
    sums = stored(sums, "chunks")  # written, so that numbers never change
    along = Window.partitionBy("book").orderBy("part")
    chunks = sums.withColumn("upto", F.sum("step").over(along)).withColumn("following", F.lead("chunk").over(along))
    chunks = chunks.select("chunk", "book", "part", (F.col("upto") - F.col("step")).alias("base"), "upto", "following")
    own = chunks.select(F.col("book").alias("own"), F.col("part").alias("own_part"), "chunk", "base")
    rows_of = placed.join(own, F.col("book").eqNullSafe(F.col("own")) & (F.col("part") == F.col("own_part"))).select("chunk", "base", "book", "place", "size")
    return stored(rows_of, "lengths"), stored(chunks, "chunks")


def _links(rows: DataFrame, chunks: DataFrame, limit: int, sep: int, count_first: bool) -> DataFrame:
    """chunk, threshold, batches, to_chunk, to_threshold: from every threshold with which a chunk may be entered, how many batches
    begin in it, and how the next chunk is entered then (null: the book ends)."""

    def leave(g: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(_in_order(g, "place")["size"].to_numpy(), int(g["base"].iloc[0]), limit, sep, count_first)
        out = sorted({c.leaving(r) for r in np.flatnonzero(c.after >= len(c.upto)).tolist()})
        return pd.DataFrame({"chunk": g["chunk"].iloc[0], "threshold": out})

    leaving = rows.select("chunk", "base", "place", "size").groupBy("chunk").applyInPandas(leave, "chunk long, threshold long")
    leaving = leaving.join(chunks.select("chunk", "book", "following", F.col("upto").alias("value")), "chunk")
    at_once = leaving.where(F.col("threshold") == FIRST).select("chunk", "threshold", F.col("following").alias("to_chunk"))
    # a threshold is passed in the last chunk that begins at or below it: found in one walk over a book's chunks and thresholds
    marks = chunks.select("book", F.col("base").alias("value"), F.lit(0).alias("kind"), "part", F.col("chunk").alias("to_chunk"), F.col("upto").alias("until"), F.lit(None).cast("long").alias("chunk"))
    asked = leaving.where(F.col("threshold") != FIRST).select("book", F.col("threshold").alias("value"), F.lit(1).alias("kind"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("to_chunk"), F.lit(None).cast("long").alias("until"), "chunk")
    walk = Window.partitionBy("book").orderBy("value", "kind", "part").rowsBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(asked).select("chunk", "value", "kind", F.last("to_chunk", True).over(walk).alias("to_chunk"), F.last("until", True).over(walk).alias("until"))
    later = met.where("kind = 1").select("chunk", F.col("value").alias("threshold"), F.when(F.col("value") < F.col("until"), F.col("to_chunk")).alias("to_chunk"))
    passed = stored(at_once.unionByName(later), "passed")
    begin = chunks.groupBy("book").agg(F.min_by("chunk", "part").alias("chunk")).select("chunk", F.lit(FIRST).cast("long").alias("threshold"))
    entered = passed.where("to_chunk IS NOT NULL").select(F.col("to_chunk").alias("chunk"), "threshold").unionByName(begin).distinct()

    def through(g: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(g) and len(entries):
            c = Chunk(_in_order(g, "place")["size"].to_numpy(), int(g["base"].iloc[0]), limit, sep, count_first)
            # from the last row back: how many batches begin from each row on, and where the last one does
            n, end = np.ones(len(c.upto), np.int64), np.arange(len(c.upto))
            after = c.after.tolist()
            for r in range(len(after) - 1, -1, -1):
                if after[r] < len(after):
                    n[r], end[r] = n[after[r]] + 1, end[after[r]]
            for t in entries["threshold"].tolist():
                row = c.first(t)
                out.append((int(g["chunk"].iloc[0]), t, int(n[row]), c.leaving(int(end[row]))))
        return pd.DataFrame(out, columns=["chunk", "threshold", "batches", "leaves"])

    walked = rows.select("chunk", "base", "place", "size").groupBy("chunk").cogroup(entered.groupBy("chunk")).applyInPandas(through, "chunk long, threshold long, batches long, leaves long")
    nexts = passed.select(F.col("chunk").alias("from_chunk"), F.col("threshold").alias("leaves"), "to_chunk")
    joined = walked.join(nexts, (F.col("chunk") == F.col("from_chunk")) & (walked["leaves"] == nexts["leaves"]), "left")
    return stored(joined.select("chunk", "threshold", "batches", "to_chunk", F.when(F.col("to_chunk").isNotNull(), walked["leaves"]).alias("to_threshold")), "links")


def _ways(links: DataFrame, way: DataFrame, most: int) -> DataFrame:
    """chunk, threshold, before: the chunks that each book's way goes through, how it enters them, and how many batches begin
    before; way has its beginning, most is the longest possible. Round k carries the way and the links over 2 ** k chunks."""
    jump, reach = links, 1
    while reach < most:
        j = jump.where("to_chunk IS NOT NULL")
        further = way.join(j, ["chunk", "threshold"]).select(F.col("to_chunk").alias("chunk"), F.col("to_threshold").alias("threshold"), (F.col("before") + F.col("batches")).alias("before"))
        way, reach = stored(way.unionByName(further), "way"), 2 * reach
        if reach < most:
            nexts = jump.select(F.col("chunk").alias("to_chunk"), F.col("threshold").alias("to_threshold"), F.col("batches").alias("more"), F.col("to_chunk").alias("c"), F.col("to_threshold").alias("t"))
            jump = stored(j.join(nexts, ["to_chunk", "to_threshold"]).select("chunk", "threshold", (F.col("batches") + F.col("more")).alias("batches"), F.col("c").alias("to_chunk"), F.col("t").alias("to_threshold")), "links")
    return way


def pack_batches(df: DataFrame, limit: int = 1800, sep: int = 3, count_first: bool = False, by: str = "book_id", order: str = "seg_pos", text: str = "text", rows: int = CHUNK_ROWS) -> DataFrame:
    """by, order, batch_no of every row of df: batches of up to limit characters in order of a book's rows, separators of sep
    characters counted between texts or, with count_first, once for every text; a longer text is a batch of its own. Null
    texts are empty; rows of one place go by length; a null book is a book. A chunk holds about rows rows."""
    lengths, chunks = _chunked(df, by, order, text, sep, rows)
    begin = chunks.groupBy("book").agg(F.min_by("chunk", "part").alias("chunk"))
    way = begin.select("chunk", F.lit(FIRST).cast("long").alias("threshold"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("standing"))
    most = chunks.groupBy("book").count().agg(F.max("count")).first()[0] or 0
    if most > 1:  # some book lies in several chunks
        links = _links(lengths, chunks, limit, sep, count_first)
        way = _ways(links, stored(way.drop("standing"), "way"), most)
        # a chunk in which no batch begins belongs to the last one before it
        until = way.join(links, ["chunk", "threshold"]).select("chunk", "threshold", "before", (F.col("before") + F.col("batches") - 1).alias("last"))
        along = Window.partitionBy("book").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        way = chunks.select("chunk", "book", "part").join(until, "chunk", "left").select("chunk", "threshold", "before", F.last("last", True).over(along).alias("standing"))

    def number(g: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        g = _in_order(g, "place")
        out = g[["book", "place"]]
        if not len(g):
            return out.assign(batch_no=pd.array([], "int32"))
        way = entries.iloc[0]
        if pd.isna(way["before"]):
            return out.assign(batch_no=np.int32(int(way["standing"])))
        c = Chunk(g["size"].to_numpy(), int(g["base"].iloc[0]), limit, sep, count_first)
        begins = np.zeros(len(g), np.int64)
        begins[c.starts(int(way["threshold"]))] = 1
        return out.assign(batch_no=(int(way["before"]) - 1 + np.cumsum(begins)).astype(np.int32))

    kind = dict(lengths.dtypes)
    both = lengths.groupBy("chunk").cogroup(way.select(F.col("chunk").alias("chunk"), "threshold", "before", "standing").groupBy("chunk"))
    numbered = both.applyInPandas(number, f"book {kind['book']}, place {kind['place']}, batch_no int")
    return numbered.select(F.col("book").alias(by), F.col("place").alias(order), "batch_no")
