"""N-gram Jaccard join by a size-aware heavy-light scheme.

Documents with the same shingle set are one set. Two sets A and B, |A| <= |B|, are similar at 0.9 only where they share at
least t = ceil(0.9 |B|) shingles:

- light: a small set enumerates its subsets of each size t that a partner could ask for, and similar sets meet in an equal
  subset; a set of n shingles has few of them as long as n - t is 0 or 1;
- heavy: a large set enters the inverted lists of the first n - ceil(0.9 n) + 1 of its shingles, rare ones first, and
  similar sets meet in a list; how often a shingle is repeated is kept in a sketch of fixed size.

The size that divides the two is where the number of subsets would exceed what the lists cost. Sets just below it do both.

Lists are looked at in blocks of bounded size. Pairs are filtered by sizes, places in the sets' order and a lower bound on
their difference (the parities of shingles by hash bucket). Of those that are let through, a spanning forest of each block is
compared exactly, and components are contracted. Where one of those comparisons fails, all pairs across components that the
filters let through in the lists that still hold several are compared as well. No other pairs are ever rows of a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import blocks
from .common import mix64, range_hashes, stored, word_bounds
from .graph import components, joined_components

#: Words of a shingle, and similar: DEN * intersection >= NUM * union, unless other values are asked for.
SHINGLE = 3
NUM, DEN = 90, 100
#: Counters of the sketch of repeated shingles, 4 bytes each, whatever the input.
COUNTERS = 1 << 20
#: Bits of the filter of set ids that keeps other documents out of a shuffle; set ids that it lets through are checked.
FILTER_BITS = 1 << 23
#: The dividing size is looked for below this.
LARGEST_LIGHT = 40
_PIECE = 1 << 14
#: Places where a task marks the shingles that it has met, a byte each.
SEEN = 1 << 24
#: Text of a block of documents.
BLOCK = 2 << 20
#: Sets of a list that meet in memory at a time, on each side.
LIST_BLOCK = 512


def required(n: int, num: int = NUM, den: int = DEN) -> int:
    """Shingles that a set of n shares with any similar set of its size or less."""
    return -(-num * n // den)


@lru_cache(1 << 16)
def overlap(a: int, b: int, num: int = NUM, den: int = DEN) -> int:
    """Shingles that similar sets of a and b share."""
    return -(-num * (a + b) // (num + den))


def subset_sizes(n: int, num: int = NUM, den: int = DEN) -> list[int]:
    """Sizes of subsets in which a set of n can meet a similar one: its own, and those of larger partners."""
    return sorted({t for b in range(n, den * n // num + 1) if (t := required(b, num, den)) <= n})


def n_subsets(n: int, num: int = NUM, den: int = DEN) -> int:
    return sum(math.comb(n, t) for t in subset_sizes(n, num, den))


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - required(n, num, den) + 1


def dividing_size(histogram: dict[int, int], list_cost: float = 4.0, num: int = NUM, den: int = DEN) -> int:
    """The largest size up to which subsets are cheaper than list entries, of which each costs list_cost times as much
    (it meets sets that are not similar); histogram: size, number of sets."""
    best, total, least = 0, 0.0, 0.0
    for n in range(1, LARGEST_LIGHT + 1):
        total += histogram.get(n, 1) * (n_subsets(n, num, den) - list_cost * prefix_length(n, num, den))
        if total <= least:
            best, least = n, total
    return best


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of every text's word shingles; lower case for A-Z; fewer words than a shingle: one of
    all words; no words: none."""
    plain = [b" ".join(t.lower().split()) for t in texts]
    buf = np.frombuffer(b"\n".join(plain) + b"\n", np.uint8)
    starts, ends = word_bounds(buf)
    doc_end = np.cumsum([len(p) + 1 for p in plain])
    edges = np.searchsorted(starts, np.r_[0, doc_end])
    words = range_hashes(buf, starts, ends)
    n = max(0, len(words) - shingle + 1)
    grams = words[:n].copy()
    for k in range(1, shingle):
        grams = mix64(grams + np.uint64(2 * k + 1) * words[k : n + k])
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(values: np.ndarray) -> int:
    """A 64-bit id of a set, as a signed number."""
    h = mix64(values ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(values))
    return int(mix64(np.array([h], np.uint64)).view(np.int64)[0])


def parity_sketch(values: np.ndarray) -> bytes:
    """A bit a bucket: whether an odd number of the shingles fall there. Halves can be folded onto each other."""
    bits = max(64, 2 << max(0, len(values) - 1).bit_length())
    odd = (np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


class Sketched:
    """A set's size and sketch, and the sketch's foldings as numbers."""

    __slots__ = ("n", "width", "folded")

    def __init__(self, n: int, sketch: bytes) -> None:
        self.n, self.width = n, len(sketch)
        self.folded = {self.width: int.from_bytes(sketch, "little")}

    def at(self, width: int) -> int:
        if width not in self.folded:
            wide = self.at(2 * width)
            self.folded[width] = (wide >> 8 * width) ^ (wide & (1 << 8 * width) - 1)
        return self.folded[width]

    def may_be_similar(self, other: Sketched, num: int = NUM, den: int = DEN) -> bool:
        """False only for sets that are not similar."""
        if den * min(self.n, other.n) < num * max(self.n, other.n):
            return False
        width = min(self.width, other.width)
        return (self.at(width) ^ other.at(width)).bit_count() <= self.n + other.n - 2 * overlap(self.n, other.n, num, den)


def _table(columns: list, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """One row a document with text: doc_id, n, sid, sketch; and rows of doc_id null: the counters of a task in pieces
    (n: the number of the piece). A task counts the shingles that it has met before, in another set."""
    types, names = [pa.int64(), pa.int64(), pa.int64(), pa.binary()], ["doc_id", "n", "sid", "sketch"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counters, seen = np.zeros(COUNTERS, np.uint32), np.zeros(SEEN, bool)
        for ids, texts in blocks(batches, BLOCK):
            sets = shingle_sets(texts, shingle)
            known: dict[int, bytes] = {}
            sids = [set_id(s) for s in sets]
            sketches = []
            for s, i in zip(sets, sids):
                if i not in known:
                    known[i] = parity_sketch(s)
                sketches.append(known[i])
            first = list({i: s for i, s in zip(sids, sets)}.values())
            values = np.sort(np.concatenate(first)) if first else np.zeros(0, np.uint64)
            repeats = np.r_[False, values[1:] == values[:-1]]
            place = (values >> np.uint64(20) & np.uint64(SEEN - 1)).astype(np.int64)
            again = values[repeats | seen[place]]
            seen[place] = True
            counters += np.bincount((again & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            yield _table([ids, [len(s) for s in sets], sids, sketches], types, names)
        pack = zstandard.ZstdCompressor(level=1)
        pieces = [pack.compress(counters[k : k + _PIECE].tobytes()) for k in range(0, COUNTERS, _PIECE)] if counters.any() else []
        yield _table([[None] * len(pieces), list(range(len(pieces))), [None] * len(pieces), pieces], types, names)

    return docs.mapInArrow(describe, "doc_id long, n long, sid long, sketch binary")


def _counters(described: DataFrame) -> np.ndarray:
    """The summed counters: COUNTERS numbers, whatever the input."""

    def add(table: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        total = sum(np.frombuffer(unpack.decompress(b), np.uint32).astype(np.uint64) for b in table["sketch"].to_pylist())
        return pa.table({"n": table["n"][:1].cast(pa.int64()), "sketch": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    rows = described.where("doc_id IS NULL").select("n", "sketch").groupBy("n").applyInArrow(add, "n long, sketch binary").collect()
    out = np.zeros(COUNTERS, np.uint32)
    for r in rows:
        out[r["n"] * _PIECE : (r["n"] + 1) * _PIECE] = np.frombuffer(r["sketch"], np.uint32)
    return out


def _keys(docs: DataFrame, divide: int, counters: np.ndarray, shingle: int, num: int, den: int) -> DataFrame:
    """key, sid, n, pos: the subsets and the list entries of every set, with their place in the set's order (0 of subsets),
    once for a block of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)  # COUNTERS * 4 bytes
    both_from = required(divide + 1, num, den)
    types, names = [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["key", "sid", "n", "pos"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for _, texts in blocks(batches, BLOCK):
            keys, sids, sizes, places = [], [], [], []
            seen = set()
            for s in shingle_sets(texts, shingle):
                n = len(s)
                if not n or (i := set_id(s)) in seen:
                    continue
                seen.add(i)
                own = []
                if n <= divide:
                    mixed = mix64(s)
                    total = mixed.sum(dtype=np.uint64)
                    for t in subset_sizes(n, num, den):
                        away = np.array([mixed[list(c)].sum(dtype=np.uint64) for c in combinations(range(n), n - t)], np.uint64)
                        own.append(mix64(total - away + np.uint64(t << 1 | 1)))
                if n > divide or n >= both_from:
                    order = np.lexsort((s, counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]))
                    own.append(s[order[: prefix_length(n, num, den)]])
                place = np.zeros(sum(map(len, own)), np.int32)
                if n > divide or n >= both_from:
                    place[-len(own[-1]) :] = np.arange(len(own[-1]))
                own = np.concatenate(own)
                places.append(place)
                keys.append(own)
                sids.append(np.full(len(own), i, np.int64))
                sizes.append(np.full(len(own), n, np.int32))
            if keys:
                yield _table([np.concatenate(keys).view(np.int64), np.concatenate(sids), np.concatenate(sizes), np.concatenate(places)], types, names)

    return docs.mapInArrow(emit, "key long, sid long, n int, pos int")


def _sets_of(docs: DataFrame, owners: DataFrame, sids: DataFrame, shingle: int) -> DataFrame:
    """sid, members (sorted hashes, as bytes) of the given sets. owners: a document of every set, of which a filter of fixed
    size picks those to read; what it lets through besides is dropped by the join."""
    needed = owners.join(sids, "sid", "left_semi").select("doc_id")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    rows = needed.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    found = {r["k"]: bytes(r["bits"]) for r in rows.collect()}  # FILTER_BITS bits at most
    size = 4096
    bits = np.frombuffer(b"".join(found.get(k, b"").ljust(size, b"\0") for k in range(FILTER_BITS // (8 * size) + 2)), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    names = ["sid", "members"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = shared.value

        def wanted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = batch.column("p").to_numpy()  # Spark's hash of the id; 1-based buckets of 32768 bits
                yield batch.filter(pa.array((flat[(p // 32768 + 1) * size + p % 32768 // 8] >> (p % 8)) & 1 == 1))

        for _, texts in blocks(wanted(), BLOCK):
            own = {set_id(s): s for s in shingle_sets(texts, shingle) if len(s)}
            yield _table([list(own), [s.tobytes() for s in own.values()]], [pa.int64(), pa.binary()], names)

    sets = docs.withColumn("p", place).mapInArrow(emit, "sid long, members binary")
    return sets.join(sids, "sid", "left_semi").dropDuplicates(["sid"])


def _similar(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar, compared exactly."""
    x = sets.select(F.col("sid").alias("a"), F.col("members").alias("m_a"))
    y = sets.select(F.col("sid").alias("b"), F.col("members").alias("m_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for a, b in zip(batch.column("m_a"), batch.column("m_b")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, b]))
                i = int((both[1:] == both[:-1]).sum())
                mask.append(den * i >= num * (len(a) + len(b) - i))
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "m_a", "m_b").mapInArrow(compare, "a long, b long")


def _in_blocks(member: DataFrame) -> DataFrame:
    """member (key, sid, n, pos, root) dealt to groups (key, i, j) of bounded size, in which any two of a key's rows of
    different roots meet. Most lists are one group. In a long one, the rows of the most frequent root never meet each other:
    their blocks i meet each block j of the rest, and those meet each other in groups of negative i."""
    counts = member.groupBy("key", "root").agg(F.count("*").alias("c"))
    lists = counts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("of")).where("of > most.c")
    n_blocks = lambda c: F.ceil(c / LIST_BLOCK).cast("int")
    lists = lists.select("key", F.col("most.root").alias("major"), n_blocks(F.col("most.c")).alias("k"), n_blocks(F.col("of") - F.col("most.c")).alias("m"))
    rows = member.join(lists, "key")
    part = lambda of: F.pmod(F.xxhash64("sid"), of).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    group = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    own = part(F.col("m"))
    of_major = F.transform(upto(F.col("m")), lambda j: group(part(F.col("k")), j))
    of_rest = F.concat(
        F.transform(upto(F.col("k")), lambda i: group(i, own)),
        F.transform(F.filter(upto(F.col("m")), lambda x: x != own), lambda x: group(-1 - F.least(x, own), F.greatest(x, own))),
    )
    groups = F.explode(F.when(F.col("root") == F.col("major"), of_major).otherwise(of_rest))
    return rows.select("key", "sid", "n", "pos", "root", groups.alias("g")).select("key", "g.i", "g.j", "sid", "n", "pos", "root")


def _across(member: DataFrame, sketches: DataFrame, every: bool, num: int, den: int) -> DataFrame:
    """Pairs (a, b), the smaller set first, of sets of a list in different components that nothing rules out: all of them, or
    as many as make a forest over the components of a group."""
    keys = ["key", "i", "j"]
    columns = [*keys, "sid", "n", "pos", "root"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in names)))
        for _, group in groupby(rows, key=lambda r: r[:3]):
            yield list(group)

    def compatible(group: list[tuple]) -> Iterator[tuple[int, int]]:
        """Places of the pairs of different roots that neither sizes nor places in the sets' order rule out."""
        for x, (_, _, _, _, n_a, p_a, r_a, *_) in enumerate(group):
            for y in range(x + 1, len(group)):
                _, _, _, _, n_b, p_b, r_b, *_ = group[y]
                if num * n_b > den * n_a:
                    break
                if r_a != r_b:
                    least = overlap(n_a, n_b, num, den)
                    if p_a <= n_a - least and p_b <= n_b - least:
                        yield x, y

    def with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for group in groups(batches, columns):
            kept = sorted({z for pair in compatible(group) for z in pair}) if len(group) > 1 else []
            found += [group[z] for z in kept]
            if len(found) >= 4096:
                yield _table(list(zip(*found)), types, columns)
                found = []
        if found:
            yield _table(list(zip(*found)), types, columns)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in groups(batches, [*columns, "sketch"]):
            sets = [Sketched(r[4], r[7]) for r in group]
            above = {r[6]: r[6] for r in group}  # a root's place in the forest
            left = len(above)

            def top(root: int, above: dict = above) -> int:
                while above[root] != root:
                    above[root] = root = above[above[root]]
                return root

            for x, y in compatible(group):
                r_a, r_b = group[x][6], group[y][6]
                if (every or top(r_a) != top(r_b)) and sets[x].may_be_similar(sets[y], num, den):
                    found.append((group[x][3], group[y][3]))
                    if not every:
                        above[top(r_b)] = top(r_a)
                        left -= 1
                        if left == 1:
                            break
            if len(found) >= 4096:
                yield _table(list(zip(*found)), [pa.int64()] * 2, ["a", "b"])
                found = []
        if found:
            yield _table(list(zip(*found)), [pa.int64()] * 2, ["a", "b"])

    # sketches join the few rows that are left without them
    order = [*keys, "n", "sid"]
    rows = _in_blocks(member).repartition(*keys).sortWithinPartitions(*order).mapInArrow(with_partner, "key long, i int, j int, sid long, n int, pos int, root long")
    rows = rows.join(sketches.select("sid", "sketch"), "sid").repartition(*keys).sortWithinPartitions(*order)
    return rows.mapInArrow(meet, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) for every row of docs (doc_id, text).
    Links are between sets of word shingles whose Jaccard similarity is num / den or more.

    Null texts and texts without words have no shingles and link with nothing; rows of one id and text are one document;
    a null id is reached and passed on like any other but is never the smallest, unless its component has no other; an
    empty table gives no rows; other columns are ignored. Shingles are compared by 64-bit hash, as are whole sets.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text")
    described = stored(_described(texts, shingle), "sets")
    found = described.where("doc_id IS NOT NULL")
    sets_once = stored(found.groupBy("sid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id")), "sketches")
    sketches, owners = sets_once.select("sid", "n", "sketch"), sets_once.select("sid", "doc_id")
    sizes = {r["n"]: r["count"] for r in found.where(F.col("n") <= LARGEST_LIGHT).groupBy("n").count().collect()}
    keys = _keys(texts, dividing_size(sizes, num=num, den=den), _counters(described), shingle, num, den).repartition("key").dropDuplicates(["key", "sid"])
    shared = keys.groupBy("key").agg(F.count("*").alias("in_list")).where("in_list > 1").select("key")
    member = stored(keys.join(shared, "key").select("key", "sid", "n", "pos"), "lists")
    rooted = member.withColumn("root", F.col("sid"))
    tested = roots = None
    for every in (False, True):  # forests, and what they may have hidden
        let_through = stored(_across(rooted, sketches, every, num, den), "pairs")
        pairs = let_through if tested is None else stored(let_through.join(tested, ["a", "b"], "left_anti"), "pairs")
        sets = stored(_sets_of(texts, owners, pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), shingle), "members")
        links = stored(_similar(pairs, sets, num, den), "links")
        n_links = links.count()
        if n_links:
            roots = stored(components(links), "roots") if roots is None else joined_components(roots, links)
        if every or n_links == pairs.count():  # each forest held, so no list has anything left to link
            break
        tested = pairs
        if roots is not None:
            rooted = member.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", "n", "pos", F.coalesce("root", "sid").alias("root"))

    owned = found.select("doc_id", "n", "sid")
    if roots is None:
        owned = owned.withColumnRenamed("sid", "root")
    else:
        owned = owned.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "n", F.coalesce("root", "sid").alias("root"))
    own_id = F.when(F.col("doc_id") > F.lit(-(2**63)), F.col("doc_id"))
    least = owned.where("n > 0").groupBy("root").agg(F.min(own_id).alias("component_id"))
    with_text = owned.where("n > 0").join(least, "root").select("doc_id", "n", "component_id")
    without = owned.where("n = 0").select("doc_id", "n", own_id.alias("component_id"))
    # texts that are null or empty are not in the described rows
    bare = texts.where(F.coalesce(F.col("text"), F.lit("")) == "").select("doc_id", F.lit(0).cast("long").alias("n"), own_id.alias("component_id"))
    return with_text.union(without).union(bare).select(own_id.alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
