"""A Merkle manifest of a dataset: hash trees over its rows, of which only every few levels are kept.

Leaves are hashed where the rows are and travel without texts. They are put in order by ranges, numbered, and written;
aligned subtrees of STEP levels are then folded up, each by itself, and only their tops are written: levels 0, STEP,
2 * STEP, ... A proof needs nodes of all levels. The missing ones are made again, from the top down: each aligned subtree is
folded once more from its stored descendants, the siblings on the way to each of these are emitted behind those that its top
was given, and the nodes in between are dropped. A subtree has at most FAN ** STEP leaves whatever a group's size.

Groups of rows (languages) have trees of their own; their roots are the leaves of one more tree, made by the same functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small_or_shuffled
from .common import stored, tasks

#: Children of a node, and levels between those that are kept.
FAN, STEP = 2, 8

_NODE = "grp string, pos long, hash string"
#: A way up: one entry a level, the siblings to the left, a slash, and the siblings to the right.
_WAY = "array<string>"


def joined_hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field_text(column: Column) -> Column:
    """'-' for null; else the value's number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in columns]), 256)


def fold_levels(nodes: list[str], levels: int, fan: int) -> list[list[str]]:
    """The nodes of an aligned subtree, level by level: those given, and so many levels above them. A last node of fewer
    children, even of one, is their hash too."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([joined_hash(below[k : k + fan]) for k in range(0, len(below), fan)])
    return out


def way_up(levels: list[list[str]], k: int, fan: int) -> list[str]:
    """The siblings of node k of the lowest level, and of what is above it."""
    out = []
    for nodes in levels[:-1]:
        low = k - k % fan
        out.append("".join(nodes[low:k]) + "/" + "".join(nodes[k + 1 : low + fan]))
        k //= fan
    return out


def siblings_hash(way: list[str]) -> str:
    return joined_hash([w.replace("/", "") for w in way])


def folded(leaf: str, way: list[str]) -> str:
    """The root that a leaf and its siblings give: all that a verifier does."""
    for w in way:
        left, _, right = w.partition("/")
        leaf = joined_hash([left, leaf, right])
    return leaf


def _height(n: int, fan: int) -> int:
    """Levels above n nodes up to their root."""
    out = 0
    while n > 1:
        n, out = -(-n // fan), out + 1
    return out


def _numbered(leaves: DataFrame, extra: str) -> DataFrame:
    """leaves (grp, key, hash, tie, and the columns of extra) with pos, their place in the order of key, hash and tie within
    their group. They are dealt to tasks by ranges, so a group may lie in many; each task counts what it holds of a group,
    and the sums before it say where it begins."""
    types = {f.split()[0]: f.split()[1] for f in extra.split(", ") if f}
    order = ["grp", F.col("key").asc_nulls_first(), "hash", "tie"]
    ranged = leaves.repartitionByRange(tasks(leaves.sparkSession), *order).sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            group = batch.column("grp")
            codes = group.dictionary_encode().indices.to_numpy()
            new = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1 if len(codes) else 0))
            place = np.arange(batch.num_rows) - np.repeat(new, np.diff(np.r_[new, batch.num_rows]))
            if batch.num_rows:
                if group[0].as_py() == last:
                    place[: new[1] if len(new) > 1 else batch.num_rows] += seen
                last, seen = group[batch.num_rows - 1].as_py(), int(place[-1]) + 1
            names = ["grp", "hash", *types, "part", "place"]
            columns = [batch.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place.astype(np.int64))], names=names)

    schema = f"grp string, hash string, {extra}{', ' if extra else ''}part int, place long"
    placed = stored(ranged.select("grp", "hash", *types).mapInArrow(count, schema), "placed")
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("grp", "part").agg(F.count("*").alias("n"))  # one row a task and group
    whole = starts.groupBy("grp").agg(F.sum("n").alias("total"))
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).join(whole, "grp").select("grp", "part", "start", "total")
    starts = small_or_shuffled(stored(starts, "starts"))
    return placed.join(starts, ["grp", "part"]).select("grp", (F.col("start") + F.col("place")).alias("pos"), "hash", *types, "total")


def _tops(nodes: DataFrame, fan: int, step: int) -> DataFrame:
    """The nodes step levels above nodes (grp, pos, hash, total): one for each aligned subtree, or the root where that is
    lower. total: the number of nodes of the group's level."""
    width = fan**step

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        total = table.column("total")[0].as_py()
        levels = fold_levels(table.column("hash").to_pylist(), min(step, _height(total, fan)), fan)
        pos = table.column("pos")[0].as_py() // width
        return pa.table({"grp": table.column("grp")[:1], "pos": pa.array([pos], pa.int64()), "hash": pa.array(levels[-1], pa.string()), "total": pa.array([-(-total // width)], pa.int64())})

    blocks = nodes.select("grp", "pos", "hash", "total", F.expr(f"pos div {width}").alias("block"))
    return blocks.groupBy("grp", "block").applyInArrow(fold, f"{_NODE}, total long")


def grow(leaves: DataFrame, fan: int = FAN, step: int = STEP) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels above leaves (grp, pos, hash, total), lowest first, and each group's root (grp, hash). A level holds
    the groups that are not at their root below it."""
    levels, roots, at = [leaves], [], leaves
    while True:
        roots.append(at.where("total = 1").select("grp", "hash"))
        at = at.where("total > 1")
        if not at.limit(1).count():
            break
        at = stored(_tops(at, fan, step), "level")
        levels.append(at)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, out


def _ways(nodes: DataFrame, above: DataFrame, fan: int, step: int) -> DataFrame:
    """grp, pos, way of every node of a stored level. above: grp, pos, way of the stored level above; groups whose root is in
    this level already come with what is above the root."""
    width = fan**step

    def descend(table: pa.Table, tops: pa.Table) -> pa.Table:
        if not table.num_rows or not tops.num_rows:
            return pa.table({"grp": pa.array([], pa.string()), "pos": pa.array([], pa.int64()), "way": pa.array([], pa.list_(pa.string()))})
        table = table.sort_by("pos")
        rest = tops.column("way")[0].as_py()
        levels = fold_levels(table.column("hash").to_pylist(), min(step, _height(table.column("total")[0].as_py(), fan)), fan)
        ways = [way_up(levels, k, fan) + rest for k in range(table.num_rows)]
        return pa.table({"grp": table.column("grp"), "pos": table.column("pos"), "way": pa.array(ways, pa.list_(pa.string()))})

    blocks = nodes.select("grp", "pos", "hash", "total", F.expr(f"pos div {width}").alias("block"))
    both = blocks.groupBy("grp", "block").cogroup(above.select(F.col("grp").alias("grp"), F.col("pos").alias("block"), "way").groupBy("grp", "block"))
    return both.applyInArrow(descend, f"grp string, pos long, way {_WAY}")


def descend(levels: list[DataFrame], tops: DataFrame, fan: int = FAN, step: int = STEP) -> DataFrame:
    """grp, pos, way of every node of the lowest but one stored level, from tops (grp, way: what is above each group's root)
    and the levels that grow() gave. The lowest level is left to the caller, whose leaves carry more than a hash."""
    ways = None
    for level in reversed(levels[1:]):
        roots = level.where("total = 1").join(tops, "grp").select("grp", "pos", "way")
        inner = _ways(level.where("total > 1"), ways, fan, step) if ways is not None else None
        ways = stored(roots if inner is None else roots.unionByName(inner), "ways")
    lone = levels[0].where("total = 1").join(tops, "grp").select("grp", "pos", "way")  # its subtree is itself
    return lone if ways is None else ways.unionByName(lone)


def altered_rows(doc_id: Column) -> Column:
    """Which rows the tampering trial changes: those of an id whose checksum 7 divides."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def merkle_manifest(docs: DataFrame, fan: int = FAN, step: int = STEP, keep: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs (doc_id, source, lang, n_chars,
    text); with keep also way, the proof itself: an array, from the leaf's level up, of left siblings, a slash, right ones.

    A leaf is the hash of the row's five fields; lang's leaves ascend by doc_id (null first), equal ids by their leaf, and
    equal rows are one another's equals. subroot is the root of lang's tree, root that of the subroots, ordered by lang (null
    first). folded_root is worked out from the leaf and its siblings, the leaf being that of n_chars + 1 where the trial of
    altered_rows() falls on the row. Null fields are '-'; null ids are not altered; null, empty and long texts are leaves
    like any; other columns are ignored; an empty table gives no rows.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [*fields[:3], F.col("n_chars").cast("decimal(20,0)") + 1, fields[4]]
    group = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))  # no nulls as keys
    hit = altered_rows(F.col("doc_id"))
    leaves = docs.select(group.alias("grp"), F.col("doc_id").cast("long").alias("key"), leaf_hash(*fields).alias("hash"), F.when(hit, leaf_hash(*changed)).alias("altered"))
    leaves = stored(leaves.withColumn("tie", F.monotonically_increasing_id()).withColumn("doc_id", F.col("key")), "leaves")
    levels, subroots = grow(stored(_numbered(leaves, "altered string, doc_id long"), "level"), fan, step)
    subroots = stored(subroots, "subroots")
    # the tree over the groups, in the order of their keys: one tree, so one group
    over = subroots.select(F.lit("").alias("grp"), F.lit(None).cast("long").alias("key"), "hash", F.col("grp").alias("lang_key"), F.col("grp").alias("tie"))
    over = stored(_numbered(over.withColumn("hash_", F.col("hash")).withColumn("hash", F.lit("")), "lang_key string, hash_ string").withColumn("hash", F.col("hash_")), "level")
    upper, roots = grow(over, fan, step)
    root = roots.first()
    root = root["hash"] if root is not None else ""
    ways = _leaf_ways(upper, descend(upper, roots.select("grp", F.array().cast(_WAY).alias("way")), fan, step), fan, step, "lang_key")
    tops = stored(ways.select(F.col("lang_key").alias("grp"), "way"), "tops")
    above = descend(levels, tops, fan, step).join(small_or_shuffled(subroots.withColumnRenamed("hash", "subroot")), "grp")
    width = fan**step

    def prove(table: pa.Table, tops: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "way")}
        if table.num_rows and tops.num_rows:
            table = table.sort_by("pos")
            rest, subroot, nodes = tops.column("way")[0].as_py(), tops.column("subroot")[0].as_py(), table.column("hash").to_pylist()
            levels = fold_levels(nodes, min(step, _height(table.column("total")[0].as_py(), fan)), fan)
            for k, (doc_id, leaf, altered) in enumerate(zip(table.column("doc_id").to_pylist(), nodes, table.column("altered").to_pylist())):
                way = way_up(levels, k, fan) + rest
                end = folded(altered or leaf, way)
                for c, v in zip(out, (doc_id, leaf, subroot, root, siblings_hash(way), end, end == root, way if keep else None)):
                    out[c].append(v)
        kinds = {"doc_id": pa.int64(), "verified": pa.bool_(), "way": pa.list_(pa.string())}
        return pa.table({c: pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()})

    blocks = levels[0].select("grp", "pos", "hash", "altered", "doc_id", "total", F.expr(f"pos div {width}").alias("block"))
    both = blocks.groupBy("grp", "block").cogroup(above.select(F.col("grp").alias("grp"), F.col("pos").alias("block"), "way", "subroot").groupBy("grp", "block"))
    rows = both.applyInArrow(prove, f"doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, way {_WAY}")
    return rows if keep else rows.drop("way")


def _leaf_ways(levels: list[DataFrame], above: DataFrame, fan: int, step: int, name: str) -> DataFrame:
    """name, way of the lowest level, whose column name tells its nodes apart."""
    nodes = levels[0]
    ways = _ways(nodes, above, fan, step)
    return nodes.join(ways, ["grp", "pos"]).select(name, "way")
