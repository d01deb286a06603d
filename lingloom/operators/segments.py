"""Segments of documents: extracted from markup, guarded, chunked and packed."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import long_windows
from ..storage import SMALL, sized, stored
from . import markup
from .batches import batch_numbers, pack_batches  # noqa: F401
from .finder import automaton_of

SEGMENT = "book_id string, doc_id string, seg_pos int, tag string, kind string, text string, mask array<string>"
# Metadata fields and properties that hold text to convert.
META_FIELDS = ("title", "description", "publisher", "subject")
_KEPT = "\ue020"
META_PROPERTIES = ("belongs-to-collection", "file-as")


def extract_segments(docs: DataFrame) -> DataFrame:
    """One row a segment of every document of docs (book_id, doc_id, content)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            rows = [(b, d, k, s["tag"], s["kind"], s["text"], s["mask"]) for b, d, c in zip(df["book_id"], df["doc_id"], df["content"]) for k, s in enumerate(markup.segments(c or ""))]
            yield pd.DataFrame(rows, columns=["book_id", "doc_id", "seg_pos", "tag", "kind", "text", "mask"])

    return docs.select(F.col("book_id").cast("string").alias("book_id"), F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(read, SEGMENT)


def mask_opaque(fragment: Column) -> Column:
    """STRUCT<text, mask> of a markup fragment."""

    @F.pandas_udf("text string, mask array<string>")
    def cover(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            root = markup.parse(t or "")
            saved = markup.mask(root)
            rows.append((root.inner(), saved))
        return pd.DataFrame(rows, columns=["text", "mask"])

    return cover(fragment)


def unmask_opaque(text: Column, mask: Column) -> Column:
    @F.pandas_udf("string")
    def uncover(texts: pd.Series, masks: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else markup.unmask(t, list(m) if m is not None else []) for t, m in zip(texts, masks)])

    return uncover(text, mask)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _points(node: ET.Element, path: list[int]) -> Iterator[tuple[list[int], str]]:
    for k, point in enumerate(x for x in node if _local(x.tag) == "navPoint"):
        label = next((t.text for x in point if _local(x.tag) == "navLabel" for t in x if _local(t.tag) == "text"), None)
        yield [*path, k], (label or "").strip()
        yield from _points(point, [*path, k])


def extract_navigation(docs: DataFrame) -> DataFrame:
    """book_id, doc_id, path, title: every entry of a table of contents in tree order, by its place at every level. docs:
    book_id, doc_id, content of navigation control files; what cannot be parsed has no rows."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            rows = []
            for b, d, c in zip(df["book_id"], df["doc_id"], df["content"]):
                try:
                    root = ET.fromstring(c)
                except (ET.ParseError, TypeError):
                    continue
                top = next((x for x in root.iter() if _local(x.tag) == "navMap"), root)
                rows += [(b, d, p, t) for p, t in _points(top, [])]
            yield pd.DataFrame(rows, columns=["book_id", "doc_id", "path", "title"])

    return docs.select(F.col("book_id").cast("string").alias("book_id"), F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(read, "book_id string, doc_id string, path array<int>, title string")


def extract_metadata(docs: DataFrame) -> DataFrame:
    """book_id, ns, field, idx, value, attrs of every metadata element of package documents that holds text to convert."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            rows = []
            for b, c in zip(df["book_id"], df["content"]):
                try:
                    root = ET.fromstring(c)
                except (ET.ParseError, TypeError):
                    continue
                seen: dict[str, int] = {}
                for x in next((m for m in root.iter() if _local(m.tag) == "metadata"), []):
                    ns, name = x.tag[1:].partition("}")[0] if x.tag[0] == "{" else "", _local(x.tag)
                    field = x.attrib.get("property", "") if name == "meta" else name
                    rows.append((b, ns, field, seen.setdefault(field, 0), (x.text or "").strip(), list(x.attrib.items())))
                    seen[field] += 1
            yield pd.DataFrame(rows, columns=["book_id", "ns", "field", "idx", "value", "attrs"]).assign(attrs=lambda x: x["attrs"].map(dict))

    rows = docs.select(F.col("book_id").cast("string").alias("book_id"), "content").mapInPandas(read, "book_id string, ns string, field string, idx int, value string, attrs map<string,string>")
    return rows.where(F.col("field").isin(*META_FIELDS, *META_PROPERTIES) & (F.col("value") != ""))


PARTS = "array<struct<part:string,protected:boolean>>"


def protected_parts(text: str, finder) -> tuple[list[str], list[bool]]:
    """A text cut at what the automaton finds, the longest at the first place, and which parts those are."""
    best = {end + 1 - len(w): w for end, w in finder.iter(text)} if len(finder) else {}  # a place's longest comes last
    parts, protected, at = [], [], 0
    for place in sorted(best):
        if place >= at:
            if place > at:
                parts.append(text[at:place])
                protected.append(False)
            parts.append(best[place])
            protected.append(True)
            at = place + len(best[place])
    if at < len(text):
        parts.append(text[at:])
        protected.append(False)
    return parts, protected


#: Characters of text that are cut at once.
SLICE = 1 << 20


def _cut(texts: pa.Array, finders: Iterable) -> Iterator[pa.Array]:
    """The parts of every text by its automaton, as columns and some texts at a time: objects for all of a batch's parts take
    many times its memory. Null: null."""
    ends, parts, protected, nulls, size = [0], [], [], [], 0

    def array() -> pa.Array:
        cut = pa.StructArray.from_arrays([pa.array(parts, pa.string()), pa.array(protected, pa.bool_())], ["part", "protected"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cut, mask=pa.array(nulls, pa.bool_()))

    for t, finder in zip(texts, finders):
        t = t.as_py()
        if t is not None:
            own = protected_parts(t, finder)
            parts += own[0]
            protected += own[1]
            size += len(t)
        nulls.append(t is None)
        ends.append(len(parts))
        if size >= SLICE:
            yield array()
            ends, parts, protected, nulls, size = [0], [], [], [], 0
    if nulls:
        yield array()


def guard_entities(segments: DataFrame, entities: DataFrame, text: str = "text", largest: int = SMALL) -> DataFrame:
    """segments with parts: ARRAY<STRUCT<part, protected>>, cut at the entities of their book, longer ones first. Up to largest
    bytes every task has all entities by book; beyond it each text gets those that its windows meet in a join."""
    listed, small = sized(stored(entities.where("ngram <> ''").select("book_id", "ngram").distinct(), "entities"), largest)
    if small:
        books: dict = {}
        for r in listed.collect():  # of a checked size
            books.setdefault(r["book_id"], []).append(r["ngram"])
        shared, finders = segments.sparkSession.sparkContext.broadcast(books), {}

        @F.arrow_udf(PARTS)
        def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for own, texts in batches:
                own = own.to_pylist()
                for b in set(own) - set(finders):
                    finders[b] = automaton_of(shared.value.get(b, ()))
                yield from _cut(texts, (finders[b] for b in own))

        return segments.withColumn("parts", cut(F.col("book_id"), F.col(text)))

    sizes = [r[0] for r in listed.select(F.length("ngram")).distinct().collect()]  # of entities, which are short
    key = F.xxhash64(text)  # texts of one key share their entities; one that a text does not hold cuts nothing
    every = F.array_distinct(F.flatten(F.array(*[long_windows(F.col(text), n) for n in sizes])))
    met = segments.select("book_id", key.alias("_key"), F.explode(every).alias("ngram")).join(listed, ["book_id", "ngram"])
    met = met.groupBy("book_id", "_key").agg(F.collect_set("ngram").alias("_own"))

    @F.arrow_udf(PARTS)
    def cut_own(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, own in batches:
            yield from _cut(texts, (automaton_of(o.as_py() or ()) for o in own))

    rows = segments.withColumn("_key", key).join(met, ["book_id", "_key"], "left")
    return rows.withColumn("parts", cut_own(F.col(text), F.col("_own"))).select(*segments.columns, "parts")


def chunks(text: str, limit: int = 1800, least: int = 100, enders: str = "。！？\n") -> list[str]:
    """A text in chunks of up to limit characters: cut after an ender once least characters are gathered, then joined as
    long as they fit; a piece over the limit stays whole."""
    if len(text) <= limit:
        return [text]
    pieces, first = [], 0
    for k, c in enumerate(text, 1):
        if c in enders and k - first >= least:
            pieces.append(text[first:k])
            first = k
    pieces.append(text[first:])
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1]) + len(p) <= limit:
            out[-1] += p
        elif p:
            out.append(p)
    return out


def fragments(text: str) -> list[str]:
    """A text cut at marks for a second try. A run of marks that are all sentence enders goes with the text before it; any
    other run is a piece of its own."""
    out: list[str] = []
    for k, part in enumerate(re.split("([。！？…!?.\n，、]+)", text)):
        ends = k % 2 == 1 and not set(part) - set("。！？…!?\n")
        if out and (ends or not part.strip()):
            out[-1] += part
        elif part:
            out.append(part)
    return out


def _pieces(df: DataFrame, f, text: str, pos: str, name: str) -> DataFrame:
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t) for t in texts])

    return df.select("*", F.posexplode(cut(F.col(text))).alias(pos, name))


def chunk_text(df: DataFrame, limit: int = 1800, least: int = 100, text: str = "text") -> DataFrame:
    """df with chunk_pos and chunk, one row a chunk."""
    return _pieces(df, lambda t: chunks(t, limit, least), text, "chunk_pos", "chunk")


def fragment_for_retry(df: DataFrame, text: str = "text") -> DataFrame:
    """df with frag_pos and fragment, one row a fragment; a row's fragments join to its text."""
    return _pieces(df, fragments, text, "frag_pos", "fragment")


def convert_phrases(df: DataFrame, phrases: DataFrame, text: str = "text", largest: int = SMALL) -> DataFrame:
    """df with converted: phrases (simp, trad) replaced from left to right, longest first; results are not looked at again.

    The table goes whole to every task up to largest bytes; a larger one is joined to the texts by their windows.
    """
    from .apply_rules import apply_rules

    rules = phrases.groupBy("simp").agg(F.min("trad").alias("right")).select(F.col("simp").alias("wrong"), "right", F.lit(True).alias("manual"))
    none = phrases.limit(0).select(F.col("simp").alias("bg"))
    # ellipses are not this operator's business, so they are kept out of the way
    kept = df.withColumn("_t", F.replace(F.col(text), F.lit("…"), F.lit(_KEPT)))
    rules = rules.select(F.replace("wrong", F.lit("…"), F.lit(_KEPT)).alias("wrong"), F.replace("right", F.lit("…"), F.lit(_KEPT)).alias("right"), "manual")
    done = apply_rules(kept, rules, none, "_t", largest=largest, hits=False)
    return done.withColumn("converted", F.replace(F.col("applied.text"), F.lit(_KEPT), F.lit("…"))).drop("_t", "applied")


def ordered(segments: DataFrame, by: str = "book_id", order: tuple[str, ...] = ("doc_id", "seg_pos"), name: str = "pos") -> DataFrame:
    """segments numbered in order within their book, from 0."""
    return segments.withColumn(name, (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))
