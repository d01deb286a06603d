"""Book files and what is in them."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import output_stem

#: What comes before the path in a file's name.
_STORE = "^[a-z][a-z0-9+.-]*:(//[^/]*)?"
DOCS = "book_id string, doc_id string, doc_pos int, kind string, content string, error string"
#: Characters of texts that leave a task at a time.
BATCH = 4 << 20
#: What reading a container or an entry of it may raise.
UNREADABLE = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError, KeyError)


def list_books(spark: SparkSession, dirs: list[str], exclude_dir: str | None = None, pattern: str = "*.epub") -> DataFrame:
    """path, modificationTime, length, content of every book file below dirs, each once, without those below exclude_dir."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(dirs)
    if exclude_dir:
        inside = re.sub(_STORE, "", exclude_dir).rstrip("/") + "/"
        files = files.where(~F.regexp_replace("path", _STORE, "").startswith(inside))
    return files.dropDuplicates(["path"])


def skip_existing(books: DataFrame, done: DataFrame, forms: dict[str, str]) -> DataFrame:
    """books (path) with stem, without those whose stem is in done (stem)."""
    return books.withColumn("stem", output_stem(F.col("path"), forms)).join(done.select("stem"), "stem", "left_anti")


def _entries(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """(name, kind) of a container's package document, navigation control file and content documents, these in reading
    order, by its directory and its package document; the navigation document is left out."""
    names = set(z.namelist())
    opf = next((n for n in sorted(names) if n.endswith(".opf")), None)
    if opf is None:
        yield from ((n, "doc") for n in sorted(names) if n.endswith((".xhtml", ".html", ".htm")))
        return
    yield opf, "opf"
    root = ET.fromstring(z.read(opf))
    local = lambda x: x.tag.rpartition("}")[2]
    base = posixpath.dirname(opf)
    items = {x.attrib["id"]: x.attrib for x in root.iter() if local(x) == "item" and "id" in x.attrib}
    spine = [x.attrib.get("idref") for x in root.iter() if local(x) == "itemref"]
    place = {i: k for k, i in enumerate(spine)}
    for i, a in sorted(items.items(), key=lambda x: place.get(x[0], len(place))):
        name, kind = posixpath.normpath(posixpath.join(base, a.get("href", ""))), a.get("media-type", "")
        if name not in names or "nav" in a.get("properties", "").split():
            continue
        if kind == "application/x-dtbncx+xml":
            yield name, "ncx"
        elif kind in ("application/xhtml+xml", "text/html"):
            yield name, "doc"


def _rows(path: str, content: bytes | None) -> Iterator[tuple]:
    """A row for every entry, read one by one, and one of kind 'error' for what cannot be read: an entry, what its package
    document does not name, or all of it."""
    k = 0
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            for name, kind in _entries(z):
                try:
                    yield path, name, k, kind, z.read(name).decode("utf-8", "replace"), None
                except UNREADABLE as e:
                    yield path, name, k, "error", None, f"{type(e).__name__}: {e}"
                k += 1
    except (*UNREADABLE, ET.ParseError) as e:
        yield path, None, k, "error", None, f"{type(e).__name__}: {e}"


def unpack_books(files: DataFrame) -> DataFrame:
    """book_id, doc_id, doc_pos, kind (doc, ncx, opf, error), content, error of files (path, content), a row an entry. Bytes
    that are not UTF-8 are replaced. What cannot be read is a row of kind error: a file that is no container (doc_id null), a
    broken package document (doc_id null, after what came before), a broken entry; error says why. Texts leave a task by
    BATCH characters, so a large container is never there unpacked as a whole."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["book_id", "doc_id", "doc_pos", "kind", "content", "error"])
        for df in parts:
            rows, size = [], 0
            for path, content in zip(df["path"], df["content"]):
                for row in _rows(path, content):
                    rows.append(row)
                    size += len(row[4] or "")
                    if size >= BATCH:
                        yield frame(rows)
                        rows, size = [], 0
            yield frame(rows)

    return files.select("path", "content").repartition("path").mapInPandas(unpack, DOCS)
