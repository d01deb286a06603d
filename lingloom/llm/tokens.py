"""Whole-text tokenisation inside Spark tasks with a vocabulary file of the tokenizers library.

A byte-level vocabulary is applied to each pre-token on its own, so a text's ids are those of its pieces in order, as long
as no pre-token crosses from one piece into the next. Pieces are the vocabulary's added tokens, and between them words with
the space before them, ASCII punctuation behind an ASCII letter, and what is left of white space. The pieces of a block of
texts are found and told apart with numpy; each distinct one goes to the library once for a worker process, as long as its
table has room, and a text's ids are gathered from the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import range_hashes, ranges

#: Entries and bytes of a worker's table of pieces (about 60 bytes an entry); when it is full, the older half goes.
CACHE, CACHE_BYTES = 600_000, 16 << 20
#: Text that is encoded at a time; a longer text is a block of its own.
BLOCK = 1 << 20
#: Bytes of a piece that its hash looks at; all of its bytes are compared.
_HASHED = 1 << 12
#: White space beyond ASCII, as the pre-tokeniser's pattern knows it, in UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")


def _members(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE = _members(b"\t\n\x0b\x0c\r ")
_LETTER = _members(bytes([*range(65, 91), *range(97, 123)]))
#: ASCII punctuation but for the apostrophe, which can begin a contraction.
_PUNCTUATION = _members(bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39))

_CODERS: dict[str, Coder] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(buf: np.ndarray, edges: np.ndarray, wide: bool = True) -> np.ndarray:
    """Where pieces begin. edges: where texts begin, and the end of the last."""
    space = _SPACE[buf]
    if wide and (buf >= 0xC2).any():
        for m in _WIDE_SPACE.finditer(buf):
            space[m.start() : m.end()] = True
    after_space = np.r_[False, space]
    after_space[edges] = False  # the first byte of a text is after nothing
    cut = np.zeros(len(buf) + 1, bool)
    cut[edges] = True
    cut[:-1] |= space & ~after_space[:-1]
    cut[1:-1] |= _LETTER[buf[:-1]] & _PUNCTUATION[buf[1:]]
    word = np.flatnonzero(~space & after_space[:-1])
    last = word - 1  # the last character of the white space before it: part of the word if a blank, else by itself
    for _ in range(2):
        last -= (buf[last] & 0xC0) == 0x80
    cut[last] = True
    cut[word[buf[word - 1] != 32]] = True
    return np.flatnonzero(cut[:-1])


class Coder:
    """Ids of texts, as the library gives them at its default settings and add_special_tokens=False."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(self.tokenizer.get_added_tokens_decoder().values(), key=lambda t: -len(t.content))
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = re.compile(b"|".join(re.escape(t.content.encode()) for t in added)) if added else None
        self.block = 0
        self._forget(np.zeros(0, bool))

    def _forget(self, keep: np.ndarray) -> None:
        """The table with the entries in keep; empty to begin with. hashes are in order; bytes and ids by entry."""
        if not len(keep):
            self.hashes, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            self.byte_at, self.n_bytes, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
            self.id_at, self.n_ids, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
            return
        self.hashes, self.used = self.hashes[keep], self.used[keep]
        self.bytes, self.ids = self.bytes[ranges(self.byte_at[keep], self.n_bytes[keep])], self.ids[ranges(self.id_at[keep], self.n_ids[keep])]
        self.n_bytes, self.n_ids = self.n_bytes[keep], self.n_ids[keep]
        self.byte_at, self.id_at = np.cumsum(self.n_bytes) - self.n_bytes, np.cumsum(self.n_ids) - self.n_ids

    def _encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([r.decode() for r in raw], add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n

    def _sections(self, raw: bytes, edges: np.ndarray) -> np.ndarray:
        """Start and end of every added token that stands in one text."""
        out, at = [], 0
        while self.added is not None and (m := self.added.search(raw, at)):
            inside = np.searchsorted(edges, m.start(), "right") == np.searchsorted(edges, m.end(), "left")
            if inside:
                out.append(m.span())
            at = m.end() if inside else m.start() + 1
        return np.array(out, np.int64).reshape(-1, 2)

    def encode_block(self, raw: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that stand end to end in raw, and where each text's begin (with the end of the last's).
        edges: where texts begin, and the end of the last."""
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        buf = np.frombuffer(raw, np.uint8)
        added = self._sections(raw, edges)
        starts = piece_starts(buf, np.union1d(edges, added))
        for a, b in added.tolist():
            starts = np.delete(starts, slice(np.searchsorted(starts, a + 1), np.searchsorted(starts, b)))
        lengths = np.diff(starts, append=len(buf))
        hashes = range_hashes(buf, starts, starts + np.minimum(lengths, _HASHED))
        distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        n, at = lengths[first], starts[first]
        place = np.searchsorted(self.hashes, distinct)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == distinct[known]
        entry = place[known]
        if (
            not np.array_equal(n[of], lengths)
            or not np.array_equal(buf, buf[ranges(at[of], lengths)])
            or not np.array_equal(self.n_bytes[entry], n[known])
            or not np.array_equal(self.bytes[ranges(self.byte_at[entry], n[known])], buf[ranges(at[known], n[known])])
        ):  # two pieces of one hash
            ids, n = self._encode([raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())])
            return ids, np.r_[0, np.cumsum(n)]
        self.block += 1
        self.used[entry] = self.block
        new = ~known
        if new.any():
            ids, n_ids = self._encode([raw[a : a + k] for a, k in zip(at[new].tolist(), n[new].tolist())])
            where = place[new]
            insert = lambda old, values: np.insert(old, where, values)
            self.hashes, self.used = insert(self.hashes, distinct[new]), insert(self.used, self.block)
            self.byte_at = insert(self.byte_at, len(self.bytes) + np.cumsum(n[new]) - n[new])
            self.id_at = insert(self.id_at, len(self.ids) + np.cumsum(n_ids) - n_ids)
            self.n_bytes, self.n_ids = insert(self.n_bytes, n[new]), insert(self.n_ids, n_ids)
            self.bytes, self.ids = np.concatenate([self.bytes, buf[ranges(at[new], n[new])]]), np.concatenate([self.ids, ids])
            place = place + np.cumsum(new) - new
        count = self.n_ids[place][of]
        out = self.ids[ranges(self.id_at[place][of], count)]
        if len(self.hashes) > CACHE or len(self.bytes) > CACHE_BYTES:
            self._forget(self.used > np.median(self.used))
        return out, np.r_[0, np.cumsum(count)][np.searchsorted(starts, edges)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null: none."""
        raw = [(t or "").encode() for t in texts]
        ids, at = self.encode_block(b"".join(raw), np.r_[0, np.cumsum([len(r) for r in raw], dtype=np.int64)])
        return np.split(ids, at[1:-1]) if texts else []

    def encode_rows(self, batch: pa.RecordBatch, end: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """doc_id, ids and where each row's begin (with the end of the last's), of a record batch's rows in blocks; end: an
        id behind each text's."""
        text = batch.column("text").fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
            low, high = int(offsets[at]), int(offsets[to])
            raw = memoryview(text.buffers()[2])[low:high].tobytes() if high > low else b""
            ids, begin = self.encode_block(raw, offsets[at : to + 1] - low)
            if end is not None:
                ids, begin = np.insert(ids, begin[1:], np.uint32(end)), begin + np.arange(len(begin))
            yield batch.column("doc_id").slice(at, to - at), ids, begin
            at = to


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]
