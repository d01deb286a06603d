"""Aligning the n-grams of a sentence where the sentence is: what leaves its task are counts alone."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Runs up to this length are likely to return, so their n-grams are kept; of so many runs and forms at once.
SHORT, KEPT = 32, 100_000
#: Counts that a task gathers before it passes them on, and characters from which a sentence's windows are listed once.
MOST, LONG = 300_000, 1000
#: Forms of one n-gram that are listed beforehand.
LISTED = 512


class Aligner:
    """consistency.align_ngrams and competitive_abstain for one sentence after the other.

    An all-fixed n-gram is aligned with itself if the target has it. It could also be a form of a target n-gram that differs
    in one place but its first; but where that target n-gram stands in the source sentence, or any second window of it is as
    close, the pair is given up. So only target n-grams that are new are looked up, and need one close window alone.
    """

    def __init__(self, forms: dict[str, list[str]], run: str, least: int, most: int) -> None:
        self.runs, self.sizes = re.compile(run).findall, range(least, most + 1)
        self.convertible = frozenset("".join(forms))
        self.first = {s: {t for t in ts if len(t) == 1} for s, ts in forms.items()}
        self.known: dict[str, tuple[frozenset[str], frozenset[str]]] = {}
        self.forms: dict[str, tuple[str, ...] | None] = {}

    def _grams(self, run: str) -> tuple[frozenset[str], frozenset[str]]:
        """The n-grams of a run without convertible characters, and the others."""
        every = {run[i : i + n] for n in self.sizes for i in range(len(run) - n + 1)}
        fixed = every if self.convertible.isdisjoint(run) else {g for g in every if self.convertible.isdisjoint(g)}
        return frozenset(fixed), frozenset(every - fixed)

    def _of(self, runs: Iterable[str]) -> tuple[set[str], set[str]]:
        fixed: set[str] = set()
        mixed: set[str] = set()
        known = self.known
        for run in runs:
            found = known.get(run)
            if found is None:
                found = self._grams(run)
                if len(run) <= SHORT:
                    if len(known) >= KEPT:
                        known.clear()
                    known[run] = found
            fixed |= found[0]
            if found[1]:
                mixed |= found[1]
        return fixed, mixed

    def _places(self, gram: str) -> list[set[str]]:
        """What may stand in each place of a form: the first has a listed form of a convertible character, never itself unlisted."""
        rest = [{c} | (self.first.get(c, set()) if c in self.convertible else set()) for c in gram]
        rest[0] = self.first.get(gram[0], set()) if gram[0] in self.convertible else {gram[0]}
        return rest

    def _listed(self, gram: str) -> tuple[str, ...] | None:
        """All forms of an n-gram; None: too many."""
        if gram not in self.forms:
            if len(self.forms) >= KEPT:
                self.forms.clear()
            places = self._places(gram)
            self.forms[gram] = tuple(map("".join, itertools.product(*places))) if math.prod(map(len, places)) <= LISTED else None
        return self.forms[gram]

    def align(self, src: str | None, tgt: str | None, same: Counter, other: Counter) -> None:
        """Counts in same the all-fixed n-grams aligned with themselves, in other (source, target, fixed) all else."""
        if src is None or tgt is None:
            return
        ours = set(self.runs(src))
        fixed, mixed = self._of(ours)
        theirs = ours if src == tgt else set(self.runs(tgt))
        new: list[str] = []
        if theirs == ours:
            target = mixed
            same.update(fixed)
        else:
            target = set().union(*self._of(theirs))
            same.update(fixed & target)
            new = [t for t in set().union(*self._of(theirs - ours)) - fixed - mixed if t not in src]
        for s in mixed:
            listed = self._listed(s)
            if listed is None:
                places = self._places(s)
                listed = [t for t in (target | fixed if theirs == ours else target) if len(t) == len(s) and all(c in p for c, p in zip(t, places))]
            for t in listed:
                if t in target or theirs == ours and t in fixed:
                    other[s, t, False] += 1
        close = None
        for t in new:
            if close is None:
                close = Close(src)
            if (s := close.alone(t, fixed)) is not None:
                other[s, t, True] += 1


class Close:
    """The windows of a text that differ from an n-gram in one place."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.listed: dict[int, tuple[dict[str, list[str]], dict[str, list[str]]]] = {}

    def _windows(self, gram: str) -> Iterator[str]:
        """Windows that are equal in one half: all that differ in one place are among them."""
        n, text = len(gram), self.text
        h = n // 2
        if len(text) <= LONG:
            for part, at in ((gram[:h], 0), (gram[h:], h)):
                p = text.find(part, at)
                while p >= 0:
                    yield text[p - at : p - at + n]
                    p = text.find(part, p + 1)
            return
        if n not in self.listed:
            halves: tuple[dict[str, list[str]], dict[str, list[str]]] = ({}, {})
            for w in {text[i : i + n] for i in range(len(text) - n + 1)}:
                halves[0].setdefault(w[:h], []).append(w)
                halves[1].setdefault(w[h:], []).append(w)
            self.listed[n] = halves
        first, second = self.listed[n]
        yield from first.get(gram[:h], ())
        yield from second.get(gram[h:], ())

    def alone(self, gram: str, fixed: set[str]) -> str | None:
        """The only close window of a gram that the text does not hold, if it is one of fixed and has the gram's first character."""
        found = None
        for w in self._windows(gram):
            if w != found and len(w) == len(gram) and sum(map(str.__ne__, w, gram)) == 1:
                if found is not None or w[0] != gram[0] or w not in fixed:
                    return None
                found = w
        return found


class Packed:
    """The same for many sentences at once: n-grams as numbers, a sentence's distinct ones by sorting, counts as sorted arrays.

    A character has a number from 1 in the order in which the task meets it; 0 stands for the place that is left out where
    n-grams are compared without one. A number of so many bits a character has room for the sentence or the book before it.
    """

    def __init__(self, aligner: Aligner, run: str) -> None:
        self.aligner, self.inside = aligner, re.compile(run)
        self.numbers = np.zeros(0x110000, np.int64)
        self.chars, self.script, self.loose = np.zeros(1, np.uint32), np.zeros(1, bool), np.zeros(1, bool)
        self.bits = 6
        self.found: dict[str, list[tuple[str, str, int]]] = {}  # forms of an n-gram, with their numbers

    def number(self, texts: list[str]) -> None:
        """Numbers the characters of texts; where they need more bits than before, earlier numbers of n-grams end."""
        new = sorted(c for c in set().union(*texts) if not self.numbers[ord(c)])
        if new:
            self.numbers[[ord(c) for c in new]] = np.arange(len(self.chars), len(self.chars) + len(new))
            self.chars = np.concatenate([self.chars, np.array([ord(c) for c in new], np.uint32)])
            self.script = np.concatenate([self.script, [self.inside.fullmatch(c) is not None for c in new]])
            self.loose = np.concatenate([self.loose, [c in self.aligner.convertible for c in new]])
        needed = len(self.chars).bit_length()
        if needed > self.bits:
            self.bits = needed
            self.found.clear()

    def room(self) -> int:
        """Sentences, or books, that have room before an n-gram."""
        free = 62 - self.bits * self.aligner.sizes[-1]
        return 1 << free if free >= 0 else 0

    def _windows(self, texts: list[str], at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows of texts with the sentence before them, and which of them lie in the script. at: the sentences."""
        c = self.numbers[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        sent = np.repeat(at, np.fromiter(map(len, texts), np.int64, len(texts)))
        m = len(c) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        code, ours = sent[:m].copy(), self.script[c]
        inside = ours[:m].copy()
        for i in range(n):
            code <<= self.bits
            code |= c[i : i + m]
            inside &= ours[i : i + m]
        whole = sent[:m] == sent[n - 1 :]
        return code[whole], inside[whole]

    def _fixed(self, codes: np.ndarray, n: int) -> np.ndarray:
        out, low = np.ones(len(codes), bool), (1 << self.bits) - 1
        for i in range(n):
            out &= ~self.loose[(codes >> (i * self.bits)) & low]
        return out

    def text(self, codes: np.ndarray, n: int) -> list[str]:
        low = (1 << self.bits) - 1
        places = [self.chars[(codes >> ((n - 1 - i) * self.bits)) & low] for i in range(n)]
        return np.ascontiguousarray(np.stack(places, 1).astype("<u4")).view(f"<U{n}")[:, 0].tolist() if len(codes) else []

    def _code(self, gram: str) -> int | None:
        code = 0
        for c in gram:
            number = int(self.numbers[ord(c)])
            if not number:
                return None
            code = code << self.bits | number
        return code

    def align(self, src: list[str], tgt: list[str], books: np.ndarray, other: list[Counter]) -> Iterator[tuple[int, np.ndarray]]:
        """For every n the n-grams aligned with themselves, with their book before them, one a sentence; the rest is counted in
        other, by book, as Aligner.align does."""
        differ = np.array([s != t for s, t in zip(src, tgt)], bool)
        which = np.flatnonzero(differ)
        theirs = [tgt[k] for k in which]
        for n in self.aligner.sizes:
            width = n * self.bits
            low = (1 << width) - 1
            every, inside = self._windows(src, np.arange(len(src)), n)
            ours = _distinct(every[inside])
            fixed = self._fixed(ours, n)
            every_t, inside_t = self._windows(theirs, which, n)
            target = _distinct(every_t[inside_t])
            has = ~differ[ours >> width]
            has[~has] = _among(ours[~has], target)
            same = ours[fixed & has]
            yield n, books[same >> width] << width | same & low
            self._mixed(ours[~fixed], n, ours[~differ[ours >> width]], target, books, other)
            new = target[~_among(target, ours)]
            if len(new):
                touched = np.zeros(len(src), bool)
                touched[new >> width] = True
                windows = _distinct(every[touched[every >> width]])
                new = new[~_among(new, windows)]
                self._close(new, n, windows, ours[fixed], books, other)

    def _mixed(self, grams: np.ndarray, n: int, alike: np.ndarray, target: np.ndarray, books: np.ndarray, other: list[Counter]) -> None:
        width = n * self.bits
        codes, back = np.unique(grams & ((1 << width) - 1), return_inverse=True)
        if not len(codes):
            return
        known, low = _distinct(np.concatenate([alike, target])), (1 << width) - 1
        pairs: list[tuple[str, str, int]] = []
        names, many = self.text(codes, n), np.zeros(len(codes), np.int64)
        for k, s in enumerate(names):
            found = self.found.get(s)
            if found is None:
                listed = self.aligner._listed(s)
                every = listed is not None
                if not every:
                    places = self.aligner._places(s)
                    held = self.text(_distinct(known[np.isin(known >> width, grams[back == k] >> width)] & low), n)
                    listed = [t for t in held if all(c in p for c, p in zip(t, places))]
                found = [(s, t, code) for t in listed if (code := self._code(t)) is not None]
                if every and len(found) == len(listed):  # no character that might get its number later
                    if len(self.found) >= KEPT:
                        self.found.clear()
                    self.found[s] = found
            pairs += found
            many[k] = len(found)
        if not pairs:
            return
        begins, times = np.cumsum(many) - many, many[back]
        pair = np.repeat(begins[back] - np.cumsum(times) + times, times) + np.arange(times.sum())  # every form of every sentence's n-gram
        sent = np.repeat(grams >> width, times)
        met = _among(sent << width | np.array([c for _, _, c in pairs], np.int64)[pair], known)
        for key, m in zip(*(x.tolist() for x in np.unique(books[sent[met]] * len(pairs) + pair[met], return_counts=True))):
            other[key // len(pairs)][pairs[key % len(pairs)][0], pairs[key % len(pairs)][1], False] += m

    def _close(self, new: np.ndarray, n: int, windows: np.ndarray, fixed: np.ndarray, books: np.ndarray, other: list[Counter]) -> None:
        """Pairs of a new n-gram with its only close window, if that is one of fixed and differs in no first place."""
        width, low = n * self.bits, (1 << self.bits) - 1
        rivals, first, place = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        for i in range(n):  # the place left out
            mask = ~(low << ((n - 1 - i) * self.bits))
            left = windows & mask
            order = np.argsort(left, kind="stable")
            left = left[order]
            lo, hi = np.searchsorted(left, new & mask), np.searchsorted(left, new & mask, "right")
            met = hi > lo
            rivals += hi - lo
            first[met] = windows[order[lo[met]]]
            place[met] = i
        alone = (rivals == 1) & (place > 0)
        alone[alone] = _among(first[alone], fixed)
        s, t, low = first[alone], new[alone], (1 << width) - 1
        for b, x, y in zip(books[t >> width].tolist(), self.text(s & low, n), self.text(t & low, n)):
            other[b][x, y, True] += 1


def _distinct(some: np.ndarray) -> np.ndarray:
    """In order; by sorting, which is faster here than np.unique's table."""
    some = np.sort(some)
    return some[np.append(True, some[1:] != some[:-1])] if len(some) else some


def _among(some: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of some are in the sorted array known."""
    if not len(known):
        return np.zeros(len(some), bool)
    return known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some


#: Sentences and characters that are aligned at once, and numbers that wait to be counted.
SENTENCES, CHARACTERS, WAITING = 4096, 1 << 19, 4_000_000


def counted_in_place(sent_pairs: DataFrame, forms: dict[str, list[str]], run: str, least: int, most: int) -> DataFrame:
    """book_id, s_ng, t_ng, fixed, n: the number of sentences (rows of book_id, src, tgt) so far as one task saw them, so a
    key has several rows. A task holds so many counts at most. Characters too many to be numbered are aligned one by one."""
    kind = sent_pairs.schema["book_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(forms, run, least, most)
        packed = Packed(aligner, run)
        numbers: dict = {}  # of books
        other: list[Counter] = []
        single: list[Counter] = []  # n-grams aligned with themselves, one by one
        waiting: dict[int, list] = {n: [] for n in aligner.sizes}  # numbers and counts
        type_ = None

        def merge() -> None:
            for n, parts in waiting.items():
                if len(parts) > 1:
                    codes, counts = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(codes)
                    codes, begins = np.unique(codes[order], return_index=True)
                    waiting[n] = [(codes, np.add.reduceat(counts[order], begins) if len(begins) else counts)]

        def batch_of(book: list, s: list, t: list, fixed: list, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(book, type_), pa.array(s, pa.string()), pa.array(t, pa.string()), pa.array(fixed, pa.bool_()), pa.array(n, pa.int64())], ["book_id", "s_ng", "t_ng", "fixed", "n"])

        def rows() -> Iterator[pa.RecordBatch]:
            merge()
            named = list(numbers)
            for n, parts in waiting.items():
                for codes, counts in parts:
                    for k in range(0, len(codes), 50_000):
                        own = codes[k : k + 50_000]
                        grams = packed.text(own & ((1 << n * packed.bits) - 1), n)
                        yield batch_of([named[b] for b in (own >> n * packed.bits).tolist()], grams, grams, [True] * len(own), counts[k : k + 50_000])
                parts.clear()
            for b, (same, rest) in enumerate(zip(single, other)):
                keys = [*((g, g, True) for g in same), *rest]
                for k in range(0, len(keys), 50_000):
                    s, t, fixed = zip(*keys[k : k + 50_000])
                    yield batch_of([named[b]] * len(s), list(s), list(t), list(fixed), [same[x] if f and x == y else rest[x, y, f] for x, y, f in zip(s, t, fixed)])
                same.clear()
                rest.clear()

        def full() -> bool:
            if sum(len(p[0]) for parts in waiting.values() for p in parts) >= WAITING:
                merge()
            return sum(len(p[0]) for parts in waiting.values() for p in parts) >= WAITING // 2 or sum(map(len, other)) + sum(map(len, single)) >= MOST

        def align(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            own = list(dict.fromkeys(b for b, _, _ in group))
            chars = [x for _, s, t in group for x in ((s,) if s == t else (s, t))]
            known = len(packed.chars) + len({c for c in set().union(*chars) if not packed.numbers[ord(c)]})
            if known.bit_length() > packed.bits or len(numbers) + len(own) > packed.room():
                yield from rows()  # numbers of fewer bits end here
            if len(numbers) + len(own) > packed.room():
                numbers.clear()
                other.clear()
                single.clear()
            for b in own:
                if b not in numbers:
                    numbers[b] = len(numbers)
                    other.append(Counter())
                    single.append(Counter())
            packed.number(chars)
            if len(numbers) > packed.room() or len(group) > packed.room():
                for b, s, t in group:
                    aligner.align(s, t, single[numbers[b]], other[numbers[b]])
                return
            books = np.array([numbers[b] for b, _, _ in group], np.int64)
            for n, codes in packed.align([s for _, s, _ in group], [t for _, _, t in group], books, other):
                waiting[n].append(np.unique(codes, return_counts=True))

        for batch in batches:
            type_ = batch.schema.field("book_id").type
            group, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("book_id", "src", "tgt"))):
                if row[1] is not None and row[2] is not None:
                    group.append(row)
                    size += len(row[1])
                if len(group) >= min(SENTENCES, max(packed.room(), 1)) or size >= CHARACTERS:
                    yield from align(group)
                    group, size = [], 0
                    if full():
                        yield from rows()
            if group:
                yield from align(group)
                if full():
                    yield from rows()
        yield from rows()

    return sent_pairs.select("book_id", "src", "tgt").mapInArrow(count, f"book_id {kind}, s_ng string, t_ng string, fixed boolean, n bigint")
