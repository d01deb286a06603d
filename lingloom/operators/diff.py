"""Differences of two texts by their longest common parts, near-linear on repetitive ones."""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections import Counter

#: Pairs of equal characters, for each character of both texts, up to which they are simply listed.
FEW = 24


def longest_matches(a: str, b: str) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length): the longest common part, of several the first in a and of these the first in b; then
    the one that this rule finds in what is right of it, as long as it is of the same length. Nothing so long is left between.

    b goes into a suffix automaton, whose states know where they first end; a is read through it once. Where several places
    of a hold a longest part, b's places of these parts are gathered by the states' ancestors of that length.
    """
    go: list[dict[str, int]] = [{}]
    size, link, first = [0], [-1], [-1]  # of each state: its longest part, its suffix link, where it first ends
    last, whole = 0, []  # the states of what b begins with
    for k, c in enumerate(b):
        new = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        first.append(k)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(go[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                first.append(first[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
        whole.append(new)
    state = n = best = 0
    ends: list[tuple[int, int]] = []
    for i, c in enumerate(a, 1):
        while state and c not in go[state]:
            state = link[state]
            n = size[state]
        if c in go[state]:
            state, n = go[state][c], n + 1
            if n > best:
                best, ends = n, [(i, state)]
            elif n == best:
                ends.append((i, state))
    if len(ends) < 2:
        return [(i - best, first[s] + 1 - best, best) for i, s in ends]
    places: dict[int, list[int]] = {s: [] for _, s in ends}
    up = list(range(len(go)))  # the ancestor that holds parts of the longest length
    for s in sorted(range(1, len(go)), key=size.__getitem__):
        if size[link[s]] >= best:
            up[s] = up[link[s]]
    for e, s in enumerate(whole, 1):
        if up[s] in places and e >= best:
            places[up[s]].append(e)
    out, at_a, at_b = [], 0, 0
    for i, s in ends:
        if i - best >= at_a and (k := bisect_left(places[s], at_b + best)) < len(places[s]):
            at_a, at_b = i, places[s][k]
            out.append((at_a - best, at_b - best, best))
    return out


def _after(a: str, i: int, b: str, j: int) -> int:
    """Length of what a from i on and b from j on have in common."""
    n, most, step = 0, min(len(a) - i, len(b) - j), 8
    while n < most:
        m = min(step, most - n)
        if a[i + n : i + n + m] != b[j + n : j + n + m]:
            while m > 1:  # the first difference lies in the next m characters
                half = m // 2
                if a[i + n : i + n + half] == b[j + n : j + n + half]:
                    n, m = n + half, m - half
                else:
                    m = half
            return n
        n, step = n + m, step * 2
    return n


def _before(a: str, i: int, b: str, j: int) -> int:
    """Length of what a up to i and b up to j have in common."""
    n, most, step = 0, min(i, j), 8
    while n < most:
        m = min(step, most - n)
        if a[i - n - m : i - n] != b[j - n - m : j - n]:
            while m > 1:
                half = m // 2
                if a[i - n - half : i - n] == b[j - n - half : j - n]:
                    n, m = n + half, m - half
                else:
                    m = half
            return n
        n, step = n + m, step * 2
    return n


def seeded_match(a: str, b: str) -> tuple[int, int, int] | None:
    """(start in a, start in b, length) of the longest common part, the first in a and of these the first in b; None where
    this is not the way to find it.

    It is no shorter than the common head and tail. So it holds one of the pieces of half that length into which b is cut,
    and all places of these in a show every part that is long enough. Repetitive texts have too many places.
    """
    least = max(_after(a, 0, b, 0), _before(a, len(a), b, len(b)))
    if not least:
        return None
    k, left = (least + 1) // 2, 8 + (len(a) + len(b)) // 4
    ends: dict[int, int] = {}  # by i - j, where in b the last part found ends
    best = (0, 0, 0)
    for j in range(0, len(b) - k + 1, k):
        piece = b[j : j + k]
        i = a.find(piece)
        while i >= 0:
            if not (left := left - 1):
                return None
            if ends.get(i - j, 0) <= j:
                back, on = _before(a, i, b, j), k + _after(a, i + k, b, j + k)
                ends[i - j] = j + on
                best = min(best, (-back - on, i - back, j - back))
            i = a.find(piece, i + 1)
    return best[1], best[2], -best[0]


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """Equal parts (start in a, start in b, length) in order: the longest, then those to its left and to its right in the
    same way; neighbours are joined. Exactly the blocks of Python's SequenceMatcher without junk."""
    todo, found = [(0, len(a), 0, len(b))], []
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        x, y = a[alo:ahi], b[blo:bhi]
        if not x or not y:
            continue
        if x == y:
            found.append((alo, blo, len(x)))
            continue
        in_y = Counter(y) if (seeded := seeded_match(x, y)) is None else None
        if seeded is not None:
            longest = [seeded]
        elif sum(in_y[c] * n for c, n in Counter(x).items()) <= FEW * (len(x) + len(y)):
            m = difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match(0, len(x), 0, len(y))
            longest = [(m.a, m.b, m.size)] if m.size else []
        else:
            longest = longest_matches(x, y)
        at_a, at_b = alo, blo
        for i, j, n in longest:
            found.append((alo + i, blo + j, n))
            todo.append((at_a, alo + i, at_b, blo + j))
            at_a, at_b = alo + i + n, blo + j + n
        if longest:
            todo.append((at_a, ahi, at_b, bhi))
    joined: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (*joined[-1][:2], joined[-1][2] + n)
        else:
            joined.append((i, j, n))
    return joined


def edits(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """(start and end in a, start and end in b) of what lies between the equal parts, in order."""
    out, at_a, at_b = [], 0, 0
    for i, j, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if at_a < i or at_b < j:
            out.append((at_a, i, at_b, j))
        at_a, at_b = i + n, j + n
    return out
