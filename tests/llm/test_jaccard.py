import random
from collections import defaultdict

import numpy as np
import pytest

from lingloom.llm import jaccard
from lingloom.llm.graph import components

from .conftest import TEXTS


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, t in sets.items():
            if i < j and s and t and 100 * len(s & t) >= 90 * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute(rows)


def test_edge_cases(spark, docs):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect())
    want = brute(TEXTS)
    assert got == sorted((i, *want[i]) for i, _ in [*TEXTS, TEXTS[5]])


def test_near_copies_of_all_sizes(spark):
    """Sets of 9 to 45 shingles with up to three words changed, so that both sides of the dividing size and the border itself
    are met; chains link further than pairs."""
    r = random.Random(5)
    rows = []
    for n in range(9, 46):
        base = [f"w{r.randrange(10**6)}" for _ in range(n + 2)]
        for _ in range(6):
            x = list(base)
            for _ in range(r.randint(0, 2)):
                x[r.choice([0, 1, n, n + 1, r.randrange(n + 2)])] = f"v{r.randrange(10**6)}"
            if r.random() < 0.3:
                x.append(f"u{r.randrange(10**6)}")
            rows.append((len(rows), " ".join(x)))
    check(spark, rows)


def test_large_group_just_below_and_above(spark, monkeypatch):
    """One family whose members are often just below the similarity, with a smallest set like none of them, in lists of
    several blocks."""
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 8)
    r = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base[:111]))]
    for k in range(60):
        x = list(base)
        for _ in range(r.randint(0, 4)):
            x[r.randrange(100, 120)] = f"v{r.randrange(10**6)}"
        rows.append((k + 1, " ".join(x)))
    check(spark, rows)


def test_empty_table(none):
    assert jaccard.jaccard_components(none).count() == 0


@pytest.mark.parametrize("n", range(1, 60))
def test_bounds(n):
    for m in range(n, 70):
        least = next((i for i in range(n + 1) if 100 * i >= 90 * (n + m - i)), None)
        if least is not None:
            assert least >= jaccard.required(m) and jaccard.overlap(n, m) == least
            if n <= jaccard.LARGEST_LIGHT:
                assert jaccard.required(m) in jaccard.subset_sizes(n)


def test_sketch_never_rules_out_similar_sets():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(10, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[int(rng.integers(0, n // 10)) :], rng.integers(0, 2**63, int(rng.integers(0, n // 15 + 1))).astype(np.uint64)])
        i = len(np.intersect1d(a, b))
        if 100 * i >= 90 * (len(a) + len(b) - i):
            assert jaccard.Sketched(len(a), jaccard.parity_sketch(a)).may_be_similar(jaccard.Sketched(len(b), jaccard.parity_sketch(b)))


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60) if k != 30] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)]
    root = defaultdict(lambda: None)

    def find(x):
        while root[x] is not None and root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for a, b in edges if a != b for x in (a, b)}}
