import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lingloom.llm import anchors, suffix_array, suffix_tree
from lingloom.llm.anchors import sliding_anchor

from .conftest import TEXTS


def kept_words(rows, window):
    first = {}
    for i, t in rows:
        x = (t or "").encode().split()
        for k in range(len(x) - window + 1):
            g = tuple(x[k : k + window])
            first[g] = min(i, first.get(g, i))
    out = []
    for i, t in rows:
        x = (t or "").encode().split()
        gone = set()
        for k in range(len(x) - window + 1):
            if first[tuple(x[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(x), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(x) if k not in gone)).hexdigest()))
    return sorted(out)


def removed_bytes(rows, window):
    count = Counter(t[k : k + window] for _, t in rows for k in range(len(t) - window + 1))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if count[t[k : k + window]] > 1:
                gone[k : k + window] = True
        out.append((i, gone))
    return out


def test_words(spark, docs):
    got = sorted(tuple(r) for r in suffix_tree.drop_repeated_words(docs).drop("kept").collect())
    assert got == kept_words([*TEXTS, TEXTS[5]], 13)


def test_bytes(spark, docs):
    rows = [(i, (t or "").encode()) for i, t in [*TEXTS, TEXTS[5]]]
    expected = []
    for (i, gone), (_, t) in zip(removed_bytes(rows, 40), rows):
        spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
        expected.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    got = sorted(tuple(r) for r in suffix_array.drop_repeated_bytes(docs, window=40).drop("kept").collect())
    assert got == sorted(expected)


def test_empty_table_and_null_ids(spark, none):
    assert suffix_tree.drop_repeated_words(none).count() == 0
    assert suffix_array.drop_repeated_bytes(none).count() == 0
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(None, text), (5, text), (6, text)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in suffix_tree.drop_repeated_words(df).collect()} == {None: 0, 5: 0, 6: 200}


def deal_of(r, parts):
    """Some counters heavy, and some of those heavier."""
    some = lambda: np.array(sorted(r.sample(range(100), r.choice([0, 30, 80]))), np.uint64)
    return anchors.Deal(parts, 100, some(), some())


@pytest.mark.parametrize("seed", range(40))
def test_exchange_of_words_finds_what_brute_force_finds(seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdef") for _ in range(r.randint(1, 20))) for _ in range(5)]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 6)))) for i in range(r.randint(1, 12))]
    window = r.choice([2, 3, 5, 8, 13])
    gram, deal, blobs = min(window, r.choice([1, 2])), deal_of(r, 3), {}
    for b in range(3):
        ids, texts = [i for i, _ in rows[b::3]], [t.encode() for _, t in rows[b::3]]
        if (runs := suffix_tree.find(texts, window, gram)) is not None:
            part = deal.apply(runs)
            for p, x in suffix_tree.exchange(ids, texts, runs, part):
                blobs.setdefault(p, []).append(x)
    got = {i: np.zeros(len(t.split()), bool) for i, t in rows}
    for x in blobs.values():
        for d, s, e, _ in zip(*suffix_tree.meet(x, window)):
            got[d][s:e] = True
    assert [(i, int(got[i].sum())) for i, _ in rows] == [(i, n) for i, _, n, _ in kept_words(rows, window)]


def test_parts_follow_the_bytes_and_hot_prefixes_are_split(spark, monkeypatch):
    """One phrase with differing words around it fills most rows: its gram is too much for a part, and so is its half window;
    results stay those of brute force and no part holds much more than it should."""
    r = random.Random(8)
    phrase = " ".join(f"p{k}" for k in range(9))
    rows = [(i, " ".join([f"x{r.randrange(40)}", f"y{r.randrange(40)}", phrase, f"z{r.randrange(40)}", f"u{r.randrange(40)}"] * 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(anchors, "PART_BYTES", 4000)
    deal = anchors.dealt(df, lambda texts: suffix_tree.find(texts), 1 << 20)
    assert deal.parts >= anchors.SPREAD * sum(len(t) for _, t in rows) // 4000 and len(deal.heavy) and len(deal.heavier)
    runs = suffix_tree.find([t.encode() for _, t in rows])
    before = np.bincount((runs.gram(runs.anchor) % np.uint64(deal.parts)).astype(int), weights=runs.size(runs.low, runs.high)).max()
    part = deal.apply(runs)
    assert np.bincount(part, weights=runs.size(runs.low, runs.high)).max() < before / 4
    got = sorted(tuple(x) for x in suffix_tree.drop_repeated_words(df).drop("kept").collect())
    assert got == kept_words(rows, 13)


@pytest.mark.parametrize("seed", range(40))
def test_exchange_of_blocks_finds_what_brute_force_finds(seed):
    r = random.Random(seed)
    letters = b"ab" if seed % 3 == 0 else b"abcdefgh"
    pool = [bytes(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(6)]
    rows = [(i, b"".join(r.choice(pool) + bytes(r.choice(letters) for _ in range(r.randint(0, 8))) for _ in range(r.randint(0, 6)))) for i in range(r.randint(1, 12))]
    window = r.choice([3, 8, 20, 40])
    gram = min(window, r.choice([1, 3, 5, 8]))
    blobs = {}
    deal = deal_of(r, 3)
    for b in range(3):
        ids, texts = [i for i, _ in rows[b::3]], [t for _, t in rows[b::3]]
        if (runs := suffix_array.find(texts, window, gram)) is not None:
            part = deal.apply(runs)
            for p, x in suffix_array.exchange(ids, texts, runs, part):
                blobs.setdefault(p, []).append(x)
    got = {i: np.zeros(len(t), bool) for i, t in rows}
    for x in blobs.values():
        for d, s, e, _ in zip(*suffix_array.meet(x, window)):
            got[d][s:e] = True
    for i, gone in removed_bytes(rows, window):
        assert (got[i] == gone).all()


def test_merge_of_runs_is_a_suffix_array():
    r = random.Random(2)
    runs = []
    for _ in range(5):
        own = sorted({bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(20)})
        runs.append(suffix_array.decoded(suffix_array.front_coded(own)))
    order, lcp = suffix_array.merge_runs(runs)
    merged = [runs[a][1][b] for a, b in order]
    assert merged == sorted(x for _, own in runs for x in own)
    assert lcp[1:] == [suffix_array.common(a, b) for a, b in zip(merged, merged[1:])]


def test_anchor_is_the_leftmost_smallest():
    h = np.random.default_rng(0).integers(0, 50, 500).astype(np.uint64) << np.uint64(24)
    assert sliding_anchor(h, 7).tolist() == [i + int(np.argmin(h[i : i + 7])) for i in range(494)]


def brute_rows(rows, window):
    """Bytes left of every row: all that no string elsewhere, in whatever row, repeats."""
    return Counter((i, np.frombuffer(t, np.uint8)[~gone].tobytes()) for (i, gone), (_, t) in zip(removed_bytes(rows, window), rows))


def test_rows_of_one_id_and_of_none(spark):
    """Texts that are no copies stay whole, whatever other rows of their id lose; null ids lose bytes and no words."""
    texts = ["-".join(f"{c}{k}" for k in range(120)) for c in "abcd"]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (3, texts[3] + "z"), (4, "x" + texts[1]), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], bytes(r["kept"])) for r in suffix_array.drop_repeated_bytes(df).collect())
    assert got == brute_rows([(i, (t or "").encode()) for i, t in rows], 400) and got[2, texts[1].encode()] == 0 and got[3, b"z"] == 1
    rows = [(i, t and t.replace("-", " ")) for i, t in rows]
    df = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_removed"]) for r in suffix_tree.drop_repeated_words(df).collect())
    assert got == Counter([(1, 0), (2, 120), (2, 120), (2, 0), (None, 0), (None, 0), (None, 0), (3, 0), (4, 119), (4, 0), (5, 0)])


def shared_bytes(rows, width):
    """For every row, which bytes are covered by strings that another row holds."""
    holders = {}
    for k, (_, t) in enumerate(rows):
        for at in range(len(t) - width + 1):
            holders.setdefault(t[at : at + width], set()).add(k)
    out = []
    for i, t in rows:
        own = np.zeros(len(t), bool)
        for at in range(len(t) - width + 1):
            if len(holders[t[at : at + width]]) > 1:
                own[at : at + width] = True
        out.append((i, own))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_one_exchange_serves_a_short_window_too(seed):
    r = random.Random(seed)
    letters = b"ab" if seed % 3 == 0 else b"abcdefgh"
    pool = [bytes(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(6)]
    rows = [(i, b"".join(r.choice(pool) + bytes(r.choice(letters) for _ in range(r.randint(0, 8))) for _ in range(r.randint(0, 6)))) for i in range(r.randint(1, 12))]
    window = r.choice([8, 20, 40])
    short = r.choice([w for w in (3, 5, 8, 13, 20, 30, 40) if w <= window])
    gram = min(short, r.choice([1, 3, 5, 8]))
    blobs = {}
    for b in range(3):
        ids, texts = [i for i, _ in rows[b::3]], [t for _, t in rows[b::3]]
        if (runs := suffix_array.find(texts, window, gram, short)) is not None:
            part = anchors.Deal(3, 100, np.zeros(0, np.uint64), np.zeros(0, np.uint64)).apply(runs)
            for p, x in suffix_array.exchange(ids, texts, runs, part):
                blobs.setdefault(p, []).append(x)
    got = {i: np.zeros((2, len(t)), bool) for i, t in rows}
    for x in blobs.values():
        for d, s, e, _, passage in zip(*suffix_array.meet(x, window, short)):
            got[d][passage, s:e] = True
    for (i, gone), (_, shared) in zip(removed_bytes(rows, window), shared_bytes(rows, short)):
        assert (got[i][0] == gone).all() and (got[i][1] == shared).all()


def test_passages_shorter_than_the_window(spark):
    """A passage of 55 words in three rows is no repeat of 400 bytes, so nothing goes for it, but it is told; what a text
    repeats within itself is not, and rows of one id or of none are rows like any other."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 6)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage, again = some(55), some(55)
    assert suffix_array.PASSAGE <= len(passage) < suffix_array.WINDOW and len(again) < suffix_array.WINDOW
    rows = [(1, f"{some(90)} {passage} {some(70)}"), (2, f"{passage} {some(20)}"), (None, passage), (3, some(300)), (4, f"{again} {some(9)} {again}"), (5, passage[:255]), (6, None), (7, "")]
    whole = some(200)
    rows += [(8, whole), (8, whole), (8, some(80)), (9, passage[:300]), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_removed"], r["n_shared"], bytes(r["kept"])) for r in suffix_array.drop_repeated_bytes(df, short=suffix_array.PASSAGE).collect())
    raw = [(i, (t or "").encode()) for i, t in rows]
    found = zip(raw, removed_bytes(raw, suffix_array.WINDOW), shared_bytes(raw, suffix_array.PASSAGE))
    assert got == Counter((i, int(gone.sum()), int(own.sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()) for (i, t), (_, gone), (_, own) in found)
    told = {i: n for i, _, n, _ in got}
    assert told[1] >= len(passage) and told[2] >= len(passage) and told[9] == 300 and not told[3] and not told[4] and not told[5]
    assert suffix_array.drop_repeated_bytes(df.limit(0), short=suffix_array.PASSAGE).count() == 0
