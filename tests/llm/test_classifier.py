import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingloom.llm import classifier

from .conftest import TEXTS


def brute_statistics(text):
    """The same statistics one by one."""
    t = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if x]
    count = lambda chars: sum(c in chars for c in t)
    n, w = max(len(t), 1), max(len(words), 1)
    lower, upper = sum("a" <= c <= "z" for c in t), sum("A" <= c <= "Z" for c in t)
    sizes = [len(x) for x in words]
    mean = sum(sizes) / w
    pairs = list(zip(words, words[1:]))
    known = lower + upper + sum(c.isdigit() and c.isascii() for c in t) + count("#*$%&|<>!?.,;: \t\r\n\x0b\x0c") + sum(ord(c) > 127 for c in t)
    return [
        math.log1p(len(t)), math.log1p(len(words)), mean, math.sqrt(max(sum(x * x for x in sizes) / w - mean**2, 0)), math.log1p(max(sizes, default=0)), upper / max(lower + upper, 1),
        sum(c.isdigit() and c.isascii() for c in t) / n, count("#*$%&|<>") / w if words else 0, sum(x[-1] in "#*$%&|<>" for x in words) / w, count("!?") / w if words else 0,
        count(".,;:") / w if words else 0, count(" \t\r\x0b\x0c") / n, count("\n") / w if words else 0, sum(ord(c) > 127 for c in t) / n, (len(t) - known) / n, len(set(words)) / w,
        max(Counter(words).values(), default=0) / w, len(set(pairs)) / max(len(words) - 1, 1), sum(a == b for a, b in pairs) / max(len(words) - 1, 1),
        (len(lines) - len(set(lines))) / max(len(lines), 1), math.log1p(len(t) / max(len(lines), 1)),
    ]


def test_statistics_by_brute_force():
    r = random.Random(2)
    letters = "ab  \n\tAé漢!.,#$|0\U0001f600'\"\x07"
    texts = [t for _, t in TEXTS] + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["x" * 100_000, "\n\n", "a\n"]
    np.testing.assert_allclose(classifier.statistics(texts), [brute_statistics(t) for t in texts], rtol=1e-5, atol=1e-4)
    assert classifier.statistics([]).shape == (0, len(classifier.STATISTICS))


def sample(n, seed):
    """Clean prose, and junk of three kinds."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghilmnorst", k=r.randint(1, 9))) for _ in range(400)]
    rows = []
    for k in range(n):
        text = r.choices(words, k=r.randint(20, 200))
        good = r.random() < 0.8
        if not good:
            kind = r.randint(0, 2)
            text = [w + "%%%" for w in text] if kind == 0 else [w.upper() + "!!" for w in text] if kind == 1 else [text[0]] * len(text)
        rows.append((k, " ".join(text), int(good)))
    return rows


def test_trees_by_brute_force():
    """Rows go down one by one where a walk over the arrays says; the first split is the best of all."""
    r = np.random.default_rng(4)
    x = r.integers(0, 40, (500, 5)).astype(np.float32)
    y = ((x[:, 3] > 17) ^ (r.random(500) < 0.1)).astype(float)
    trees = classifier.fit(x, y, trees=5)
    for row, p in zip(x, trees.score(x)):
        odds = trees.start
        for t in range(5):
            node = 0
            while node < 2**classifier.DEPTH - 1:
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.split[t, node])
            odds += trees.value[t, node - (2**classifier.DEPTH - 1)]
        assert abs(1 / (1 + math.exp(-odds)) - p) < 1e-9
    p = 1 / (1 + math.exp(-trees.start))

    def gain(f, v):
        left = x[:, f] <= v
        part = lambda m: (y[m] - p).sum() ** 2 / (m.sum() * p * (1 - p) + classifier.L2)
        return part(left) + part(~left)

    assert gain(trees.feature[0, 0], trees.split[0, 0]) >= max(gain(f, v) for f in range(5) for v in range(39)) - 1e-9
    assert trees.feature[0, 0] == 3


@pytest.mark.parametrize("y", [np.zeros(0), np.ones(8), np.zeros(8)])
def test_labels_of_one_kind(y):
    score = classifier.fit(np.zeros((len(y), 3), np.float32), y).score(np.zeros((2, 3), np.float32))
    assert np.allclose(score, (y.sum() + 1) / (len(y) + 2))


def test_held_out_documents(spark):
    """Documents that were not learned from are told apart, with the production settings; labels of theirs do not matter."""
    rows = sample(1500, 7)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    wrong = [(i, (1 - y) if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    found = classifier.classify(docs, spark.createDataFrame(wrong, "doc_id long, quality int").repartition(2)).collect()
    assert len(found) == 1500 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    truth = {i: y for i, _, y in rows}
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (6, 0), (6, 0), (None, 1), (999, 0), (12, None)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    extra = docs.unionByName(spark.createDataFrame([(None, "no id")], "doc_id long, text string"), allowMissingColumns=True).withColumn("score", F.lit(1)).withColumn("quality", F.lit("a"))
    found = classifier.classify(extra, labels).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in extra.collect())
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    assert len({r["score"] for r in found if r["doc_id"] == 6}) == 1
    assert classifier.classify(none, labels).count() == 0
    assert {r["score"] for r in classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_sample_is_bounded(spark):
    rows = sample(600, 8)
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    x, y = classifier.training_rows(docs, labels, rows=100)
    assert 60 < len(x) == len(y) < 150
    assert len(classifier.training_rows(docs.unionByName(docs), labels, rows=10_000)[0]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows)
