import os
import random

import pytest
from pyspark.sql import functions as F

from lingloom.operators import alignment, consistency

LISTED = {"x": ["a", "b", "x"], "y": ["c"], "z": ["z", "a"]}


def made(seed, n):
    """Pairs over few letters, so that n-grams have rivals; some share a key, some lack a key or a side."""
    r, rows = random.Random(seed), []
    for k in range(n):
        src = ["".join(r.choice("abcxyzdé ,") for _ in range(r.choice((3, 9, 30)))) for _ in range(r.randint(1, 3))]
        tgt = ["".join(r.choice(LISTED.get(c, [c])) if r.random() < 0.93 else r.choice("abcdz") for c in s) for s in src]
        rows.append((r.choice("pq"), k, ".".join(src) + ".", ".".join(tgt) + "." * r.randint(1, 2)))
    rows += [("p", 0, "abcd abd", "abcd abx"), ("p", 0, "abca", "abza"), (None, 1, "abcd", "abcd"), ("q", None, "abcd", "abcd"), ("q", n, None, "abc"), ("q", n + 1, "abc", None), ("q", n + 2, "", "")]
    return rows


def by_joins(pairs, forms, profile):
    sent = consistency.sentence_pairs(pairs, profile)
    return consistency.alignment_counts(consistency.competitive_abstain(consistency.align_ngrams(sent, forms, profile), sent))


def sorted_rows(df):
    return sorted(map(tuple, df.select("book_id", "s_ng", "t_ng", "fixed", "n").collect()))


@pytest.mark.parametrize("least, most", [(3, 4), (2, 5)])
def test_alignment_in_place_is_that_of_the_joins(spark, monkeypatch, least, most):
    pairs = spark.createDataFrame(made(least, 300), "book_id string, pair_pos long, src string, tgt string")
    profile, forms = consistency.ScriptProfile(run="a-z", align_min=least, align_max=most, terminators="."), consistency.Forms(LISTED)
    expected = sorted_rows(by_joins(pairs, forms, profile))
    assert expected and sorted_rows(consistency.aligned_counts(pairs, forms, profile)) == expected
    one = pairs.where("pair_pos > 0")
    expected = sorted_rows(by_joins(one, forms, profile))
    sent = consistency.sentence_pairs(one, profile).where("book_id IS NOT NULL").coalesce(1)
    for room in (None, 3, 0):  # books and sentences at once; none: one by one
        with monkeypatch.context() as m:
            for name, value in (("MOST", 50), ("WAITING", 200), ("SENTENCES", 7), ("LONG", 5), ("LISTED", 1), ("KEPT", 3)) if room is not None or least == 2 else ():
                m.setattr(alignment, name, value)
            if room is not None:
                m.setattr(alignment.Packed, "room", lambda self: room)
            parts = alignment.counted_in_place(sent, LISTED, "[a-z]+", least, most)
            assert sorted_rows(parts.groupBy("book_id", "s_ng", "t_ng", "fixed").agg(F.sum("n").alias("n"))) == expected


def test_alignment_of_more_characters_than_have_numbers():
    """Every batch brings new characters, so that numbers get longer until sentences are aligned one by one."""
    from collections import Counter

    import pyarrow as pa

    class Frame:
        schema = {"book_id": type("", (), {"dataType": type("", (), {"simpleString": staticmethod(lambda: "string")})})}
        select = lambda self, *_: self
        mapInArrow = lambda self, f, _: f

    r, rows, expected = random.Random(2), [], Counter()
    for k in range(60):
        src = "".join(chr(0x4E00 + r.randrange(20 + k * k * 5)) for _ in range(60)) + r.choice(("", "x一丁", "\U0001f600"))
        rows.append((r.choice("pq"), src, "".join(c for c in src.replace("x", "a") if r.random() < 0.97)))
    for most in (4, 6):
        aligner, books = alignment.Aligner(LISTED, "[一-龥a-z]+", 3, most), {}
        for b, s, t in rows:
            aligner.align(s, t, *books.setdefault(b, (Counter(), Counter())))
        expected = {**{(b, g, g, True): n for b, (same, _) in books.items() for g, n in same.items()}, **{(b, *k): n for b, (_, other) in books.items() for k, n in other.items()}}
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows[k : k + 4])], ["book_id", "src", "tgt"]) for k in range(0, 60, 4)]
        got: Counter = Counter()
        for batch in alignment.counted_in_place(Frame(), LISTED, "[一-龥a-z]+", 3, most)(iter(batches)):
            for *key, n in zip(*(batch.column(c).to_pylist() for c in range(5))):
                got[tuple(key)] += n
        assert dict(got) == expected


def written(spark):
    tops = [spark.conf.get("spark.local.dir"), spark.conf.get("spark.checkpoint.dir").removeprefix("file:")]
    return sum(os.path.getsize(os.path.join(d, f)) for top in tops for d, _, names in os.walk(top) for f in names)


def test_alignment_writes_no_more_than_it_reads(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmnopq", k=r.randint(4, 9))) for _ in range(400)]
    rows = [("b", k, t := ". ".join(" ".join(r.choices(words, k=8)) for _ in range(30)), t) for k in range(300)]
    pairs = spark.createDataFrame(rows, "book_id string, pair_pos long, src string, tgt string")
    before = written(spark)
    assert consistency.aligned_counts(pairs, consistency.Forms(LISTED), consistency.ScriptProfile(run="a-z", terminators=".")).count()
    assert written(spark) - before < sum(len(x[2]) for x in rows)
