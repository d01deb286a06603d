import random
import re
from collections import defaultdict

import corpus_pipeline


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_stages_and_run(spark, tmp_path):
    """Clean documents pass, bad ones and copies go, secrets are replaced, all that the mix takes is packed."""
    r = random.Random(1)
    clean = [(i, words(r, 120) + "\n" + words(r, 60)) for i in range(40)]
    near = [(100 + i, clean[i][1] + " tail") for i in range(3)]
    bad = [(200, "one two three"), (201, None), (202, "a b c " * 80)]
    secret = [(300, words(r, 100) + "\npassword = hunter2hunter2")]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in [*clean, *near, *bad, *secret]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    at, ids = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = sorted(x["doc_id"] for x in at.collect())
    kept = [i for i, _ in [*clean, *near, *secret]]
    assert ids["quality"] == sorted(kept)
    assert ids["near_duplicates"] == ids["secrets"] == [i for i, _ in [*clean, *secret]]
    text = {x["doc_id"]: x["text"] for x in at.collect()}
    assert "hunter2" not in "".join(text.values())
    taken = defaultdict(int)
    for x in at.collect():
        taken[x["source"]] += len(re.findall(r"\S+", x["text"]))
    total = sum(len(re.findall(r"\S+", t)) for i, t in [*clean, *secret])
    assert abs(taken["s1"] - 2 * taken["s0"]) <= 400 and abs(sum(taken.values()) - total) <= 400
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = defaultdict(int)
    for x in out:
        copies[x["doc_id"]] += x["length"] / x["doc_tokens"]
    assert {i: round(n) for i, n in copies.items()} == {i: ids["mixing"].count(i) for i in set(ids["mixing"])}


def test_quality_stage_follows_the_groups(spark):
    """Junk goes where it fills two fifths of a group, where the group is tiny, and below the old fixed cutoffs."""
    r = random.Random(2)
    rows = []
    for i in range(300):
        rows.append((i, words(r, 200), "en", f"s{i % 5}", 0))
    for i in range(40):  # 40 of 100 documents of s0 with 0.8 symbols a word
        rows.append((1000 + i, " ".join(w + "#" * (k % 5 > 0) for k, w in enumerate(words(r, 200).split())), "en", "s0", 0))
    for i in range(3):  # 2.5 symbols a word, in a group of their own
        rows.append((2000 + i, " ".join(w + "#$" + "%" * (k % 2) for k, w in enumerate(words(r, 200).split())), "en", "tiny", 0))
    rows.append((3000, " ".join(w + "#" * (k % 12 == 0) for k, w in enumerate(words(r, 200).split())), "en", "s1", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"] for x in corpus_pipeline.quality(spark, docs, "").collect()}
    assert not [i for i in kept if i >= 1000] and len(kept) >= 295


def test_near_copies_by_five_words_and_null_ids(spark):
    """A copy with a five-word similarity of 0.8 to 0.9 goes; documents without id survive quality, copies and mixing."""
    r = random.Random(4)
    rows, gone = [], set()
    for i in range(12):
        base = words(r, 204).split()
        near = list(base)
        for k in (50, 100, 150, 175)[: 2 + i % 3]:  # 5 shingles each
            near[k] = f"changed{i}x{k}"
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (base, near))
        assert 10 * len(a & b) >= 8 * len(a | b)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
        gone.add(2 * i + 1)
    rows = [(i, t, "en", "s", 0) for i, t in [*rows, (None, words(r, 200))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, docs, ""), "")
    want = {x[0] for x in rows} - gone
    assert {x["doc_id"] for x in kept.collect()} == want
    assert {x["doc_id"] for x in corpus_pipeline.mixing(spark, kept, "").collect()} == want


def test_odd_rows(spark):
    """Null and repeated ids, one id with several texts, repeated rows, columns of odd names, and an empty table."""
    r = random.Random(6)
    a, b, c, d = (words(r, 200) for _ in range(4))
    rows = [(None, a), (None, b), (7, c), (7, d), (8, d), (8, d), (9, None)]
    rows = [(i, t, "en", "s", 0, 1, 2, 3, 4) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, row_key long, `row` int, n_words int"
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.quality(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((x["doc_id"] or 0, x["text"]) for x in kept.collect()) == sorted((i or 0, t) for i, t, *_ in rows if t)
    once = corpus_pipeline.near_duplicates(spark, kept, "")
    assert sorted((x["doc_id"] or 0, x["text"]) for x in once.collect()) == sorted([(0, a), (0, b), (7, c), (7, d)])
    mixed = corpus_pipeline.mixing(spark, corpus_pipeline.secrets(spark, once, ""), "")
    assert mixed.columns == docs.columns and sorted(x["text"] for x in mixed.collect()) == sorted([a, b, c, d])
    assert {x["doc_id"] for x in corpus_pipeline.packing(spark, mixed, "").collect()} == {None, 7}
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
