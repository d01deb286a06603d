import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lingloom.llm import merkle
from lingloom.llm.queries import SQL

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves, fan):
    """Levels up to the root, and for each leaf the siblings as (left, right) of each level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[k : k + fan])) for k in range(0, len(below), fan)])
    ways = []
    for k in range(len(leaves)):
        way = []
        for nodes in levels[:-1]:
            low = k // fan * fan
            way.append((nodes[low:k], nodes[k + 1 : low + fan]))
            k //= fan
        ways.append(way)
    return levels[-1][0], ways


def brute(rows, fan):
    groups = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        leaf = h("".join(map(part, (doc_id, source, lang, n_chars, text))))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        changed = h("".join(map(part, (doc_id, source, lang, n_chars + 1, text)))) if hit else leaf
        groups[lang].append((doc_id, leaf, changed))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[1] for x in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], fan) for g in order}
    root, over = tree([trees[g][0] for g in order], fan)
    out = []
    for k, g in enumerate(order):
        for (doc_id, leaf, changed), way in zip(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), trees[g][1]):
            way, end = way + over[k], changed
            for left, right in way:
                end = h("".join([*left, end, *right]))
            out.append((doc_id, leaf, trees[g][0], root, h("".join("".join(a + b) for a, b in way)), end, end == root))
    return out


def rows_of(n, langs, seed):
    r = random.Random(seed)
    return [(k if k % 11 else None, r.choice([None, "s", "é漢"]), r.choice(langs), r.choice([None, k]), r.choice([None, "", "x" * k, "naïve 漢字 | 3:abc"])) for k in range(n)]


@pytest.mark.parametrize("n, langs, fan, step", [(1, ["en"], 2, 8), (2, [None], 2, 1), (150, ["en", None, "zz", "é", ""], 2, 2), (150, ["en"], 2, 3), (90, ["a", "b"], 3, 2), (300, ["en", "de"], 2, 8)])
def test_manifest_by_brute_force(spark, n, langs, fan, step):
    """Trees of one level and of several stored ones, of one group and of many; null and repeated ids; nulls in all fields."""
    rows = rows_of(n, langs, n)
    rows += rows[: n // 10]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("grp", F.lit("x")).withColumn("hash", F.lit(1)).repartition(3)
    found = merkle.merkle_manifest(table, fan, step).select(COLUMNS).collect()
    assert Counter(map(tuple, found)) == Counter(brute(rows, fan))
    assert {r["verified"] for r in found if r["doc_id"] is None} <= {True}


def test_proofs_stand_by_themselves(spark):
    rows = rows_of(40, ["en", "de", None], 5)
    for r in merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA), step=2, keep=True).collect():
        assert merkle.folded(r["leaf"], r["way"]) == r["root"] and merkle.siblings_hash(r["way"]) == r["proof_sha256"]
        assert merkle.folded(h("another"), r["way"]) != r["root"]


def test_empty_table(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_by_brute_force():
    import duckdb

    rows = rows_of(60, ["en", None, "é"], 9)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    done = con.execute(SQL["op12_merkle"])
    names = [c[0] for c in done.description]
    assert Counter(tuple(r[names.index(c)] for c in COLUMNS) for r in done.fetchall()) == Counter(brute(rows, 2))
