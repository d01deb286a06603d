import functools
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lingloom.llm import align
from lingloom.llm.tokens import vocabulary

from .conftest import TEXTS

ODD = ["<|endoftext|> plain", "</s> <s> <unk>", "a  b   ", " ", "▁x", "été ﬁ ½　漢字かな", "x" * 700, "a\r\n\tb\0c", "naïve café", "\U0001f600\U0001f468‍\U0001f469 ok", "<0x0A>", "no_space" * 300]


@functools.cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    return a, b


def brute_tokens(text):
    """Ids and bytes of either side by the libraries; bytes of a by its own decoder, tokens that cut characters by theirs."""
    a, b = libraries()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    table = align.byte_level_tokens(a)
    bytes_a = [table[i] for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else ([], [], [], [])


def brute_groups(text):
    ids_a, bytes_a, ids_b, bytes_b = brute_tokens(text) if text else ([], [], [], [])

    def ends(tokens):
        out = [0]
        for t in tokens:
            out.append(out[-1] + len(t))
        return out[1:]

    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    groups, at = [], 0
    for e in sorted(set(ends_a) & set(ends_b)):
        groups.append(([i for i, x in zip(ids_a, ends_a) if at < x <= e], [i for i, x in zip(ids_b, ends_b) if at < x <= e]))
        at = e
    return ids_a, ids_b, groups


def brute(texts):
    each = [brute_groups(t) for t in texts]
    links = [[(x, y) for a, b in g for x in a for y in b] for _, _, g in each]
    count = Counter(p for own in links for p in set(own))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for (ids_a, ids_b, groups), own in zip(each, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        rows.append((len(ids_a), len(ids_b), len(groups), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return rows


def test_coders_equal_the_libraries():
    a, b = libraries()
    one, r = align.aligner(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")), random.Random(3)
    letters = ["a", "b", " ", "  ", "the", "é", "\n", "漢", ".", "!", "   ", "\t", "</s>", "1", "\xa0", "<|endoftext|>", "\U0001f600"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    raw = [(" " + t).encode() for t in texts]
    ids, at = one.coder_b.encode_block(raw)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [b.encode(t) for t in texts]
    found = one.coder_a.encode([" " + t for t in texts])
    assert [x.tolist() for x in found] == [a.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_blocks_by_brute_force():
    """Groups, links and pairs of blocks of odd texts, some of which the ids of one side do not join to."""
    one, r = align.Aligner(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")), random.Random(4)
    letters = ["a", "b", " ", "the", "é", "\n", "漢", "tion", ".", "Über", "▁", "ing", "\U0001f600", "1234", None]
    for _ in range(40):
        texts = [r.choice([None, "", *ODD]) if r.random() < 0.2 else "".join(r.choice(letters) or "▁" for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 12))]
        counts, groups, pairs, links = one.align(texts)
        for k, t in enumerate(texts):
            ids_a, ids_b, expected = brute_groups(t)
            own = Counter(x * one.size_b + y for a, b in expected for x in a for y in b)
            assert counts[k].tolist() == [len(ids_a), len(ids_b), len(expected), sum(own.values())]
            assert groups[k] == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in expected)
            assert dict(zip(pairs[k].tolist(), links[k].tolist())) == own and sorted(own) == pairs[k].tolist()


@pytest.mark.parametrize("frequent", [align.FREQUENT, 40, 0])
def test_operator_by_brute_force(spark, docs, frequent):
    """All, some or none of the pairs sent to every task; nulls, empty and odd texts, repeated rows, clashing columns."""
    odd = spark.createDataFrame([(100 + k // 2, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    rows = docs.unionByName(odd, allowMissingColumns=True).withColumn("row_key", F.lit("x")).withColumn("pairs", F.lit(1))
    texts = [r["text"] for r in rows.collect()]
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = align.align_tokenizers(rows, frequent=frequent).collect()
    assert Counter(tuple(r[c] for c in columns) for r in found) == Counter(brute(texts))
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in rows.collect())
    zero = [r for r in found if r["doc_id"] in (1, 2)]
    assert len(zero) == 2 and all(tuple(r[c] for c in columns) == (0, 0, 0, 0, 0, 0, "") for r in zero)


def test_small_tables_and_full_memory(spark, none, monkeypatch):
    assert align.align_tokenizers(none).count() == 0
    blank = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert align.align_tokenizers(blank).where("n_a = 0 AND groups_sha256 = ''").count() == 2
    kept = align.align_tokenizers(spark.createDataFrame([(1, "the cat")], "doc_id long, text string"), keep=True).first()
    assert kept["groups_sha256"] == hashlib.sha256(kept["groups"].encode()).hexdigest()
    monkeypatch.setattr(align, "ENTRIES", 3)  # tables that start anew after every block
    one = align.Aligner(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    texts = [t for _, t in TEXTS]
    again = [one.align(texts) for _ in range(2)]
    assert again[0][1] == again[1][1] and not one.entries
