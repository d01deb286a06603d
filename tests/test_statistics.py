import random

import pytest
from pyspark.sql import functions as F

from lingloom.operators import analysis, cache, consistency, entities, repairs, rules
from lingloom.operators.apply_rules import RuleIndex, apply_rules, apply_to_text, rule_hit_log, rule_hits
from lingloom.operators.replace import replace_in_order
from lingloom.profile import CJK
from lingloom.sources.logs import parse_rule_logs

FORMS = consistency.Forms({"丽": ["麗"], "发": ["發", "髮"], "莎": ["莎"]})


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_cliff(spark):
    counts = table(spark, [("a", 600, 8), ("a", 175, 8), ("a", 70, 8), ("b", 100, 8), ("b", 90, 8), ("b", 80, 8), ("c", 9, 8), ("d", 600, 8), ("d", 600, 8), ("e", 10, 8), ("e", 9, 8)], "book_id string, n long, floor long")
    got = {r["book_id"]: r["threshold"] for r in entities.cliff_threshold(counts).collect()}
    assert got == {"a": 175, "b": 15, "c": 8, "d": 90, "e": 8}


def test_entities_and_left_context(spark):
    segs = [("b", "d1", "后藤小姐来。")] * 10 + [("b", "d1", "春日见")] * 12 + [("b", "d1", "哈哈哈哈")] * 8
    docs = table(spark, segs, "book_id string, doc_id string, text string")
    got = [(r["rank"], r["ngram"], r["n"]) for r in entities.protected_entities(docs, docs, CJK, "后", None).orderBy("rank").collect()]
    names = [g for _, g, _ in got]
    assert "春日见" in names and "藤小姐" not in names and "小姐来" not in names or "藤小姐" not in names
    assert all("后" not in g for g in names) and got[0][2] == max(n for _, _, n in got)
    counts = {r["ngram"]: r["n"] for r in entities.count_ngrams(docs, CJK, "后", table(spark, [("春日",)], "word string")).collect()}
    assert "春日" not in counts and counts["哈哈"] == 24 and counts["春日见"] == 12


def char_map(spark):
    return table(spark, [("发", ["發", "髮"], 0), ("只", ["只", "祇"], 1)], "simp string, trads array<string>, line_no int")


def test_rules(spark):
    heads = table(spark, [("長發",), ("頭髮",), ("地祇",), ("往後",)], "word string")
    got = {(r["wrong"], r["right"]) for r in rules.generate_rules(heads, char_map(spark)).collect()}
    assert got == {("頭發", "頭髮"), ("地只", "地祇")}
    scored = rules.seam_scores(table(spark, [("頭發", "頭髮"), ("一二三四", "x")], "wrong string, right string"), rules.affix_frequencies(table(spark, [("x頭",), ("y頭",), ("發z",)], "word string")))
    assert {r["wrong"]: r["seam"] for r in scored.collect()} == {"頭發": 2, "一二三四": 0}
    kept, dropped = rules.filter_rules(scored, table(spark, [("一二三四",)], "wrong string"), 2)
    assert kept.count() == 0 and [r["wrong"] for r in dropped.collect()] == ["頭發"]
    merged = rules.merge_rule_layers(table(spark, [("甲", "纔")], "wrong string, right string"), table(spark, [("餵，", "喂，"), ("一", "二")], "wrong string, right string"), table(spark, [("纔", "才"), ("餵，", "呢")], "wrong string, right string"), {"纔": "才"})
    assert {(r["wrong"], r["right"], r["manual"]) for r in merged.collect()} == {("甲", "才", False), ("餵，", "呢", True), ("纔", "才", False)}
    assert {r["bg"] for r in rules.build_bigrams(table(spark, [("一二，三",)], "word string")).collect()} == {"一二"}


def test_rule_application(spark):
    assert apply_to_text("頭髮往後", RuleIndex([("髮往", "發往", False)], {"頭髮"}))[0] == "頭髮往後"
    assert apply_to_text("髮往後", RuleIndex([("髮往", "發往", False)], {"頭髮"}))[0] == "發往後"
    both = RuleIndex([("甲乙丙", "X", False), ("甲乙", "Y", True), ("丙", "Z", False)], set())
    assert apply_to_text("甲乙丙", both)[0] == "YZ"
    shorter = RuleIndex([("甲乙丙", "X", False), ("甲乙", "Y", False)], {"丙丁"})
    out, hits = apply_to_text("甲乙丙丁…", shorter)
    assert out == "Y丙丁……" and [h["status"] for h in hits] == ["blocked", "applied"]
    guarded = RuleIndex([("被發", "被髮", False)], {"發現"})
    assert apply_to_text("被發現", guarded, [0, 1])[0] == "被發現"
    assert apply_to_text("被發現", guarded, [0, 2])[0] == "被髮現"
    free = RuleIndex([("乙丙", "X", False)], set())
    assert apply_to_text("甲乙丙", free, [0, 2], strict=True)[0] == "甲乙丙" and apply_to_text("甲乙丙", free, [0, 1], strict=True)[0] == "甲X"
    df = table(spark, [("b", k, "乙丙…" * 5) for k in range(2)] + [("b", 9, None)], "book_id string, pair_pos long, text string")
    table_ = table(spark, [("乙丙", "X", False)], "wrong string, right string, manual boolean")
    for largest in (1000, 0):
        applied = apply_rules(df, table_, table(spark, [("丙x",)], "bg string"), largest=largest)
        assert {r["pair_pos"]: r["applied"]["text"] for r in applied.collect()} == {0: "X……" * 5, 1: "X……" * 5, 9: None}
    log = rule_hit_log(rule_hits(applied)).collect()
    assert [(r["n"], len(r["snippets"]), r["rank"]) for r in log] == [(10, 3, 1)]


def voted(spark, rows):
    pairs = table(spark, [("b", k, s, t) for k, (s, t) in enumerate(rows)], "book_id string, pair_pos long, src string, tgt string")
    return {(r["wrong"], r["right"]) for r in consistency.consistency_rules(pairs, FORMS, CJK).collect()}


def test_truth_beats_majority(spark):
    rows = [("他是政近一行。", "他是政近一步。")] * 15 + [("他是政近一行。", "他是政近一行。")] * 5
    assert voted(spark, rows) == {("近一步", "近一行")}  # which covers the longer form


def test_tie_between_names_abstains(spark):
    rows = [("和艾莉娅艾莉莎说", "和艾莉婭艾莉莎說")] * 10
    assert not any("艾莉" in w for w, _ in voted(spark, rows))


def test_sentences(spark):
    pairs = table(spark, [("b", 0, "一。 二……三", "甲。乙…… 丙"), ("b", 1, "一。二", "甲")], "book_id string, pair_pos long, src string, tgt string")
    got = sorted((r["pair_pos"], r["sent_pos"], r["src"], r["tgt"]) for r in consistency.sentence_pairs(pairs, CJK).collect())
    assert got == [(0, 0, "一。", "甲。"), (0, 1, "二…", "乙…"), (0, 2, "…", "…"), (0, 3, "三", "丙"), (1, 0, "一。二", "甲")]


def test_conflicts_and_shrinking(spark):
    assert sweep_conflicts([("雪底下", "雪之下"), ("雪之下的", "雪底下的")]) == {"雪之下的"}
    assert sweep_conflicts([("甲乙", "甲丙"), ("X甲乙", "X甲丙")]) == {"X甲乙"}
    rows = table(spark, [("b", "雪底下不", "雪之下不", "雪之下不"), ("b", "麗子我", "莉子我", "丽子我"), ("b", "麗子他", "莉子他", "丽子他")], "book_id string, wrong string, right string, s_ng string")
    got = {(r["wrong"], r["right"]) for r in consistency.shrink_rules(rows, FORMS).collect()}
    assert got == {("雪底下不", "雪之下不"), ("麗", "莉")}


def test_replacements_and_report(spark):
    segs = table(spark, [("b", 0, "<b>雪底下</b>和雪底下"), ("c", 0, "雪底下")], "book_id string, seg_pos int, text string")
    found = table(spark, [("b", "雪底下", "雪之下", "s"), ("b", "雪底", "X", "s")], "book_id string, wrong string, right string, s_ng string")
    assert {r["book_id"]: r["text"] for r in consistency.apply_replacements(segs, found).collect()} == {"b": "<b>雪之下</b>和雪之下", "c": "雪底下"}
    rows = consistency.consistency_report(segs, found.where("wrong = '雪底下'"), keep=1).collect()
    assert [(r["k"], r["before"], r["after"]) for r in rows] == [(1, "雪底下和雪底下", "雪之下和雪底下")]


def pairs_of(spark, rows):
    return table(spark, [("b", k, s, t) for k, (s, t) in enumerate(rows)], "book_id string, pair_pos long, src string, tgt string")


def test_diff_repairs(spark):
    own = pairs_of(spark, [("老神在在地坐著", "老神在地坐著"), ("白发很长", "白髮長")])
    bigrams = table(spark, [("在在",), ("很長",)], "bg string")
    found = repairs.diff_repairs(own, {"发": "發", "长": "長"}, {"发": ["發", "髮"], "长": ["長"]}, bigrams)
    got = {(r["wrong"], r["right"]) for r in found.collect()}
    assert any(w in "老神在地坐著" and r in "老神在在地坐著" for w, r in got)
    safe = repairs.safe_repairs(found, pairs_of(spark, [(w, w) for w, _ in got][:1]), {})
    assert safe.count() == len(got) - 1
    done = repairs.apply_repairs(own.withColumnRenamed("tgt", "text"), found).orderBy("pair_pos").first()
    assert done["text"] == "老神在在地坐著"


def test_fixed_words(spark):
    heads = table(spark, [("笑容可掬",), ("老神在在",), ("笑容可親",)], "word string")
    own = pairs_of(spark, [("笑容可掬地回答", "笑容可搬地回答"), ("老神在在地坐著", "老神在地坐著"), ("他笑容可掬", "他笑容可親")])
    found = repairs.fixed_word_candidates(heads, FORMS, own)
    assert {r["word"] for r in found.collect()} == {"笑容可掬", "老神在在"}
    contexts = repairs.fixed_word_contexts(found, own)
    assert {r["word"]: (r["extensions"], r["followers"]) for r in contexts.collect()} == {"笑容可掬": ([], ["地"]), "老神在在": ([], ["地"])}
    tallies = repairs.fixed_word_tallies(contexts, own, heads)
    assert {r["word"]: (r["n_subst"], r["n_trunc"], r["n_false"]) for r in tallies.collect()} == {"笑容可掬": (1, 0, 1), "老神在在": (0, 1, 0)}
    fixes = repairs.fixed_word_repairs(tallies)
    done = repairs.apply_fixed_word_repairs(own.withColumnRenamed("tgt", "text"), fixes, contexts, heads).orderBy("pair_pos").collect()
    assert [r["text"] for r in done] == ["笑容可掬地回答", "老神在在地坐著", "他笑容可親"]


def test_cache(spark):
    segs = table(spark, [("a", 0, "x"), ("a", 1, " "), ("b", 0, "x"), ("b", 1, "y"), ("b", 2, None)], "book_id string, pos int, text string")
    keyed = cache.with_key(segs, "s", "t")
    known = keyed.where("text = 'y'").selectExpr("key", "'Y' AS value")
    assert sorted(r["status"] for r in cache.cache_lookup(keyed, known).collect()) == ["blank", "blank", "hit", "miss", "miss"]
    done, new = cache.convert_segments(keyed, known, F.upper)
    assert sorted((r["book_id"], r["pos"], r["value"]) for r in done.collect()) == [("a", 0, "X"), ("a", 1, " "), ("b", 0, "X"), ("b", 1, "Y"), ("b", 2, None)]
    assert new.count() == 1
    merged = cache.merge_cache(known, known.selectExpr("key", "'Z' AS value").unionByName(new))
    assert sorted(r["value"] for r in merged.collect()) == ["X", "Z"]


def test_rule_logs_and_analysis(spark):
    text = "=== 後處理修正紀錄 (1)\n[001] 天後 → 天后  (2+ 次)\n  …今天後來…\n  …三天後的事  [lookbehind:天後]…\n=== Bigram 攔截紀錄\n[001] 甲 → 乙  (1+ 次)\n  …甲…\n=== 後處理修正紀錄 x\n  …無…\n[002] 布帘 → 布簾  (1+ 次)\n  …布帘…"
    lines = table(spark, [("f", k, line) for k, line in enumerate(text.split("\n"))], "file string, pos int, line string")
    snips = parse_rule_logs(lines)
    assert sorted((r["wrong"], r["right"], r["snippet"]) for r in snips.collect()) == [("天後", "天后", "三天後的事"), ("天後", "天后", "今天後來"), ("布帘", "布簾", "布帘")]
    near = analysis.snippet_neighbours(snips)
    assert sorted((r["snippet"], r["left"], r["right_char"]) for r in near.collect()) == [("三天後的事", "三", "的"), ("今天後來", "今", "來"), ("布帘", None, None)]
    heads = table(spark, [("今天",), ("後來",), ("後面",), ("x今",)], "word string")
    metrics = analysis.rule_metrics(near, rules.affix_frequencies(heads))
    got = {r["wrong"]: r for r in metrics.collect()}
    assert (got["天後"]["n_files"], got["天後"]["n_snippets"], got["天後"]["seam"], got["天後"]["label"], got["天後"]["max_ctx"]) == (1, 2, 2, "FP", 1)
    assert got["布帘"]["label"] == "TP"
    assert tuple(analysis.calibrate_threshold(metrics).first()) == (2, 0, 1)
    assert [r["wrong"] for r in analysis.rank_rules(metrics, 1).collect()] == ["天後"]
    assert analysis.top_neighbours(near).count() == 6


def test_alignment_against_brute_force(spark):
    import random
    import re

    r = random.Random(4)
    listed = {"x": ["a", "b"], "y": ["c"]}
    forms, rows = consistency.Forms(listed), []
    profile = consistency.ScriptProfile(run="a-z", terminators=".")
    for k in range(40):
        src = ["".join(r.choice("abcxyd ") for _ in range(r.randint(3, 14))) for _ in range(r.randint(1, 3))]
        tgt = ["".join(r.choice(listed.get(c, [c])) if r.random() < 0.9 else r.choice("abcd") for c in s) for s in src]
        rows.append(("b", k, ".".join(src) + ".", ".".join(tgt) + "."))
    expected, votes = {}, {}
    for _, _, src, tgt in rows:
        cut = lambda t: [p.lstrip() if i else p for i, p in enumerate(re.findall(r"[^.]*\.", t)) if p.strip()]
        ss, ts = cut(src), cut(tgt)
        for s, t in zip(ss, ts) if len(ss) == len(ts) > 1 else [(src, tgt)]:
            grams = lambda x: {x[i : i + n] for n in (3, 4) for i in range(len(x) - n + 1) if re.fullmatch("[a-z]+", x[i : i + n])}
            for a in grams(s):
                for b in grams(t):
                    if len(a) != len(b):
                        continue
                    fixed = not set(a) & set(listed)
                    off = sum(p != q for p, q in zip(a, b))
                    if a[0] in listed and b[0] not in listed[a[0]] or a[0] not in listed and a[0] != b[0]:
                        continue
                    if fixed and off > 1 or not fixed and any(p != q and q not in listed.get(p, []) for p, q in zip(a, b)):
                        continue
                    windows = [s[i : i + len(a)] for i in range(len(s) - len(a) + 1)]
                    if fixed and a != b and any(w != a and sum(p != q for p, q in zip(w, b)) <= off for w in windows):
                        continue
                    expected[a, b] = expected.get((a, b), 0) + 1
    pairs = table(spark, rows, "book_id string, pair_pos long, src string, tgt string")
    sent = consistency.sentence_pairs(pairs, profile)
    counts = consistency.alignment_counts(consistency.competitive_abstain(consistency.align_ngrams(sent, forms, profile), sent))
    assert {(c["s_ng"], c["t_ng"]): c["n"] for c in counts.collect()} == expected
    for (a, b), n in expected.items():
        votes.setdefault(a, []).append((not (a == b and not set(a) & set(listed)), -n, b))
    wanted = {a: (min(v)[2], -sum(n for _, n, _ in v)) for a, v in votes.items() if -sum(n for _, n, _ in v) >= 4}
    got = {m["s_ng"]: (m["majority"], m["total"]) for m in consistency.majority_form(counts, consistency.pair_counts(pairs)).collect()}
    assert got == wanted


def test_diff_repairs_against_brute_force(spark):
    """Sentences of letters that differ, some of which lost one: every loss and nothing else is found, contexts that stand
    somewhere as they are stay, and the rest is put back."""
    import random

    r = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows, expected = [], {}
    for k in range(120):
        src = "".join(r.sample(letters, r.randint(4, 10)))
        i = r.randrange(len(src)) if r.random() < 0.6 else None
        tgt = src if i is None else src[:i] + src[i + 1 :]
        rows.append((src, tgt))
        if i is not None:
            head, tail = tgt[max(0, i - 2) : i], tgt[i : i + 2]
            expected.setdefault(head + tail, head + src[i] + tail)
    own = pairs_of(spark, rows)
    found = repairs.diff_repairs(own, {}, {}, table(spark, [("ab",)], "bg string"))
    assert {x["wrong"]: x["right"] for x in found.collect()} == expected
    standing = {t[p : p + n] for s, t in rows for n in range(1, 5) for p in range(len(t) - n + 1) if s[p : p + n] == t[p : p + n]}
    safe = repairs.safe_repairs(found, own, {})
    assert {x["wrong"] for x in safe.collect()} == set(expected) - standing
    order = sorted(((x["pair_pos"], x["k"], x["wrong"], x["right"]) for x in safe.collect()))
    done = {x["pair_pos"]: x["text"] for x in repairs.apply_repairs(own.withColumnRenamed("tgt", "text"), safe).collect()}
    for k, (_, text) in enumerate(rows):
        for _, _, wrong, right in order:
            text = text.replace(wrong, right)
        assert done[k] == text


def test_look_ups_in_tables_of_any_size(spark, monkeypatch):
    """Words that are too many for every task are met by their windows, with the same rows."""
    heads = table(spark, [("abcd",), ("bcde",), ("xyzw",), ("abcdefgh",)], "word string")
    own = pairs_of(spark, [("--abcde--abcd", "--abce--abcd"), ("abcdefgh", "abcdefg"), ("none", "none"), ("xyz", "xyz")])

    def rows():
        found = repairs.fixed_word_candidates(heads, FORMS, own)
        contexts = repairs.fixed_word_contexts(found, own)
        return [sorted(tuple(map(str, x)) for x in df.collect()) for df in (found, contexts, repairs.fixed_word_tallies(contexts, own, heads))]

    small = rows()
    assert [w for _, w in small[0]] == ["abcd", "abcdefgh", "bcde"]
    monkeypatch.setattr(repairs, "sized", lambda df: (df, False))
    assert rows() == small


def sweep_conflicts(rules: list[tuple[str, str]]) -> set[str]:
    """Wrong forms to drop, shorter rules having their way: rules that a shorter one covers, and then rules whose wrong
    form holds a shorter rule's right one or the other way round."""
    ordered = sorted(rules, key=lambda x: (len(x[0]), x[0]))
    gone = set()
    for k, (wide, result) in enumerate(ordered):
        for short, fixed in ordered[:k]:
            if len(short) < len(wide) and any(wide.startswith(short, p) and result[p : p + len(fixed)] == fixed for p in range(len(wide))):
                gone.add(wide)
                break
    for k, (short, fixed) in enumerate(ordered):
        if short not in gone:
            for wide, result in ordered[k + 1 :]:
                if wide not in gone and len(short) < len(wide) and (fixed in wide or short in result):
                    gone.add(wide)
    return gone


def random_rules(r, letters, n, sizes=(1, 2, 3, 4)):
    rules = {}
    for _ in range(n):
        k = r.choice(sizes)
        rules["".join(r.choices(letters, k=k))] = "".join(r.choices(letters, k=k if r.random() < 0.8 else r.randint(0, 4)))
    return [(w, x) for w, x in rules.items() if w != x]


def test_conflicts_against_a_sweep_through_the_list(spark):
    r = random.Random(8)
    books = {f"b{b}": random_rules(r, "abcdef", r.randint(0, 25)) for b in range(40)}
    rows = table(spark, [(b, w, x, "s") for b, own in books.items() for w, x in own], "book_id string, wrong string, right string, s_ng string")
    left = {(x["book_id"], x["wrong"]) for x in consistency.resolve_rule_conflicts(rows).collect()}
    gone = {b: sweep_conflicts(own) for b, own in books.items()}
    assert left == {(b, w) for b, own in books.items() for w, _ in own if w not in gone[b]}
    assert 0 < len(left) < sum(map(len, books.values()))


@pytest.mark.parametrize("largest", [1 << 20, 0])
def test_replacements_in_order_by_brute_force(spark, largest):
    """Rules whose results other rules replace again, before and after them in order; null and empty texts; books without rules;
    rules that go to every task, and rules that are looked up."""
    r = random.Random(12)
    books = {f"b{b}": [(w, x, r.randint(0, 5)) for w, x in random_rules(r, "abc", 9)] for b in range(8)} | {"none": []}
    texts = [(k, r.choice([*books]), r.choice([None, "", *["".join(r.choices("abc", k=r.randint(1, 30))) for _ in range(9)]])) for k in range(150)]
    rules = table(spark, [(b, w, x, p) for b, own in books.items() for w, x, p in own], "book_id string, wrong string, right string, p int")
    segments = table(spark, texts, "k long, book_id string, text string").repartition(3)
    found = {x["k"]: x["text"] for x in replace_in_order(segments, rules, [F.col("p"), F.col("wrong")], largest=largest).collect()}
    for k, b, t in texts:
        for w, x, _ in sorted(books[b], key=lambda y: (y[2], y[0])):
            t = t and t.replace(w, x)
        assert found[k] == t


def test_fixed_words_leave_their_row_as_counts(spark, monkeypatch):
    """Texts aren't copied for the words in them, and what tasks gather gives the rows of the joins."""
    r = random.Random(8)
    heads = table(spark, [("".join(r.choices("abc", k=r.randint(4, 6))),) for _ in range(80)], "word string").distinct()
    rows = [("".join(r.choices("abc\n ", (4, 4, 4, 1, 1), k=60)) + r.choice(("", "abca", "bcab")),) for _ in range(60)]
    rows = [("b" if k % 3 else None if k % 2 else "c", k, s, None if k == 7 else "".join(c for c in s if r.random() > 0.05)) for k, (s,) in enumerate(rows)] + [("b", 90, None, "abc")]
    own = table(spark, rows, "book_id string, pair_pos long, src string, tgt string")

    def found():
        contexts = repairs.fixed_word_contexts(words, own)
        return [sorted(tuple(map(str, x)) for x in df.collect()) for df in (contexts, repairs.fixed_word_tallies(contexts, own, heads))]

    words = repairs.fixed_word_candidates(heads, FORMS, own).localCheckpoint()
    with monkeypatch.context() as m:
        m.setattr(repairs, "sized", lambda df: (df, False))
        expected = found()
        m.setattr(repairs, "sized", lambda df: (df, True))
        m.setattr(repairs, "_pair_words", None)
        m.setattr(repairs, "MOST", 20)
        assert found() == expected and len(expected[1]) > 5
