from pyspark.sql import functions as F

from lingloom.functions import text as T
from lingloom.operators import quality, segments
from lingloom.operators.markup import mask, parse, unmask
from lingloom.profile import CJK


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_variants_and_primary_forms(spark):
    variants = {"裏": "裡", "纔": "才", "麪": "麵", "着": "著"}
    assert one(spark, "裏纔麪着好", lambda c: T.normalize_variants(c, variants)) == "裡才麵著好"
    char_map = spark.createDataFrame([("发", ["發", "髮"], 0), ("发", ["髮"], 5), ("后", ["後"], 1)], "simp string, trads array<string>, line_no int")
    assert T.primary_forms(char_map) == {"发": "髮", "后": "後"}


def test_ellipsis(spark):
    for t in ("…", "……", "………"):
        assert one(spark, f"好{t}吧", T.normalize_ellipsis) == "好……吧"


def test_brackets(spark):
    assert one(spark, "「甲」與『乙』", lambda c: T.restore_brackets(T.protect_brackets(c))) == "「甲」與『乙』"
    assert one(spark, "甲 好。 是", T.restore_brackets) == "「甲」好。是"


def test_tags_stem_and_key(spark):
    assert one(spark, "a<b>c</b><>d", T.strip_tags) == "acd"
    assert one(spark, "a<b>c</b><>d", lambda c: T.strip_tags(c, False)) == "ac<>d"
    assert one(spark, "/x/y/发 明_zhTW.epub", lambda c: T.output_stem(c, {"发": "發"})) == "發 明"
    import hashlib

    assert one(spark, "字", lambda c: T.cache_key("a", "b", "text", c)) == hashlib.md5("a:b:text:字".encode()).hexdigest()


def test_occurrences(spark):
    assert one(spark, "aaaa", lambda c: T.occurrences(c, F.lit("aa"))) == [1, 2, 3]
    assert one(spark, "aaaa.", lambda c: T.occurrences(c, F.lit("aa"), overlapping=False)) == [1, 3]
    assert one(spark, "b", lambda c: T.occurrences(c, F.lit("aa"))) == []


def test_fallback(spark):
    cases = [
        ("", "", None), (" ", "", None), ("好。", " ", "blank"), ("一" * 20, "一" * 15, None), ("一" * 20, "一" * 14, "length"),
        ("一" * 100, "一" * 85, None), ("一" * 100, "一" * 84, "length"), ("他說「好」", "他說「好", "quote"), ("走了。", "走了", "ender"), ("走了。", "走了」", None),
    ]
    rows = spark.createDataFrame([(s, t, k) for k, (s, t, _) in enumerate(cases)], "s string, t string, k int").withColumn("r", quality.fallback_reason(F.col("s"), F.col("t"))).orderBy("k").collect()
    assert [r["r"] for r in rows] == [r for _, _, r in cases]
    html = spark.createDataFrame([("<b>好</b>。", "<i></i>好。")], "s string, t string").select(quality.needs_fallback(F.col("s"), F.col("t"), True)).first()[0]
    assert html is False


def test_passthrough(spark):
    rows = spark.createDataFrame([("国学书马车好", "国学書馬好好"), ("国学书马车好", "国学书馬好好"), ("国学书", "国学书")], "s string, t string")
    got = [r[0] for r in rows.select(quality.is_silent_passthrough(F.col("s"), F.col("t"), "国学书马", CJK)).collect()]
    assert got == [False, True, False]


def test_chunks_and_fragments():
    assert segments.fragments("甲。乙，丙、.丁！？") == ["甲。", "乙", "，", "丙", "、.", "丁！？"]
    text = ("字" * 120 + "。") * 40
    got = segments.chunks(text)
    assert "".join(got) == text and max(map(len, got)) <= 1800 and len(got) == 3
    assert segments.chunks("短") == ["短"] and segments.chunks("長" * 2000) == ["長" * 2000]
    for t in ("", "。。", "a.b", " 。x，，\n"):
        assert "".join(segments.fragments(t)) == t


def test_batches():
    assert segments.batch_numbers([900, 897, 1], 1800, 3, False) == [0, 0, 1]
    assert segments.batch_numbers([900, 898], 1800, 3, False) == [0, 1]
    assert segments.batch_numbers([9000, 1], 8000, 5, True) == [0, 1]
    assert segments.batch_numbers([3995, 3995, 1], 8000, 5, True) == [0, 0, 1]


def test_pack_batches(spark):
    df = spark.createDataFrame([("b", k, "x" * n) for k, n in enumerate([900, 897, 1])] + [("c", 0, None)], "book_id string, seg_pos int, text string")
    got = {(r["book_id"], r["seg_pos"]): r["batch_no"] for r in segments.pack_batches(df).collect()}
    assert got == {("b", 0): 0, ("b", 1): 0, ("b", 2): 1, ("c", 0): 0}


def test_masking():
    for html in ("<a>カタカナ</a>", "<span>Иван</span>", "<i>ひと</i>", "<ruby>字<rt>じ</rt></ruby>", '<b class="Char-Name">名</b>', "<a><img src='x'/></a>"):
        root = parse(f"前{html}後")
        saved = mask(root)
        assert len(saved) == 1 and root.inner() == "前0後"
        assert unmask(root.inner(), saved) == "前" + saved[0] + "後"
    root = parse("前<b>重要</b>後")
    assert mask(root) == [] and unmask("9", []) == "9"


def test_segments(spark):
    html = "<title> 書 </title><blockquote><p>一<b>二</b></p></blockquote><p>三<p>四</p><script>var s='</p>';</script><pre><p>五</p></pre><td> </td>"
    rows = segments.extract_segments(spark.createDataFrame([("b", "d", html), ("b", "e", None)], "book_id string, doc_id string, content string")).orderBy("seg_pos").collect()
    assert [(r["tag"], r["kind"], r["text"]) for r in rows] == [
        ("blockquote", "html", "<p>一<b>二</b></p>"), ("p", "html", "一<b>二</b>"), ("p", "plain", "三"), ("p", "plain", "四"), ("title", "title", "書"),
    ]


def test_guards_and_phrases(spark):
    segs = spark.createDataFrame([("b", "春日部春日"), ("c", "春日")], "book_id string, text string")
    names = spark.createDataFrame([("b", "春日"), ("b", "春日部")], "book_id string, ngram string")
    for largest in (1000, 0):
        got = {r["book_id"]: [(p["part"], p["protected"]) for p in r["parts"]] for r in segments.guard_entities(segs, names, largest=largest).collect()}
        assert got == {"b": [("春日部", True), ("春日", True)], "c": [("春日", False)]}
    phrases = spark.createDataFrame([("中央", "甲"), ("中央盘子", "乙…"), ("甲", "x")], "simp string, trad string")
    for largest in (1000, 0):
        done = segments.convert_phrases(spark.createDataFrame([("正中央盘子里…中央",)], "text string"), phrases, largest=largest).first()
        assert done["converted"] == "正乙…里…甲"


def test_pack_batches_over_many_chunks(spark):
    """Books cut into chunks of a few rows, many of which no batch or several begin in: the greedy batches of whole books."""
    import random

    from lingloom.operators.batches import batch_numbers, pack_batches

    r = random.Random(4)
    for rows, limit, sep, first, longest in ((3, 40, 3, False, 12), (5, 30, 0, False, 50), (4, 25, 5, True, 9), (7, 60, 0, True, 4)):
        books = {b: [r.choice([0, 0, r.randint(0, longest), None]) for _ in range(r.randint(1, 60))] for b in ("x", "y", None, "z")}
        table = [(b, k, None if n is None else "a" * n) for b, own in books.items() for k, n in enumerate(own)]
        df = spark.createDataFrame(r.sample(table, len(table)), "book_id string, seg_pos long, text string").repartition(3)
        got = {(x["book_id"], x["seg_pos"]): x["batch_no"] for x in pack_batches(df, limit, sep, first, rows=rows).collect()}
        assert got == {(b, k): n for b, own in books.items() for k, n in enumerate(batch_numbers([x or 0 for x in own], limit, sep, first))}
    assert pack_batches(df.limit(0)).count() == 0


def test_guards_and_phrases_hold_little_at_once(spark, monkeypatch):
    """Cut and converted some texts at a time, as columns and without hits: the parts of the alternation, longest first."""
    import random
    import re

    from lingloom.operators import apply_rules

    monkeypatch.setattr(segments, "SLICE", 100)
    monkeypatch.setattr(apply_rules, "SLICE", 100)
    monkeypatch.setattr(apply_rules, "apply_to_text", None)  # would make a row of fields for every hit
    r = random.Random(3)
    texts = [None, "", "……a…"] + ["".join(r.choices("abc…", k=r.randint(1, 90))) for _ in range(300)]
    names = sorted({"".join(r.choices("abc", k=r.randint(1, 4))) for _ in range(25)} - {"a", "b", "c"})
    table = spark.createDataFrame([(r.choice("xy"), k, t) for k, t in enumerate(texts)], "book_id string, k int, text string").repartition(2)
    pattern = re.compile("(" + "|".join(sorted(names, key=lambda w: (-len(w), w))) + ")")
    for largest in (10_000, 0):
        got = segments.guard_entities(table, spark.createDataFrame([("x", n) for n in names], "book_id string, ngram string"), largest=largest).collect()
        assert len(got) == len(texts)
        for row in got:
            t = texts[row["k"]]
            cut = (pattern.split(t) if row["book_id"] == "x" else [t]) if t is not None else None
            expected = None if t is None else [(p, bool(k % 2)) for k, p in enumerate(cut) if p]
            assert (row["parts"] if t is None else [(p["part"], p["protected"]) for p in row["parts"]]) == expected
        done = segments.convert_phrases(table, spark.createDataFrame([(n, n.upper()) for n in names], "simp string, trad string"), largest=largest).collect()
        assert {x["k"]: x["converted"] for x in done} == {k: t and pattern.sub(lambda m: m[0].upper(), t) for k, t in enumerate(texts)}


def test_words_by_pattern_are_those_of_their_starts(spark):
    """Rules with word boundaries: a pattern asked in place gives what a list of starts gives, and hits may be counted alone."""
    import random
    import re

    from lingloom.operators.apply_rules import apply_rules

    r = random.Random(5)
    texts = [None, ""] + ["".join(r.choices("abcd ,", (4, 4, 4, 4, 3, 1), k=r.randint(1, 60))) for _ in range(200)]
    rows = [(k, t, None if t is None else sorted({0, *(e for m in re.finditer("[a-d]+", t) for e in m.span())})) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, text string, starts array<int>")
    forms = sorted({"".join(r.choices("abcd ", k=r.randint(1, 3))) for _ in range(30)})
    rules = spark.createDataFrame([(w, w.upper() + "x", r.random() < 0.1) for w in forms], "wrong string, right string, manual boolean")
    bigrams = spark.createDataFrame([("ab",), ("cd",), (" a",)], "bg string")
    for strict in (True, False):
        for largest in (10_000, 0):
            want = {x["k"]: (x["applied"]["text"], len(x["applied"]["hits"])) for x in apply_rules(df, rules, bigrams, boundaries="starts", strict=strict, largest=largest).collect()}
            got = {x["k"]: tuple(x["applied"]) for x in apply_rules(df, rules, bigrams, strict=strict, largest=largest, hits=False, words="[a-d]").collect()}
            assert got == want and any(n for _, n in got.values())
