import json
import lzma
import os
import zipfile

from lingloom.operators.segments import extract_metadata, extract_navigation
from lingloom.plans.workloads import analyse_logs, localise, mine_rules
from lingloom.sources import books, dictionaries, logs, tables

OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>书名</dc:title><dc:creator>谁</dc:creator>
<meta property="belongs-to-collection">系列</meta><meta property="other">x</meta></metadata><manifest>
<item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/>
<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="t" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest>
<spine><itemref idref="a"/><itemref idref="b"/></spine></package>"""
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>一</text></navLabel><navPoint><navLabel><text>二</text></navLabel></navPoint></navPoint>
<navPoint><navLabel><text>三</text></navLabel></navPoint></navMap></ncx>"""


def book(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("o/content.opf", OPF)
        z.writestr("o/toc.ncx", NCX)
        z.writestr("o/nav.xhtml", "<p>nav</p>")
        z.writestr("o/a.xhtml", "<html><body><p>他的头发很长。</p></body></html>")
        z.writestr("o/b.xhtml", b"<p>\xff</p>")


def test_books(spark, tmp_path):
    os.makedirs(tmp_path / "in/sub")
    os.makedirs(tmp_path / "in/out")
    book(tmp_path / "in/发_zhTW.epub")
    book(tmp_path / "in/sub/y.epub")
    book(tmp_path / "in/out/z.epub")
    (tmp_path / "in/broken.epub").write_bytes(b"no")
    files = books.list_books(spark, [f"{tmp_path}/in", f"{tmp_path}/in/sub"], f"{tmp_path}/in/out")
    assert files.count() == 3
    left = books.skip_existing(files, spark.createDataFrame([("發",)], "stem string"), {"发": "發"})
    assert sorted(r["stem"] for r in left.collect()) == ["broken", "y"]
    docs = books.unpack_books(left)
    rows = docs.where("kind <> 'error'").orderBy("doc_pos").collect()
    assert [(r["doc_id"], r["kind"]) for r in rows] == [("o/content.opf", "opf"), ("o/a.xhtml", "doc"), ("o/b.xhtml", "doc"), ("o/toc.ncx", "ncx")]
    assert "�" in rows[2]["content"]
    nav = extract_navigation(docs.where("kind = 'ncx'")).collect()
    assert [(r["path"], r["title"]) for r in nav] == [([0], "一"), ([0, 0], "二"), ([1], "三")]
    meta = extract_metadata(docs.where("kind = 'opf'")).collect()
    assert sorted((r["field"], r["value"]) for r in meta) == [("belongs-to-collection", "系列"), ("title", "书名")]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# x\n发\t發 髮\nno tab\n后\t 後\n空\t\n", encoding="utf-8")
    assert [(r["simp"], r["trads"], r["line_no"]) for r in dictionaries.read_char_map(spark, f"{tmp_path}/c.txt").orderBy("line_no").collect()] == [("发", ["發", "髮"], 1), ("后", ["後"], 3)]
    (tmp_path / "v.txt").write_text("#a\tb\n裏\t裡 x\n同\t同\n裏\t里\n", encoding="utf-8")
    assert [tuple(r) for r in dictionaries.read_variants(spark, f"{tmp_path}/v.txt").collect()] == [("裏", "里")]
    assert [tuple(r) for r in dictionaries.read_phrases(spark, f"{tmp_path}/v.txt").where("simp = '裏'").collect()] == [("裏", "里")]
    (tmp_path / "k.json").write_text(json.dumps({"corrections": {"餵，": "喂，", "一": "二"}, "layer2_blocklist": ["天後"], "layer2_seam_threshold": 7}, ensure_ascii=False), encoding="utf-8")
    found, blocked, threshold = dictionaries.read_corrections(spark, f"{tmp_path}/k.json")
    assert [tuple(r) for r in found.collect()] == [("餵，", "喂，")] and [r[0] for r in blocked.collect()] == ["天後"] and threshold == 7
    (tmp_path / "b.json").write_text(json.dumps({"甲乙": "丙"}, ensure_ascii=False), encoding="utf-8")
    assert [tuple(r) for r in dictionaries.read_corrections(spark, f"{tmp_path}/b.json")[0].collect()] == [("甲乙", "丙")]
    heads = json.dumps([{"title": "一二"}, {"title": "一二"}, {"x": 1}], ensure_ascii=False)
    (tmp_path / "h.json").write_text(heads, encoding="utf-8")
    (tmp_path / "h.json.xz").write_bytes(lzma.compress(heads.encode()))
    for name in ("h.json", "h.json.xz"):
        assert [r[0] for r in dictionaries.read_headwords(spark, f"{tmp_path}/{name}").collect()] == ["一二"]
    assert dictionaries.read_headwords(spark, f"{tmp_path}/none.json").count() == 0


def test_workloads(spark, tmp_path):
    char_map = spark.createDataFrame([("发", ["發", "髮"], 0), ("长", ["長"], 1), ("头", ["頭"], 2)], "simp string, trads array<string>, line_no int")
    heads = spark.createDataFrame([("頭髮",), ("長大",)], "word string")
    nothing = spark.createDataFrame([], "wrong string, right string")
    mined = mine_rules(heads, char_map, nothing, spark.createDataFrame([("纔", "才")], "wrong string, right string"))
    assert {(r["wrong"], r["right"]) for r in mined["rules"].collect()} == {("頭發", "頭髮"), ("纔", "才")}
    docs = spark.createDataFrame([("b", "d", 0, "doc", "<p>他的头发很长。</p><p>纔<b>好</b></p>"), ("b", "t", 1, "ncx", NCX.replace("三", "头发")), ("b", "o", 2, "opf", OPF)], "book_id string, doc_id string, doc_pos int, kind string, content string")
    out = localise(docs, char_map, heads, mined["rules"], mined["bigrams"], spark.createDataFrame([], "key string, value string"))
    assert [r["text"] for r in out["segments"].orderBy("seg_pos").collect()] == ["他的頭髮很長。", "才<b>好</b>"]
    assert [r["text"] for r in out["navigation"].orderBy("path").collect()] == ["一", "二", "頭髮"]
    assert sorted(r["text"] for r in out["metadata"].collect()) == ["书名", "系列"]
    assert out["hits"].where("status = 'applied'").count() == 2 and out["cache"].count() == 2
    tables.write_tables({"segments": out["segments"], "cache": out["cache"]}, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/segments").count() == 2
    os.makedirs(tmp_path / "logs")
    (tmp_path / "logs/x_consistency.txt").write_text("=== 後處理修正紀錄 (1)\n[001] 天後 → 天后  (1+ 次)\n  …今天後來…\n", encoding="utf-8")
    report = analyse_logs(logs.read_rule_logs(spark, f"{tmp_path}/logs"), heads)
    assert report["ranking"].first()["wrong"] == "天後"


def test_broken_and_large_containers(spark, monkeypatch):
    """What is no container, a cut one, a broken package document and a broken entry are rows that say so; other entries of the
    same container are read; a container of many megabytes comes entry by entry."""
    import io
    import zipfile

    def packed(entries, kind=zipfile.ZIP_STORED):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", kind) as z:
            for name, text in entries:
                z.writestr(name, text)
        return raw.getvalue()

    opf = "<package><manifest>%s</manifest><spine/></package>"
    item = "<item id='i{0}' href='{0}.xhtml' media-type='application/xhtml+xml'/>"
    whole = packed([("c.opf", opf % (item.format("a") + item.format("b"))), ("a.xhtml", "<p>first text</p>"), ("b.xhtml", "<p>second</p>")])
    large = packed([("c.opf", opf % "".join(item.format(k) for k in range(40)))] + [(f"{k}.xhtml", chr(97 + k % 26) * 500_000) for k in range(40)], zipfile.ZIP_DEFLATED)
    files = {
        "none": b"no container", "null": None, "cut": whole[:-30], "opf": packed([("c.opf", "<package><manifest>"), ("a.xhtml", "x")]),
        "entry": whole.replace(b"first text", b"other text"), "large": large, "fine": whole,
    }
    rows = books.unpack_books(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()
    by = {n: sorted((r["doc_pos"], r["doc_id"], r["kind"]) for r in rows if r["book_id"] == n) for n in files}
    assert by["none"] == by["null"] == by["cut"] == [(0, None, "error")]
    assert [x[2] for x in by["opf"]] == ["opf", "error"]
    assert by["entry"] == [(0, "c.opf", "opf"), (1, "a.xhtml", "error"), (2, "b.xhtml", "doc")]
    assert [x[2] for x in by["fine"]] == ["opf", "doc", "doc"]
    assert len(by["large"]) == 41 and sum(len(r["content"]) for r in rows if r["book_id"] == "large" and r["kind"] == "doc") == 20_000_000
    assert all((r["error"] is not None) == (r["kind"] == "error") == (r["content"] is None) for r in rows)


def test_localise_guards_entities_and_retries(spark):
    """Names that are frequent do not reach the engine; what the engine cuts short is converted in fragments."""
    from pyspark.sql import functions as F

    name = "春日见"
    html = "".join(f"<p>{name}来了。</p>" for _ in range(12)) + "<p>一二三四五六七八九十。甲乙丙丁，戊己庚。</p>"
    docs = spark.createDataFrame([("b", "d", 0, "doc", html)], "book_id string, doc_id string, doc_pos int, kind string, content string")
    char_map = spark.createDataFrame([("发", ["發"], 0), ("见", ["見"], 1)], "simp string, trads array<string>, line_no int")
    one = spark.createDataFrame([("好",)], "word string")
    rules = spark.createDataFrame([], "wrong string, right string, manual boolean")
    engine = lambda c: F.when(F.length(c) > 12, F.left(c, F.lit(2))).otherwise(F.upper(F.translate(c, "来春", "來X")))
    char_map = char_map.where("simp = '发'")
    out = localise(docs, char_map, one, rules, spark.createDataFrame([], "bg string"), spark.createDataFrame([], "key string, value string"), engine=engine, repair=False)
    texts = [r["text"] for r in out["segments"].orderBy("seg_pos").collect()]
    assert [r["ngram"] for r in out["entities"].collect()][:1] != [] and all("X" not in t for t in texts)
    assert texts[-1] == "一二三四五六七八九十。甲乙丙丁，戊己庚。"
    assert texts[0].startswith(name)
