import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingloom.llm import binary, gru, lm, mixing, packing, quality, secrets, tokens, topk

from .conftest import TEXTS

ROWS = [*TEXTS, TEXTS[5]]


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


def encoded(text):
    """The library's ids at its default settings."""
    return library().encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_coder_equals_the_library():
    coder, r = tokens.Coder(tokens.vocabulary()), random.Random(3)
    letters = "ab  \n\t'stre12é漢　\xa0\x85\x1c<|endoftext|>.,!#\U0001f600​ _²½"
    for _ in range(500):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert coder.encode([t])[0].tolist() == encoded(t)


def test_packing(docs, none):
    rows = packing.pack_documents(docs, tokens.vocabulary(), room=64).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == {i for i, _ in ROWS}
    for i, t in TEXTS:
        ids = [*encoded(t), 1]
        copies = 2 if i == 6 else 1
        assert Counter(p for r in pieces[i] for p in range(r["start"], r["start"] + r["length"])) == {p: copies for p in range(len(ids))}
        for r in pieces[i]:
            assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none, tokens.vocabulary()).count() == 0


def test_patterns_use_up_all_pieces():
    rng = np.random.default_rng(1)
    counts = Counter(int(x) for x in np.minimum(256, rng.exponential(60, 20000).astype(int) + 1))
    plan = packing.plan_patterns(dict(counts), 256)
    used = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 256
        for s in pattern:
            used[s] += n
    assert used == counts
    total = sum(s * n for s, n in counts.items())
    assert total / (256 * sum(n for _, n in plan)) > 0.99
    assert packing.non_negative_least_squares(np.array([[1.0, 0], [0, 2]]), np.array([3.0, -1])) == pytest.approx([3, 0], abs=1e-3)


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in TEXTS}
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in ROWS)
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] for r in rows)
    source = {i: None if i % 5 == 0 else f"s{i % 3}" for i, _ in TEXTS}
    totals = Counter()
    for i, _ in ROWS:
        totals[source[i]] += size[i]
    names = sorted(x for x in totals if x) + [None]
    weight = {n: k % 3 + 1 for k, n in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(totals.values()))
    while True:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = [n for n in open_ if share[n] > 3 * totals[n]]
        if not over:
            target |= share
            break
        for n in over:
            target[n] = 3.0 * totals[n]
            left -= target[n]
            open_.remove(n)
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and r["source_size"] == totals[source[r["doc_id"]]]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[n] - target[n]) <= 1 for n in names)
    assert mixing.mix_sources(none).count() == 0
    assert sorted(map(tuple, mixing.mix_sources(docs.repartition(3)).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(300)] + [(300 + k, [0.5] * 16) for k in range(40)]
    bad = [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf")]), (904, []), (None, [0.1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in data + bad], "vec_id long, embedding array<float>, score string")
    vectors = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("vec"), "score")
    got = sorted(tuple(r) for r in topk.exact_top_k(vectors, vectors.where("vec_id % 100 = 0"), base_block=64, query_block=2).collect())
    whole = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in data} | {904: []}
    expected = []
    for q in [i for i in whole if i % 100 == 0]:
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[v])), v) for v in whole if v != q)[:10]
        expected += [(q, k + 1, v, -s) for k, (s, v) in enumerate(best)]
    assert got == sorted(expected)
    assert topk.exact_top_k(vectors.limit(0), vectors).count() == 0


def test_quality(docs, none):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    for i, t in TEXTS:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {p for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_rules(none).count() == 0


def test_sketches_merge(spark, docs):
    features = quality.text_features(docs)
    fine = quality.quantile_sketches(features, ("lang", "source"))
    merged = {tuple(r) for r in quality.merge_sketches(fine, ("lang",)).collect()}
    assert merged == {tuple(r) for r in quality.quantile_sketches(features, ("lang",)).select("lang", "metric", "bin", "n").collect()}


def test_binary(spark, docs, none, tmp_path):
    for bits in (False, True):
        binary.write_tokens(docs, f"{tmp_path}/{bits}", tokens.vocabulary(), chunk=100, bits=bits, files=3)
        got = sorted(tuple(r) for r in binary.read_tokens(spark, f"{tmp_path}/{bits}").collect())
        at, expected = 0, []
        for i, t in sorted(ROWS):
            ids = [*encoded(t), 2]
            expected.append((i, at, len(ids), crc(ids)))
            at += len(ids)
        assert got == sorted(expected)
        picked = {r["doc_id"]: r["ids"] for r in binary.tokens_of(spark, f"{tmp_path}/{bits}", [2, 9, 13]).collect()}
        assert picked == {i: [*encoded(t), 2] for i, t in ROWS if i in (2, 9, 13)}
    binary.write_tokens(none, f"{tmp_path}/none", tokens.vocabulary())
    assert binary.read_tokens(spark, f"{tmp_path}/none").count() == 0


def slow_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_secret_scan(docs, none):
    got = {r["doc_id"]: r for r in secrets.scan_secrets(docs).collect()}
    for i, t in TEXTS:
        spans = slow_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(got[i]["spans"].split(","))
    assert (got[11]["n_assign"], got[11]["n_access"], got[11]["n_hex"]) == (1, 1, 1)
    assert secrets.scan_secrets(none).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_base_spans(seed):
    r = random.Random(seed)
    bits = ["token", "SECRET", "api_key", "apikey", "=", ": ", '"', "'", "AKIA", "ABCDEFGH12345", "0123456789abcdef", " ", "\n", "xyz.9+/", "ſecret", "é"]
    text = "".join(r.choice(bits) for _ in range(200))
    assert [f"{k}:{s}:{e}" for k, s, e in secrets.base_spans(text)] == slow_spans(text)


def test_lexer():
    text = 'k = "Zx81qPw0Lm55Tt"\ndb_pass = k\nname = "nothing here"\nclient_secret: changeme\nhello: world'
    found = [text[s:e] for s, e in secrets.named_spans(text)]
    assert found == ["Zx81qPw0Lm55Tt"]
    assert secrets.named_spans('authKey = "Zx81qPw0" + "Lm55Tt9R"') and not secrets.named_spans('color = "Zx81qPw0Lm55Tt"')


def test_redaction(docs):
    rows = {r["doc_id"]: r for r in secrets.redact_secrets(docs).collect()}
    assert rows[11]["text"] == "[ASSIGN]\n[ACCESS]\n[HEX]" and rows[11]["n_chars"] == len(rows[11]["text"]) and rows[1]["text"] is None


def test_language_model(spark, docs, none):
    rows = lm.score_documents(docs).collect()
    lower = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in TEXTS}
    learnt = Counter(w for i, _ in ROWS if zlib.crc32(str(i).encode()) % 5 != 1 for w in lower[i])
    n, v = sum(learnt.values()), len(learnt)
    assert len(rows) == len(ROWS)
    for r in rows:
        own = lower[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in learnt for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((learnt[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert r["score"] < 0
    assert lm.score_documents(none).count() == 0


def test_language_model_beats_the_base_on_held_out_text(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):  # two languages; within one, words follow each other
        words = ["the", "cat", "sat", "on", "a", "mat"] if i % 2 else ["le", "chat", "est", "sur", "un", "tapis"]
        at, text = r.randrange(6), []
        for _ in range(60):
            text.append(words[at])
            at = (at + 1) % 6 if r.random() < 0.8 else r.randrange(6)
        rows.append((i, " ".join(text)))
    out = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), group=None, rounds=4, share=0.5)
    total = out.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > 0.8 * total[1]


def test_gradient():
    rng = np.random.default_rng(0)
    flat = gru.initial(rng.random(gru.TOP) + 1, rng.random(gru.CLASSES) + 1).astype(np.float32)
    codes = rng.integers(0, gru.UNSEEN, (6, 3))
    begins = np.zeros((6, 3), bool)
    begins[0] = begins[3, 1] = True
    inputs = np.where(begins, gru.START, np.roll(codes, 1, axis=0))
    h0 = np.zeros((gru.HIDDEN, 3), np.float32)

    def loss(x):
        p, h, total = gru.views(x), h0, 0.0
        for t in range(6):
            h = gru.step(p, p["x"][:, inputs[t]], h * ~begins[t])[0]
            total -= gru.log_probabilities(p, np.r_[h, np.ones((1, 3))], codes[t], np.zeros(gru.GROUPS)).sum()
        return total / 18

    grad = np.zeros_like(flat)
    gru._gradient(gru.views(flat), inputs, codes, begins, h0, gru.views(grad))
    wide = flat.astype(np.float64)
    for k in np.argsort(-np.abs(grad))[:: len(grad) // 60][:20].tolist() + np.argsort(-np.abs(grad))[:20].tolist():
        up, down = wide.copy(), wide.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(grad[k], abs=2e-3)


def test_rounds_learn_from_every_token(spark, monkeypatch):
    """With the production rounds and share, blocks of one, of few and of many documents are passed over as a whole."""
    for lengths in ([7], [5000, 3, 900], [1] * 50, [300] * 40):
        n = sum(lengths)
        seen = np.zeros(n, int)
        for k in range(lm.ROUNDS):
            for a, b in lm.round_stretch(np.array(lengths), k, lm.SHARE):
                seen[a:b] += 1
        assert (seen == 1).all()
    for n in (1, 31, 33, 2048, 2049, 2111, 5000):
        seen = np.zeros(n, int)
        monkeypatch.setattr(gru, "_gradient", lambda p, inputs, targets, begins, h, grad: (np.add.at(seen, targets, 1), h)[1])
        gru.train(np.zeros(gru.N_PARAMETERS, np.float32), np.arange(n), np.zeros(n, bool))
        assert seen.min() == 1 and seen.sum() < n + 64


def test_production_training_beats_the_base_on_held_out_text(spark):
    """Five long documents a block at most, each in words of its own order, so that every document has to be learnt from."""
    r = random.Random(1)
    rows = []
    for i in range(20):
        names, at, text = ["the", "cat", "sat", "on", "a", "mat"], r.randrange(6), []
        for _ in range(4000):
            text.append(names[at])
            at = (at + 1) % 6 if r.random() < 0.8 else r.randrange(6)
        rows.append((i, " ".join(text)))
    out = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), group=None)
    total = out.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > 0.95 * total[1]


def test_secrets_longer_than_their_base_span(spark):
    """A literal goes whole where the base pattern stops at a special character; the base span stays as it is."""
    text = 'password = "Tr0ub4dor&3xyz!Q"\nend'
    base, spans = secrets.scan_text(text)
    assert base == [("assign", 0, 21)] and spans == [("assign", 0, 21), ("named", 12, 28)]
    assert secrets.scan_text("password = hunter2hunter2")[1] == [("assign", 0, 25)]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.redact_secrets(df).first()["text"] == '[ASSIGN]"\nend'


def test_coder_equals_the_library_on_added_tokens():
    """Default settings of the library, on texts that hold the literal of an added token."""
    coder, r = tokens.Coder(tokens.vocabulary()), random.Random(5)
    assert coder.encode(["a<|endoftext|>b"])[0].tolist() == [64, 50256, 65]
    parts = ["<|endoftext|>", "<|endoftext|", "a", " ", "  ", "\n", "word", "'s", "12", "漢", "\xa0", "<|"]
    for _ in range(500):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert coder.encode([t])[0].tolist() == encoded(t)


def test_secrets_through_many_constants():
    """Any number of steps, each worked out once; names are read in the order of the text, and may be long."""
    chain = 'a0 = "Tr0ub4dor3xyzQ9"\n' + "".join(f"a{k} = a{k - 1}\n" for k in range(1, 3000)) + "my_secret = a2999\n"
    assert secrets.named_spans(chain) == [(6, 21)]
    wide = 'v0 = "Tr0ub4dor3xyzQ9"\n' + "".join(f"v{k} = {' + '.join([f'v{k - 1}'] * 4)}\n" for k in range(1, 40)) + "password_x = v39\n"
    assert secrets.named_spans(wide) == [(6, 21)]
    again = 'tok="Tr0ub4dor3xyzQ9"; passwd_ref=tok; tok="no"'
    assert secrets.named_spans(again) == [(5, 20)]
    assert secrets.named_spans('db_secret = later\nlater = "Tr0ub4dor3xyzQ9"') == [(27, 42)]
    assert secrets.named_spans('a = b\nb = a + "Tr0ub4dor3xyzQ9"\nsecret_k = a\n') == [(15, 30)]
    assert secrets.named_spans("x" * 200 + '_password = "Tr0ub4dor3xyzQ9"')
    assert secrets.scan_text("x" * 1_000_000 + " = y\n" + "word " * 200_000) == ([], [])


def test_fences_differ_from_fixed_cutoffs(spark):
    """One share of symbols is an outlier in a clean source and usual in another: only the groups' quantiles can tell."""
    r = random.Random(3)

    def text(share):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) + ("#" if r.random() < share else "") for _ in range(300))

    rows = [(i, text(0.0), "en", "clean") for i in range(200)] + [(1000 + i, text(r.uniform(0.05, 0.15)), "en", "code") for i in range(200)]
    rows += [(2000, text(0.07), "en", "clean"), (2001, text(0.07), "en", "code"), (2002, text(0.9), "en", "code")]
    kept = {x["doc_id"]: x["kept"] for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (kept[2000], kept[2001], kept[2002]) == (False, True, False)
    assert sum(kept[i] for i in range(200)) >= 195 and sum(kept[1000 + i] for i in range(200)) >= 190


def test_no_fixed_fence_gives_the_same_verdicts(spark):
    """Sources that differ in all features: each metric's fences differ between groups, and whatever single fence is put in
    the place of a metric's, verdicts of several documents change."""
    r, rows = random.Random(9), []
    for g in range(4):
        for i in range(80):
            bad = i < 6  # junk by its group's measure: its features are those of groups further on
            level = g + 3 if bad else g
            body = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2 + level, 6 + level))) for _ in range(r.randint(120, 400))]
            body = [w + "#" * (r.random() < 0.03 * 2**level) for w in body]
            rows.append((1000 * g + i, " ".join(body), "en", f"s{g}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    features = quality.text_features(docs).cache()
    fences = {x["source"]: x for x in quality.adaptive_fences(quality.quantile_sketches(features)).collect()}
    bins = {m: [(x["source"], math.ceil(math.log((x[a] + (m == "length")) / (x[b] + 1)) / math.log(quality.GAMMA)) if x[a] else -(10**6)) for x in features.collect()] for m, (a, b, _) in quality.METRICS.items()}
    for m in ("symbols", "length"):
        high = {s: x[f"hi_{m}"] for s, x in fences.items()}
        assert len(set(high.values())) == 4
        assert min(sum((b > high[s]) != (b > fixed) for s, b in bins[m]) for fixed in range(min(high.values()) - 1, max(high.values()) + 2)) >= 5
