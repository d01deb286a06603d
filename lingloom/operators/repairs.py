"""Repairs: characters lost in conversion, and fixed words that lost their last one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import convert_primary, long_windows, next_chars
from ..storage import sized, small_or_shuffled, stored
from .consistency import Forms, apply_replacements
from .diff import edits
from .finder import automaton_of, standing

# Fixed value: particles whose loss is no error.
DROPPABLE = "在了的地得也都就才還又已把被向給讓對於對從从往至及們么啊喔嘛呢嘍噢哦之個些"

REPAIR = "array<struct<wrong:string,right:string>>"


def missing_characters(src: str, expected: str, tgt: str, bigrams: frozenset[str], forms: dict[str, list[str]], droppable: str = DROPPABLE) -> list[tuple[str, str]]:
    """(wrong, right) contexts of up to two characters on each side of every place where target lacks one character of
    what was expected: an edit that drops one character, or leaves one of two in a legal form."""
    found = []
    for a, b, c, d in edits(expected, tgt):
        if b - a == 1 and d == c:
            right = expected[b : b + 1]
        elif b - a == 2 and d - c == 1 and tgt[c] in (forms.get(src[a + 1]) or [src[a + 1]]):
            right = tgt[c]
        else:
            continue
        lost, left = expected[a], expected[a - 1] if a else ""
        around = {left + lost, lost + right}
        known = bool(around & bigrams)
        in_source = lost not in droppable and any(len(n) == 2 and n in expected for n in around)
        if not (known or in_source) or any(n and n not in tgt for n in (left, right)):
            continue
        head, tail = tgt[max(0, c - 2) : c], tgt[c : c + 2]
        if head + tail:
            found.append((head + tail, head + lost + tail))
    return found


def diff_repairs(pairs: DataFrame, primary: dict[str, str], forms: dict[str, list[str]], bigrams: DataFrame, droppable: str = DROPPABLE) -> DataFrame:
    """book_id, wrong, right, pair_pos, k: the first repair of every wrong context of a book. Only pairs whose target is
    not what conversion character by character gives are compared; a pair is one row of its book_id and pair_pos."""
    rows = pairs.withColumn("_e", convert_primary(F.col("src"), primary)).where((F.col("_e") != F.col("tgt")) & F.col("tgt").isNotNull())
    listed, small = sized(stored(bigrams.where(F.length("bg") == 2).select("bg").distinct(), "bigrams"))
    if small:
        shared = pairs.sparkSession.sparkContext.broadcast(frozenset(r["bg"] for r in listed.collect()))

        @F.pandas_udf(REPAIR)
        def compare_all(src: pd.Series, expected: pd.Series, tgt: pd.Series) -> pd.Series:
            return pd.Series([[{"wrong": w, "right": r} for w, r in missing_characters(s, e, t, shared.value, forms, droppable)] for s, e, t in zip(src, expected, tgt)], dtype=object)

        return _first_repairs(rows, compare_all("src", "_e", "tgt"))
    # a pair gets the bigrams that it can ask for: those of its expected text, or with a second character of another form
    both = F.explode(F.array_distinct(F.arrays_zip(long_windows(F.col("_e"), 2).alias("e"), long_windows(F.col("src"), 2).alias("s"))))
    seen = rows.select("book_id", "pair_pos", both.alias("w")).select("book_id", "pair_pos", "w.e", F.left("w.e", F.lit(1)).alias("a"), F.right("w.s", F.lit(1)).alias("simp"))
    other = seen.join(F.broadcast(Forms(forms).table(pairs)), "simp").select("book_id", "pair_pos", F.concat("a", "trad").alias("bg"))
    asked = seen.select("book_id", "pair_pos", F.explode(F.array("e", F.concat("a", "simp"))).alias("bg")).unionByName(other)
    held = asked.join(listed, "bg").groupBy("book_id", "pair_pos").agg(F.collect_set("bg").alias("_own"))

    @F.pandas_udf(REPAIR)
    def compare(src: pd.Series, expected: pd.Series, tgt: pd.Series, own: pd.Series) -> pd.Series:
        known = [frozenset(b) if b is not None else frozenset() for b in own]
        return pd.Series([[{"wrong": w, "right": r} for w, r in missing_characters(s, e, t, b, forms, droppable)] for s, e, t, b in zip(src, expected, tgt, known)])

    rows = rows.join(held, ["book_id", "pair_pos"], "left")
    return _first_repairs(rows, compare("src", "_e", "tgt", "_own"))


def _first_repairs(rows: DataFrame, found: Column) -> DataFrame:
    """The first repair of every wrong context of a book; tasks pass on one each."""
    rows = rows.select("book_id", "pair_pos", F.posexplode(found).alias("k", "x"))
    first = rows.groupBy("book_id", F.col("x.wrong").alias("wrong")).agg(F.min(F.struct("pair_pos", "k", F.col("x.right").alias("right"))).alias("m"))
    return first.select("book_id", "wrong", "m.right", "m.pair_pos", "m.k")


def safe_repairs(repairs: DataFrame, pairs: DataFrame, primary: dict[str, str]) -> DataFrame:
    """repairs without those whose wrong context stands in some pair of the book at the same place of the target and of
    what conversion character by character gives: it is right there. Places are met by equality of windows."""
    repairs = stored(repairs, "repairs")
    both = pairs.select("book_id", F.col("tgt"), convert_primary(F.col("src"), primary).alias("e"))
    listed, small = sized(stored(repairs.select("wrong").distinct(), "wrong"))
    if small:
        same = standing(F.col("tgt"), listed, F.col("e"))
    else:
        every = [F.filter(F.transform(F.arrays_zip(long_windows(F.col("tgt"), n).alias("x"), long_windows(F.col("e"), n).alias("y")), lambda w: F.when(w["x"] == w["y"], w["x"])), lambda w: w.isNotNull()) for n in (1, 2, 3, 4)]
        same = F.array_distinct(F.flatten(F.array(*every)))  # contexts have one to four characters
    right = both.select("book_id", F.explode(same).alias("wrong")).distinct()
    return repairs.join(right, ["book_id", "wrong"], "left_anti")


def apply_repairs(segments: DataFrame, repairs: DataFrame, text: str = "text") -> DataFrame:
    """segments with a book's repairs applied one after the other, in the order in which they were first seen."""
    return apply_replacements(segments, repairs, ("pair_pos", "k", "wrong"), text)


def fixed_word_candidates(headwords: DataFrame, forms: Forms, pairs: DataFrame, least: int = 4) -> DataFrame:
    """book_id, word: headwords of least characters or more without convertible ones that stand in a source of the book."""
    words = headwords.select("word").distinct().where((F.length("word") >= least) & forms.all_fixed(F.col("word")))
    return _standing(pairs.select("book_id", "pair_pos", "src"), words, "word", least, []).select("book_id", "word").distinct()


def _standing(pairs: DataFrame, words: DataFrame, part: str, least: int, by: list[str]) -> DataFrame:
    """Pairs with the words of which part (least characters or more) stands in the source; by: book_id, if words are a book's.
    While the words are small, they are found in the row, and a pair is copied for what stands in it alone. Beyond that the
    distinct windows of least characters, without their texts, meet the parts' beginnings, and the rest is compared."""
    listed, small = sized(stored(words.withColumn("_k", F.left(part, F.lit(least))), "words"))
    if small:
        found = pairs.select("*", F.explode(standing(F.col("src"), listed.select(part))).alias(part))
        return found.join(listed.drop("_k"), [*by, part])
    key = F.explode(F.array_distinct(long_windows(F.col("src"), least))).alias("_k")
    met = pairs.select("book_id", "pair_pos", key).join(listed, [*by, "_k"]).join(pairs, ["book_id", "pair_pos"])
    return met.where(F.contains("src", F.col(part))).drop("_k")


def _pair_words(candidates: DataFrame, pairs: DataFrame, part: str) -> DataFrame:
    """Pairs with the candidates of their book of which part stands in the source."""
    words = candidates.withColumn("prefix", F.expr("substring(word, 1, length(word) - 1)"))
    return _standing(pairs, words, part, 3, ["book_id"])


#: Distinct rows that a task gathers before it passes them on.
MOST = 200_000


def _gathered(pairs: DataFrame, words: DataFrame, columns: list[str], schema: str, parts, gather, told=lambda found, _: found) -> DataFrame:
    """What gather(found, automaton of the parts, *columns) counts in found, for every row of pairs with words of its book.
    words: a table of a checked size; parts(word): what is looked for. One row a key of told(found, words by their part) and
    its count, so far as one task saw them, with the book before and the count after."""
    books: dict = {}
    for r in words.select("book_id", "word").distinct().collect():
        books.setdefault(r["book_id"], {}).setdefault(parts(r["word"]), []).append(r["word"])
    shared = pairs.sparkSession.sparkContext.broadcast(books)
    kind = pairs.schema["book_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders: dict = {}
        found: dict = {}
        type_ = names = None

        def rows() -> Iterator[pa.RecordBatch]:
            for book in found:
                if own := told(found[book], shared.value[book]):
                    arrays = [pa.array(x) for x in zip(*own)]
                    yield pa.RecordBatch.from_arrays([pa.array([book] * len(own), type_), *arrays, pa.array(own.values(), pa.int64())], names)

        names = [f.split()[0] for f in f"book_id {kind}, {schema}, n bigint".split(", ")]
        for batch in batches:
            type_ = batch.schema.field("book_id").type
            for book, *own in zip(*(batch.column(c).to_pylist() for c in ("book_id", *columns))):
                if book is not None and book in shared.value:
                    if book not in finders:
                        finders[book] = automaton_of(shared.value[book])
                    gather(found.setdefault(book, Counter()), finders[book], *own)
            if sum(map(len, found.values())) >= MOST:
                yield from rows()
                found.clear()
        yield from rows()

    return pairs.select("book_id", *columns).mapInArrow(count, f"book_id {kind}, {schema}, n bigint")


def _contexts_in_row(found: Counter, finder, src: str | None, ends: bool | None) -> None:
    """Has (prefix, the two characters after it), one before the end of src, there a newline or nothing."""
    if src:
        tail = "\n" if ends else ""
        dict.update(found, {(p, src[end + 1 : end + 3] or tail): 1 for end, p in finder.iter(src)})


def _contexts_told(found: Counter, words: dict[str, list[str]]) -> dict:
    """(word, kind, character): x after the word's prefix, if it isn't the word's last one; y after the word."""
    out = {}
    for prefix, two in found:
        for word in words[prefix]:
            if two[:1] != word[-1]:
                if two:
                    out[word, "x", two[0]] = 1
            elif len(two) == 2:
                out[word, "y", two[1]] = 1
    return out


def _lacking_in_row(found: Counter, finder, src: str | None, tgt: str | None) -> None:
    """Counts (word, character) after every place in tgt of the prefix of a word that src has and tgt lacks."""
    if src is None or tgt is None or src == tgt:
        return
    for word in {w for _, w in finder.iter(src)}.difference(w for _, w in finder.iter(tgt)):
        prefix = word[:-1]
        p = tgt.find(prefix)
        while p >= 0:
            found[word, tgt[p + len(prefix) : p + len(word)]] += 1
            p = tgt.find(prefix, p + 1)


def fixed_word_contexts(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """book_id, word, extensions, followers: characters after the word's prefix other than its last one (a newline at the
    end of every source but a book's last), and characters after the whole word. Worked out once and stored. While the words
    are small, they are looked up in the row, and what leaves a task are distinct characters alone."""
    candidates, small = sized(stored(candidates.select("book_id", "word"), "words"))
    last_pos = small_or_shuffled(stored(pairs.groupBy("book_id").agg(F.max("pair_pos").alias("_last")), "last"))
    none = F.array().cast("array<string>")
    if small:
        own = pairs.join(last_pos, "book_id").withColumn("ends", F.col("pair_pos") < F.col("_last"))
        rows = _gathered(own, candidates, ["src", "ends"], "word string, kind string, c string", lambda w: w[:-1], _contexts_in_row, _contexts_told)
        each = lambda k, c: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("c")))).alias(c)
        found = rows.groupBy("book_id", "word").agg(each("x", "extensions"), each("y", "followers"))
        out = candidates.join(found, ["book_id", "word"], "left")
        return stored(out.select("book_id", "word", F.coalesce("extensions", none).alias("extensions"), F.coalesce("followers", none).alias("followers")), "contexts")
    held = _pair_words(candidates, pairs, "prefix").join(last_pos, "book_id")
    text = F.when(F.col("pair_pos") < F.col("_last"), F.concat("src", F.lit("\n"))).otherwise(F.col("src"))
    nexts, after = next_chars(text, F.col("prefix")), next_chars(F.col("src"), F.col("word"))
    rows = held.select("book_id", "word", F.filter(nexts, lambda c: (c != "") & (c != F.right("word", F.lit(1)))).alias("x"), F.filter(after, lambda c: c != "").alias("y"))
    each = lambda c: rows.select("book_id", "word", F.explode(F.array_distinct(c)).alias(c)).groupBy("book_id", "word").agg(F.array_sort(F.collect_set(c)).alias(c))
    out = candidates.join(each("x"), ["book_id", "word"], "left").join(each("y"), ["book_id", "word"], "left")
    return stored(out.select("book_id", "word", F.coalesce("x", none).alias("extensions"), F.coalesce("y", none).alias("followers")), "contexts")


def fixed_word_tallies(contexts: DataFrame, pairs: DataFrame, headwords: DataFrame) -> DataFrame:
    """book_id, word, n_subst, n_trunc, n_false: occurrences of the prefix in targets that lack a word which their source
    has; false if the prefix and the next character are a headword, truncated before a known follower, else substituted,
    the end of the target included. While the words are small, a task passes on counts by word and next character alone."""
    words, small = sized(stored(contexts.select("book_id", "word").distinct(), "words"))
    if small:
        rows = _gathered(pairs, words, ["src", "tgt"], "word string, c string", lambda w: w, _lacking_in_row)
        rows = rows.groupBy("book_id", "word", "c").agg(F.sum("n").alias("n")).join(contexts.select("book_id", "word", "followers"), ["book_id", "word"])
        rows = rows.withColumn("other", F.concat(F.expr("substring(word, 1, length(word) - 1)"), "c"))
    else:
        held = _pair_words(contexts, pairs, "word").where(~F.contains("tgt", F.col("word")))
        rows = held.select("book_id", "word", "prefix", "followers", F.explode(next_chars(F.col("tgt"), F.col("prefix"))).alias("c"))
        rows = rows.withColumn("other", F.concat("prefix", "c")).withColumn("n", F.lit(1))
    rows = rows.join(headwords.select(F.col("word").alias("other"), F.lit(True).alias("_h")).distinct(), "other", "left")
    false = (F.col("c") != "") & F.coalesce("_h", F.lit(False))
    trunc = ~false & F.array_contains("followers", F.col("c"))
    n = lambda c: F.sum(F.col("n") * c.cast("long"))
    return rows.groupBy("book_id", "word").agg(n(~false & ~trunc).alias("n_subst"), n(trunc).alias("n_trunc"), n(false).alias("n_false"))


def fixed_word_repairs(tallies: DataFrame) -> DataFrame:
    """tallies of words to repair: not fewer true than false cases, and one substitution, or two truncations, or one of a
    word that repeats a character."""
    at = lambda i: F.substring(F.col("word"), F.lit(i), F.lit(1))
    doubled = (F.expr("substring(word, -2, 1)") == F.right("word", F.lit(1))) | ((F.length("word") == 4) & (at(1) == at(2)) & (at(3) == at(4)))
    true = F.col("n_subst") + F.col("n_trunc")
    enough = (F.col("n_subst") >= 1) | (F.col("n_trunc") >= F.when(doubled, 1).otherwise(2))
    return tallies.where((true > 0) & (true >= F.col("n_false")) & enough)


def repair_fixed_words(text: str, words: list[dict]) -> str:
    """text with every cut word completed. words: word, extensions, followers, heads (characters that make the prefix a
    headword)."""
    for w in words:
        prefix, out, at = w["word"][:-1], [], 0
        while (p := text.find(prefix, at)) >= 0:
            end = p + len(prefix)
            c = text[end : end + 1]
            out.append(text[at:p])
            if c == w["word"][-1] or c and (c in w["heads"] or c in w["extensions"]):
                out.append(prefix + c)
            else:
                out.append(w["word"] + (c if c and c in w["followers"] else ""))
            at = end + len(c)
        text = "".join([*out, text[at:]])
    return text


def apply_fixed_word_repairs(segments: DataFrame, repairs: DataFrame, contexts: DataFrame, headwords: DataFrame, text: str = "text") -> DataFrame:
    """segments (book_id, text) with the fixed words of their book completed, one word after the other in order."""
    heads = headwords.select(F.expr("substring(word, 1, length(word) - 1)").alias("prefix"), F.right("word", F.lit(1)).alias("c")).distinct()
    rows = repairs.select("book_id", "word").join(contexts, ["book_id", "word"]).withColumn("prefix", F.expr("substring(word, 1, length(word) - 1)"))
    rows = rows.join(heads, "prefix", "left").groupBy("book_id", "word", "extensions", "followers").agg(F.array_sort(F.collect_set("c")).alias("heads"))
    rows, small = sized(stored(rows.select("book_id", "word", "extensions", "followers", "heads"), "words"))
    fields = ("extensions", "followers", "heads")

    if small:
        books: dict = {}
        for w in rows.orderBy("book_id", "word").collect():  # of a checked size
            books.setdefault(w["book_id"], []).append({"word": w["word"], **{k: set(w[k]) for k in fields}})
        shared = segments.sparkSession.sparkContext.broadcast(books)

        @F.pandas_udf("string")
        def repair_all(own: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else repair_fixed_words(t, shared.value.get(b, ())) for b, t in zip(own, texts)], dtype=object)

        return segments.withColumn(text, repair_all(F.col("book_id"), F.col(text)))

    listed = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("word", *fields))).alias("_words"))

    @F.pandas_udf("string")
    def repair(texts: pd.Series, words: pd.Series) -> pd.Series:
        def row(t, own):
            if t is None or own is None:
                return t
            return repair_fixed_words(t, [{"word": w["word"], **{k: set(w[k]) for k in fields}} for w in own])

        return pd.Series([row(t, w) for t, w in zip(texts, words)])

    joined = segments.join(stored(listed, "words"), "book_id", "left")
    return joined.withColumn(text, repair(F.col(text), F.col("_words"))).drop("_words")
