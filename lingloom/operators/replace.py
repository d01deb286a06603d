"""Replacements of a book applied one after the other to its texts, and rules that are in each other's way.

Only rules that a text can meet are looked at for it. While the rules are of a checked size, every task has them by book, with
an automaton of their wrong forms. Beyond that a text's rules are looked up by its windows in a join; what the text
becomes on the way may meet more of them, so the windows that replacements made are looked up as well, until none is found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import long_windows
from ..storage import SMALL, sized, stored


class Replacements:
    """Rules in order, and an automaton that finds which of them stand in a text."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules = rules
        self.automaton = ahocorasick.Automaton()
        for k, (wrong, _) in enumerate(rules):
            if wrong and wrong not in self.automaton:
                self.automaton.add_word(wrong, [])
            if wrong:
                self.automaton.get(wrong).append(k)
        self.automaton.make_automaton()
        self.longest = max((len(w) for w, _ in rules), default=0)

    def _standing(self, text: str) -> set[int]:
        return {k for _, own in self.automaton.iter(text) for k in own} if len(self.automaton) else set()

    def apply(self, text: str, made: set[str] | None = None, lengths: tuple[int, ...] = ()) -> str:
        """text with every rule applied in order, to what those before it left. made gets the windows of the given lengths
        that replacements brought about."""
        waiting = sorted(self._standing(text))
        seen = set(waiting)
        while waiting:
            k = heapq.heappop(waiting)
            wrong, right = self.rules[k]
            if wrong not in text:
                continue
            parts = text.split(wrong)
            text = right.join(parts)
            around, reach = [], max(max(lengths, default=0), self.longest) - 1
            at = 0
            for part in parts[:-1]:  # only what touches a replacement is new
                at += len(part)
                around.append(text[max(0, at - reach) : at + len(right) + reach])
                at += len(right)
            for piece in dict.fromkeys(around):
                for j in self._standing(piece):
                    if j > k and j not in seen:
                        seen.add(j)
                        heapq.heappush(waiting, j)
                if made is not None:
                    made.update(piece[i : i + n] for n in lengths for i in range(len(piece) - n + 1))
        return text


def _met(windows: DataFrame, rules: DataFrame) -> DataFrame:
    """book_id, text_key, rule of the rules whose wrong form is one of the windows (book_id, text_key, wrong)."""
    return windows.join(rules, ["book_id", "wrong"]).select("book_id", "text_key", F.struct("place", "wrong", "right").alias("rule")).distinct()


def replace_in_order(segments: DataFrame, rules: DataFrame, order: list[Column], text: str = "text", largest: int = SMALL) -> DataFrame:
    """segments (book_id, text) with the rules (book_id, wrong, right) of their book applied one after the other in order;
    each sees what those before it wrote. Null texts stay null; rules of empty or null wrong forms do nothing."""
    placed = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    rules = rules.where("wrong <> '' AND right IS NOT NULL").select("book_id", placed.alias("place"), "wrong", "right")
    rules, small = sized(stored(rules, "replacements"), largest)
    if small:
        books: dict = {}
        for r in rules.orderBy("book_id", "place", "right").collect():  # of a checked size
            books.setdefault(r["book_id"], []).append((r["wrong"], r["right"]))
        table, cache = segments.sparkSession.sparkContext.broadcast(books), {}

        @F.pandas_udf("string")
        def rewrite(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for own, texts in parts:
                out = []
                for book, t in zip(own, texts):
                    if book not in cache:
                        cache[book] = Replacements(table.value.get(book, []))
                    out.append(None if t is None else cache[book].apply(t))
                yield pd.Series(out, dtype=object)

        return segments.withColumn(text, rewrite(F.col("book_id"), F.col(text)))

    lengths = tuple(sorted(r[0] for r in rules.select(F.length("wrong")).distinct().collect()))  # of forms, which are short
    key = F.xxhash64(text)  # texts of one key share their rules; one that a text does not hold does nothing there
    every = F.flatten(F.array(*[long_windows(F.col(text), n) for n in lengths]))
    met = stored(_met(segments.select("book_id", key.alias("text_key"), F.explode(F.array_distinct(every)).alias("wrong")), rules), "met")
    kind = "array<struct<place:%s,wrong:string,right:string>>" % dict(rules.dtypes)["place"]

    def ordered(own) -> list[tuple[str, str]]:
        found = sorted(own, key=lambda r: (*r["place"].values(), r["right"])) if own is not None else []
        return [(r["wrong"], r["right"]) for r in found]

    @F.pandas_udf("array<string>")
    def made(texts: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for t, o in zip(texts, own):
            new: set[str] = set()
            Replacements(ordered(o)).apply(t, new, lengths)
            out.append(sorted(new))
        return pd.Series(out, dtype=object)

    @F.pandas_udf("string")
    def rewrite_own(texts: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else Replacements(ordered(o)).apply(t) for t, o in zip(texts, own)], dtype=object)

    def listed(found: DataFrame) -> DataFrame:
        return found.groupBy("book_id", "text_key").agg(F.collect_list("rule").cast(kind).alias("_own"))

    new = met
    while new.limit(1).count():
        touched = met.join(new.select("book_id", "text_key").distinct(), ["book_id", "text_key"], "left_semi")
        texts = segments.select("book_id", F.col(text).alias("t"), key.alias("text_key")).join(listed(touched), ["book_id", "text_key"])
        windows = texts.select("book_id", "text_key", F.explode(made("t", "_own")).alias("wrong")).distinct()
        new = stored(_met(windows, rules).join(met, ["book_id", "text_key", "rule"], "left_anti"), "met")
        met = met.unionByName(new)
    rows = segments.withColumn("_key", key).join(listed(met).withColumnRenamed("text_key", "_key"), ["book_id", "_key"], "left")
    return rows.withColumn(text, rewrite_own(F.col(text), F.col("_own"))).select(segments.columns)


def _all_windows(text: str, lengths: list[int]) -> Column:
    return F.array_distinct(F.flatten(F.array(*[long_windows(F.col(text), n) for n in lengths])))


def resolve_rule_conflicts(rules: DataFrame) -> DataFrame:
    """rules (book_id, wrong, right, s_ng; a wrong form once a book) without those in the way of shorter ones: rules that a
    shorter one covers (it makes the same change inside), and then rules whose wrong form holds a shorter rule's right one, or
    whose right form its wrong one, if the shorter rule itself stays.

    Only a shorter rule can strike a rule. So rules of one length are settled once all shorter ones are, and a round for each
    length joins what is left of it with the windows of longer rules.
    """
    rules = stored(rules, "rules")
    sizes = sorted(r[0] for r in rules.select(F.length("wrong")).distinct().collect() if r[0])  # lengths of forms, which are short
    results = sorted(r[0] for r in rules.select(F.length("right")).distinct().collect() if r[0] is not None)
    if len(sizes) < 2:
        return rules
    none = F.array().cast("array<struct<p:int,short:string>>")

    def places(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length("wrong") - (n - 1)), lambda p: F.struct(p.alias("p"), F.substring(F.col("wrong"), p, F.lit(n)).alias("short")))
        return F.when(F.length("wrong") > n, every).otherwise(none)

    inside = rules.select("book_id", "wrong", "right", F.explode(F.flatten(F.array(*map(places, sizes[:-1])))).alias("x")).select("book_id", "wrong", "right", "x.p", "x.short")
    small = rules.select("book_id", F.col("wrong").alias("short"), F.col("right").alias("fixed"))
    covered = inside.join(small, ["book_id", "short"]).where(F.substring(F.col("right"), F.col("p"), F.length("fixed")) == F.col("fixed"))
    left = stored(rules.join(covered.select("book_id", "wrong").distinct(), ["book_id", "wrong"], "left_anti"), "rules")
    for n in sizes[:-1]:
        short = left.where(F.length("wrong") == n).select("book_id", F.col("wrong").alias("short"), F.col("right").alias("fixed"))
        longer = left.where(F.length("wrong") > n).select("book_id", "wrong", "right")
        holds = longer.select("book_id", "wrong", F.explode(_all_windows("wrong", results)).alias("fixed")).join(short, ["book_id", "fixed"], "left_semi")
        makes = longer.select("book_id", "wrong", F.explode(_all_windows("right", [n])).alias("short")).join(short, ["book_id", "short"], "left_semi")
        struck = holds.select("book_id", "wrong").unionByName(makes.select("book_id", "wrong")).distinct()
        left = stored(left.join(struck, ["book_id", "wrong"], "left_anti"), "rules")
    return left.select(rules.columns)
