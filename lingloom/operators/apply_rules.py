"""Applying the rule table in one pass over a text, with guards at word seams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import long_windows
from ..storage import SMALL, stored

#: Characters of context on each side of a hit.
CONTEXT = 12
HIT = "struct<pos:int,wrong:string,right:string,status:string,reason:string,snippet:string>"


class RuleIndex:
    """Rules by text, and an automaton of all of their forms, which reads a text once whatever their number."""

    def __init__(self, rules: list[tuple[str, str, bool]], bigrams: set[str] | frozenset[str] = frozenset()) -> None:
        self.bigrams = bigrams
        self.tables: tuple[dict[str, str], dict[str, str]] = ({}, {})  # manual, guarded
        for wrong, right, manual in rules:
            if wrong and wrong != right:
                self.tables[0 if manual else 1][wrong] = right
        self.automaton = ahocorasick.Automaton()
        for table in self.tables:
            for wrong in table:
                self.automaton.add_word(wrong, wrong)
        self.automaton.make_automaton()

    def places(self, text: str) -> list[tuple[int, list[str]]]:
        """Where some form stands, in order, with the forms that do, longest first."""
        found: dict[int, list[str]] = {}
        if len(self.automaton):
            for end, wrong in self.automaton.iter(text):
                found.setdefault(end + 1 - len(wrong), []).append(wrong)
        return [(at, sorted(found[at], key=len, reverse=True)) for at in sorted(found)]

    def guard(self, text: str, at: int, end: int) -> str | None:
        """The pair of characters across an edge of text[at:end] that is a known bigram; the left edge is looked at first."""
        if at and text[at - 1 : at + 1] in self.bigrams:
            return f"left:{text[at - 1 : at + 1]}"
        if end < len(text) and text[end - 1 : end + 1] in self.bigrams:
            return f"right:{text[end - 1 : end + 1]}"
        return None


class Edges:
    """Where runs of the characters of a pattern begin or end in a text, and its ends, as a set that is asked."""

    def __init__(self, text: str, inside: dict[str, bool], pattern: re.Pattern) -> None:
        self.text, self.inside, self.pattern = text, inside, pattern

    def _in(self, c: str) -> bool:
        if c not in self.inside:
            self.inside[c] = self.pattern.fullmatch(c) is not None
        return self.inside[c]

    def __contains__(self, k: int) -> bool:
        return k == 0 or k == len(self.text) or self._in(self.text[k - 1]) != self._in(self.text[k])


def converted(text: str, index: RuleIndex) -> str:
    """apply_to_text's text by manual rules alone: no guard is asked for."""
    best = {end + 1 - len(w): w for end, w in index.automaton.iter(text)} if len(index.automaton) else {}  # a place's longest comes last
    out, at = [], 0
    for place in sorted(best):
        if place >= at:
            out.append(text[at:place])
            out.append(index.tables[0][best[place]])
            at = place + len(best[place])
    out.append(text[at:])
    return re.sub("…+", "……", "".join(out))


def apply_to_text(text: str, index: RuleIndex, boundaries: list[int] | Edges | None = None, strict: bool = False, keep: bool = True) -> tuple[str, list]:
    """The rewritten text and its hits, or None for each of them if they are not to be kept. Neighbours are read from the
    input; what a rule wrote is not looked at again.

    boundaries: starts of the words of text. A guard is overruled where its two characters are of different words and the
    match is one whole word; strict: unguarded matches must be one whole word too.
    """
    starts = boundaries if boundaries is None or isinstance(boundaries, Edges) else {*boundaries, len(text)}
    out, hits, at = [], [], 0

    def hit(wrong: str, right: str, status: str, reason: str | None) -> None:
        end = at + len(wrong)
        hits.append(None if not keep else {"pos": at, "wrong": wrong, "right": right, "status": status, "reason": reason, "snippet": text[max(0, at - CONTEXT) : end + CONTEXT]})

    for place, forms in index.places(text):
        if place < at:
            continue
        out.append(text[at:place])
        at = place
        wrong = next((w for w in forms if w in index.tables[0]), None)
        chosen = None if wrong is None else (wrong, index.tables[0][wrong], None)
        for wrong in forms if chosen is None else ():
            right, end = index.tables[1][wrong], at + len(wrong)
            reason = index.guard(text, at, end)
            one_word = starts is not None and at in starts and end in starts and not any(k in starts for k in range(at + 1, end))
            if reason is not None:
                edge = at if reason.startswith("left") else end
                if starts is None or edge not in starts or not one_word:
                    hit(wrong, right, "blocked", reason)
                    continue
            elif strict and starts is not None and not one_word:
                hit(wrong, right, "blocked", "unaligned")
                continue
            chosen = (wrong, right, reason)
            break
        if chosen is not None:
            hit(chosen[0], chosen[1], "applied", chosen[2] and f"overruled {chosen[2]}")
            out.append(chosen[1])
            at += len(chosen[0])
    out.append(text[at:])
    return re.sub("…+", "……", "".join(out)), hits


#: Characters of text that are rewritten at once: hits are many times larger than what they stand for.
SLICE = 1 << 20


def _run(texts: pd.Series, boundaries: pd.Series | None, index_of, strict: bool, keep: bool, words: str | None) -> Iterator[pd.DataFrame]:
    rows, size, columns = [], 0, ["text", "hits" if keep else "n_hits"]
    pattern, inside = words and re.compile(words), {}
    for k, t in enumerate(texts):
        if t is None:
            rows.append((None, [] if keep else 0))
        else:
            b = None if boundaries is None or boundaries.iloc[k] is None else list(boundaries.iloc[k])
            index = index_of(k)
            if not keep and not words and b is None and not index.tables[1]:
                text, hits = converted(t, index), ()
            else:
                text, hits = apply_to_text(t, index, Edges(t, inside, pattern) if words else b, strict, keep)
            rows.append((text, hits if keep else len(hits)))
            size += len(t)
        if size >= SLICE:
            yield pd.DataFrame(rows, columns=columns)
            rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def apply_rules(df: DataFrame, rules: DataFrame, bigrams: DataFrame, text: str = "text", boundaries: str | None = None, strict: bool = False, largest: int = SMALL, hits: bool = True, words: str | None = None) -> DataFrame:
    """df with applied: STRUCT<text, hits>, or STRUCT<text, n_hits> with hits=False. rules: wrong, right, manual; bigrams: bg. Of
    more than largest bytes, they are not sent whole to every task: each text gets the ones that occur in it. boundaries: a
    column of the starts of words; or words: a pattern of one character, where runs of such and of others are the words."""
    schema = f"text string, hits array<{HIT}>" if hits else "text string, n_hits int"
    spark = df.sparkSession
    rules, bigrams = stored(rules.select("wrong", "right", "manual"), "rules"), stored(bigrams.select("bg"), "bigrams")
    size = rules.agg(F.sum(F.octet_length("wrong") + F.octet_length("right"))).first()[0] or 0
    if size + (bigrams.agg(F.sum(F.octet_length("bg"))).first()[0] or 0) <= largest:
        table = spark.sparkContext.broadcast(([tuple(r) for r in rules.select("wrong", "right", "manual").collect()], frozenset(r[0] for r in bigrams.select("bg").collect())))
        cache: dict[int, RuleIndex] = {}

        @F.pandas_udf(schema)
        def rewrite(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            index = cache.setdefault(0, RuleIndex(*table.value))
            for texts, bounds in parts:
                yield from _run(texts, bounds if boundaries else None, lambda k: index, strict, hits, words)

        return df.withColumn("applied", rewrite(F.col(text), F.col(boundaries) if boundaries else F.lit(None).cast("array<int>")))

    # each text with the rules and bigrams that occur in it, found by equality of windows
    keyed = stored(df.withColumn("_id", F.monotonically_increasing_id()), "keyed")  # written, so that ids never change
    sizes = [r[0] for r in rules.select(F.length("wrong")).distinct().collect()]

    held = keyed.select("_id", F.explode(F.array_distinct(F.flatten(F.array(*[long_windows(F.col(text), n) for n in sizes or [1]])))).alias("wrong"))
    own = held.join(rules.select("wrong", "right", "manual"), "wrong").groupBy("_id").agg(F.collect_list(F.struct("wrong", "right", "manual")).alias("_rules"))
    pairs = keyed.select("_id", F.explode(F.array_distinct(long_windows(F.col(text), 2))).alias("bg")).join(bigrams.select("bg"), "bg").groupBy("_id").agg(F.collect_list("bg").alias("_bigrams"))

    @F.pandas_udf(schema)
    def rewrite_own(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, bounds, own_rules, own_bigrams in parts:

            def index_of(k: int, own_rules=own_rules, own_bigrams=own_bigrams) -> RuleIndex:
                found = own_rules.iloc[k] if own_rules.iloc[k] is not None else []
                return RuleIndex([(r["wrong"], r["right"], r["manual"]) for r in found], frozenset(own_bigrams.iloc[k] if own_bigrams.iloc[k] is not None else ()))

            yield from _run(texts, bounds if boundaries else None, index_of, strict, hits, words)

    joined = keyed.join(own, "_id", "left").join(pairs, "_id", "left")
    bounds = F.col(boundaries) if boundaries else F.lit(None).cast("array<int>")
    return joined.withColumn("applied", rewrite_own(F.col(text), bounds, F.col("_rules"), F.col("_bigrams"))).drop("_id", "_rules", "_bigrams")


def rule_hits(applied: DataFrame) -> DataFrame:
    """book_id, pair_pos and the fields of every hit. applied: book_id, pair_pos, applied."""
    return applied.select("book_id", "pair_pos", F.explode("applied.hits").alias("h")).select("book_id", "pair_pos", "h.*")


def rule_hit_log(hits: DataFrame, keep: int = 3) -> DataFrame:
    """book_id, status, wrong, right, n, snippets (the first keep), rank: by kept snippets, then by all hits."""
    hits, rule = stored(hits, "hits"), ["book_id", "status", "wrong", "right"]
    order = Window.partitionBy(*rule).orderBy("pair_pos", "pos")
    first = hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep)  # tasks pass on so many each
    first = first.groupBy(*rule).agg(F.array_sort(F.collect_list(F.struct("_r", "snippet"))).alias("s"))
    log = hits.groupBy(*rule).agg(F.count("*").alias("n")).join(first, rule)
    log = log.withColumn("snippets", F.col("s.snippet")).drop("s")
    ranked = Window.partitionBy("book_id", "status").orderBy(F.desc(F.size("snippets")), F.desc("n"), "wrong", "right")
    return log.withColumn("rank", F.row_number().over(ranked))
