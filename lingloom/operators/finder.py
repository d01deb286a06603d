"""Which of many short strings stand in a text, found in the row where the text is."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def automaton_of(words) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in words:
        if w:
            out.add_word(w, w)
    out.make_automaton()
    return out


def standing(text: Column, words: DataFrame, beside: Column | None = None) -> Column:
    """The distinct strings of words (one column, of a size that sized() has checked) that stand in text, in order; with
    beside, only those that stand at some place of text and at the same place of beside. Null text: null. Each task builds
    one automaton of all of them, and a text is read once."""
    shared = words.sparkSession.sparkContext.broadcast([r[0] for r in words.distinct().collect()])
    cache: list[ahocorasick.Automaton] = []
    alone = beside is None

    @F.pandas_udf("array<string>")
    def find(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if not cache:
            cache.append(automaton_of(shared.value))
        search = cache[0].iter if len(cache[0]) else lambda _: ()
        for texts, others in parts:
            out = []
            for t, o in zip(texts, others):
                if t is None:
                    out.append(None)
                elif alone:
                    out.append(sorted({w for _, w in search(t)}))
                else:
                    out.append(sorted({w for end, w in search(t) if o is not None and o.startswith(w, end + 1 - len(w))}))
            yield pd.Series(out, dtype=object)

    return find(text, F.lit(None).cast("string") if alone else beside)
