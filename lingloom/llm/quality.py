"""Quality rules with thresholds that adapt to language and source, in DataFrame operations only.

Text features are row-local array expressions. Their distributions are kept per (language, source) in mergeable quantile
sketches with relative accuracy: logarithmic bins, merged by adding counts. A document is rejected where a feature lies
beyond the quartile fences of its own group, worked out on the sketches' scale; there are no fixed cutoffs.

A share is sketched as (count + 1) / (size + 1): texts without a single symbol or repeat then differ by their length, so
quartiles of groups that are mostly clean are not all zero. It is judged as count / (size + 1), so what has none is never
outside, whatever its length, and one symbol in a short text is not taken for a habit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small_or_shuffled
from .common import WORD, stored
from .mixing import SYMBOLS

GAMMA = 1.02
#: feature: (counted, out of how many, whether it has a lower fence)
METRICS = {
    "symbols": ("n_symbols", "n_words", False),
    "lines": ("n_dup_lines", "n_lines", False),
    "repeats": ("n_repeat_words", "n_words", False),
    "length": ("word_chars", "n_words", True),
}
#: Fences lie so many distances of the quartiles beyond them.
FENCE = 3
#: Groups of fewer documents are judged by their language alone; a language of fewer has quartiles at least so many bins apart.
SMALL, ROOM = 20, 10
_SPACES = r"[\x20\x09-\x0D]+"


def text_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every text; null: as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select(
        *keep,
        F.filter(F.split(text, _SPACES), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
        F.length(F.regexp_replace(text, SYMBOLS.replace("[", "[^") + "+", "")).cast("long").alias("n_symbols"),
    )
    # 3-word windows as (hash, place), sorted: a window repeats where a neighbour has its hash and its three words
    parts = parts.withColumn("_grams", F.expr("sort_array(transform(slice(_words, 1, greatest(0, size(_words) - 2)), (x, i) -> struct(xxhash64(x, _words[i + 1], _words[i + 2]) AS g, i AS i)))"))
    equal = "x.g = get(_grams, {k}).g AND _words[x.i] = _words[get(_grams, {k}).i] AND _words[x.i + 1] = _words[get(_grams, {k}).i + 1] AND _words[x.i + 2] = _words[get(_grams, {k}).i + 2]"
    places = f"sort_array(transform(filter(_grams, (x, k) -> (k > 0 AND {equal.format(k='k - 1')}) OR ({equal.format(k='k + 1')})), x -> x.i))"
    # the words they cover, each once
    repeated = F.expr(f"""
        aggregate({places}, named_struct('n', 0L, 'last', -1),
            (a, i) -> named_struct('n', a.n + i + 2 - greatest(a.last, i - 1), 'last', i + 2),
            a -> a.n)""")
    return parts.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bin(a: Column, b: Column) -> Column:
    return F.ceil(F.log(a / b) / F.log(F.lit(GAMMA))).cast("int")


def quantile_sketches(features: DataFrame, by: tuple[str, ...] = ("lang", "source"), metrics: dict = METRICS) -> DataFrame:
    """One row (by, metric, bin, n) a bin, over the documents that pass the base rules: value v is in bin
    ceil(log(v) / log(GAMMA))."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), _bin(F.col(a) + 1, F.col(b) + 1).alias("bin")) for m, (a, b, _) in metrics.items()])
    # not a filter, which would be pushed below the features and work them out again for each of their parts
    long = features.select(*by, F.explode(F.when(~base_failed(), values)).alias("x")).select(*by, "x.metric", "x.bin")
    return long.groupBy(*by, "metric", "bin").count().withColumnRenamed("count", "n")


def merge_sketches(sketches: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Sketches of parts, or of finer groups, as sketches of the groups in by."""
    return sketches.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, metric, q1, q3, of: the bins of the quartiles and the number of values of each sketch."""
    order = Window.partitionBy(*by, "metric").orderBy("bin")
    rows = sketches.withColumn("upto", F.sum("n").over(order)).withColumn("of", F.sum("n").over(Window.partitionBy(*by, "metric")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("of"), F.col("bin")))
    return rows.groupBy(*by, "metric").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("of").alias("of"))


def adaptive_fences(sketches: DataFrame, by: tuple[str, ...] = ("lang", "source"), pool: tuple[str, ...] = ("lang",), metrics: dict = METRICS) -> DataFrame:
    """by, lo_<metric>, hi_<metric>: the last bins inside, which are the quartiles of each sketch, widened by FENCE times their
    distance (of one bin at least, the sketches' accuracy).

    No fence is wider than that of the sketches pooled by the columns in pool, so that a group full of junk does not set
    its own; groups below SMALL documents have the pooled fence alone.
    """

    def widened(rows: DataFrame, by: tuple[str, ...], lo: str, hi: str, room: Column) -> DataFrame:
        spread = FENCE * F.greatest(F.col("q3") - F.col("q1"), room)
        return rows.select(*by, "metric", "of", (F.col("q1") - spread).alias(lo), (F.col("q3") + spread).alias(hi))

    own = widened(quartiles(sketches, by), by, "lo", "hi", F.lit(1)).alias("o")
    whole = widened(quartiles(merge_sketches(sketches, pool), pool), pool, "pool_lo", "pool_hi", F.when(F.col("of") < SMALL, ROOM).otherwise(1)).alias("w")
    same = F.col("o.metric") == F.col("w.metric")
    for c in pool:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"w.{c}"))
    rows = own.join(whole, same).select(*[f"o.{c}" for c in by], "o.metric", "o.of", "lo", "hi", "pool_lo", "pool_hi")
    few = F.col("of") < SMALL
    high = F.when(few, F.col("pool_hi")).otherwise(F.least("hi", "pool_hi"))
    low = F.when(few, F.col("pool_lo")).otherwise(F.greatest("lo", "pool_lo"))
    out = []
    for m, (_, _, two_sided) in metrics.items():
        out.append(F.max(F.when(F.col("metric") == m, high)).alias(f"hi_{m}"))
        if two_sided:
            out.append(F.max(F.when(F.col("metric") == m, low)).alias(f"lo_{m}"))
    return rows.groupBy(*by).agg(*out)


def _judged(features: DataFrame, limits: DataFrame, carried: str, by: tuple[str, ...]) -> DataFrame:
    """carried (a column of features), the features, base_failed and kept. limits are a row a group: they go to every task
    while they are small, so that rows need not move to meet them."""
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}"))
    inside = F.lit(True)
    for m, (a, b, two_sided) in METRICS.items():
        n, of = F.col(f"f.{a}"), F.col(f"f.{b}") + 1
        if two_sided:
            inside = inside & _bin(n + 1, of).between(F.col(f"t.lo_{m}"), F.col(f"t.hi_{m}"))
        else:
            inside = inside & ((n == 0) | (_bin(F.greatest(n, F.lit(1)), of) <= F.col(f"t.hi_{m}")))
    judged = features.withColumn("base_failed", base_failed()).alias("f").join(small_or_shuffled(stored(limits, "fences")).alias("t"), same, "left")
    kept = F.when(F.col("f.base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(False)))
    return judged.select(*[f"f.{c}" for c in (carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], kept.alias("kept"))


def quality_rules(docs: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the features, base_failed and kept for every row of docs (doc_id, text and the columns in by).

    Null and empty texts have no words and fail; null group columns form groups of their own; equal rows get equal
    verdicts; a null id stays null; an empty table gives no rows; columns named like the features are read from neither
    input nor output.
    """
    features = stored(text_features(docs, ("doc_id", *by)), "quality")
    return _judged(features, adaptive_fences(quantile_sketches(features, by), by), "doc_id", by)


def keep_quality(docs: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of docs that the rules keep, each judged by itself; every column, null ids and repeated rows stay as they
    are. Features are worked out twice, for the fences and for the verdict of the row at hand, so texts are neither shuffled
    nor stored."""
    limits = adaptive_fences(quantile_sketches(text_features(docs.select("text", *by), by), by), by)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", *by)
    return _judged(text_features(rows, ("row", *by)), limits, "row", by).where("kept").select("row.*")
