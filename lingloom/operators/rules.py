"""The rule table: wrong form -> right form, mined from headwords and merged with manual corrections and variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_class, normalize_variants

# Fixed value: punctuation that no bigram holds.
PUNCTUATION = "，。！？；：「」『』【】〔〕（）…—～、·　"
MANUAL, GENERATED, VARIANT = 1, 2, 3


def long_char_map(char_map: DataFrame) -> DataFrame:
    """simp, trad, rank (from 0), line_no: one row a listed form."""
    return char_map.select("simp", "line_no", F.posexplode("trads").alias("rank", "trad"))


def alternatives(char_map: DataFrame) -> DataFrame:
    """char, alt: of a first form its other forms; of another form that is no first form anywhere, the first form on its
    last line."""
    forms = long_char_map(char_map)
    first = forms.where("rank = 0").select("line_no", F.col("trad").alias("primary"))
    other = forms.where("rank > 0").join(first, "line_no").where(F.col("trad") != F.col("primary"))
    down = other.select(F.col("primary").alias("char"), F.col("trad").alias("alt")).distinct()
    last = Window.partitionBy("trad").orderBy(F.desc("line_no"), F.desc("rank"))
    up = other.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(F.col("trad").alias("char"), F.col("primary").alias("alt"))
    return down.unionByName(up.join(down.select("char").distinct(), "char", "left_anti"))


def natural_forms(char_map: DataFrame) -> DataFrame:
    """char, natural: the first form (on the last line) of the character that first lists char as a form."""
    forms = long_char_map(char_map)
    earliest = Window.partitionBy("trad").orderBy("line_no", "rank")
    source = forms.withColumn("_r", F.row_number().over(earliest)).where("_r = 1").select(F.col("trad").alias("char"), "simp")
    latest = Window.partitionBy("simp").orderBy(F.desc("line_no"))
    first = forms.where("rank = 0").withColumn("_r", F.row_number().over(latest)).where("_r = 1").select("simp", F.col("trad").alias("natural"))
    return source.join(first, "simp").select("char", "natural")


def generate_rules(headwords: DataFrame, char_map: DataFrame) -> DataFrame:
    """wrong, right: headwords with one character in another form, where the result is no headword and the other form is
    what conversion naturally gives; of several headwords for a wrong form the smallest."""
    swaps = alternatives(char_map).join(natural_forms(char_map), "char").where(F.col("alt") == F.col("natural")).select("char", "alt")
    words = headwords.select("word").distinct().where(F.length("word") >= 2)
    chars = words.select("word", F.posexplode(F.split("word", "")).alias("pos", "char")).where(F.col("char") != "")
    swapped = chars.join(swaps, "char").select(
        F.concat(F.expr("substring(word, 1, pos)"), "alt", F.expr("substring(word, pos + 2)")).alias("wrong"), F.col("word").alias("right")
    )
    swapped = swapped.where(F.col("wrong") != F.col("right")).join(headwords.select(F.col("word").alias("wrong")), "wrong", "left_anti")
    return swapped.groupBy("wrong").agg(F.min("right").alias("right"))


def affix_frequencies(headwords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(char, n) of headwords by first character, and by last; headwords of one character don't count."""
    words = headwords.select("word").distinct().where(F.length("word") >= 2)
    return (
        words.groupBy(F.left("word", F.lit(1)).alias("char")).agg(F.count("*").alias("n")),
        words.groupBy(F.right("word", F.lit(1)).alias("char")).agg(F.count("*").alias("n")),
    )


def seam_scores(rules: DataFrame, affixes: tuple[DataFrame, DataFrame], longest: int | None = 3) -> DataFrame:
    """rules with seam: how often the last two characters of wrong could be the seam of two words, the number of headwords
    that end in the first times that of those that begin with the second; 0 if wrong is longer than longest."""
    starts, ends = affixes
    last = rules.withColumn("_a", F.expr("substring(wrong, -2, 1)")).withColumn("_b", F.right("wrong", F.lit(1)))
    last = last.join(ends.select(F.col("char").alias("_a"), F.col("n").alias("_x")), "_a", "left").join(starts.select(F.col("char").alias("_b"), F.col("n").alias("_y")), "_b", "left")
    counts = F.length("wrong") >= 2
    if longest is not None:
        counts = counts & (F.length("wrong") <= longest)
    score = F.when(counts, F.coalesce("_x", F.lit(0)) * F.coalesce("_y", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return last.withColumn("seam", score).drop("_a", "_b", "_x", "_y")


def filter_rules(rules: DataFrame, blocklist: DataFrame | None = None, threshold: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rules kept, and rules dropped for a seam of threshold or more (0: none is); listed wrong forms are in neither."""
    if blocklist is not None:
        rules = rules.join(blocklist.select("wrong"), "wrong", "left_anti")
    if threshold <= 0:
        return rules, rules.limit(0)
    return rules.where(F.col("seam") < threshold), rules.where(F.col("seam") >= threshold)


def merge_rule_layers(generated: DataFrame, manual: DataFrame, variants: DataFrame, variant_map: dict[str, str]) -> DataFrame:
    """wrong, right, manual: a variant before a manual rule before a generated one of the same wrong form; right forms in
    regional standard characters; rules that change nothing are left out. manual: the wrong form is a manual one."""
    layer = lambda df, k: df.select("wrong", "right", F.lit(k).alias("layer"))
    rows = layer(variants, 0).unionByName(layer(manual.where(F.length("wrong") >= 2), MANUAL)).unionByName(layer(generated, GENERATED))
    by_wrong = rows.groupBy("wrong").agg(F.min(F.struct("layer", "right")).alias("best"), F.max(F.col("layer") == MANUAL).alias("manual"))
    out = by_wrong.select("wrong", normalize_variants(F.col("best.right"), variant_map).alias("right"), "manual")
    return out.where(F.col("wrong") != F.col("right"))


def build_bigrams(headwords: DataFrame) -> DataFrame:
    """bg: distinct pairs of neighbouring characters of headwords, without punctuation."""
    words = headwords.select("word").distinct().where(F.length("word") >= 2)
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    return words.select(F.explode(pairs).alias("bg")).where(~F.col("bg").rlike(col_class(PUNCTUATION))).distinct()


def seam_report(rules: DataFrame, threshold: int = 0, top_n: int = 30) -> DataFrame:
    """The top_n non-zero seams with wrong, right and status (active, or excluded at or above the threshold)."""
    status = F.when(F.lit(threshold > 0) & (F.col("seam") >= threshold), "excluded").otherwise("active")
    rows = rules.where(F.col("seam") > 0).select("wrong", "right", "seam", status.alias("status"))
    return rows.orderBy(F.desc("seam"), F.desc("wrong"), F.desc("right")).limit(top_n)
