"""Analysis of rule logs over many books."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import occurrences
from ..profile import CJK, ScriptProfile
from .rules import seam_scores

# Rules known to be wrong, and rules known to be right.
KNOWN_FALSE = ("天後", "被發", "地只", "了望", "布後", "反觀", "鑑於", "大力推薦")
KNOWN_TRUE = ("僵屍", "布帘", "匯整", "遊移", "巨細靡遺")


def snippet_neighbours(snippets: DataFrame, profile: ScriptProfile = CJK) -> DataFrame:
    """snippets (wrong, right, file, snippet) with left and right: the characters beside the occurrence of wrong closest to
    the middle, of equals the first; null where there is none or it is not of the script."""
    far = lambda p: F.abs(p - 1 + F.floor(F.length("wrong") / 2) - F.floor(F.length("snippet") / 2))
    nearest = F.array_min(F.transform(occurrences(F.col("snippet"), F.col("wrong")), lambda p: F.struct(far(p).alias("d"), p.alias("p"))))
    rows = snippets.withColumn("_p", nearest["p"])
    left = F.when(F.col("_p") > 1, F.substring(F.col("snippet"), F.col("_p") - 1, F.lit(1)))
    right = F.substring(F.col("snippet"), F.col("_p") + F.length("wrong"), F.lit(1))
    own = lambda c: F.when(c.rlike(f"^{profile.run_regex}$"), c)
    return rows.withColumn("left", own(left)).withColumn("right_char", own(right)).drop("_p")


def rule_metrics(neighbours: DataFrame, affixes: tuple[DataFrame, DataFrame], known_false: tuple[str, ...] = KNOWN_FALSE, known_true: tuple[str, ...] = KNOWN_TRUE) -> DataFrame:
    """wrong, right, n_files, n_snippets, seam, avg_ctx, max_ctx, cross_rate, label (FP, TP or null) by rule. A context's
    score is the number of headwords that end in the left neighbour plus that of those that begin with the right one."""
    starts, ends = affixes
    rows = neighbours.join(ends.select(F.col("char").alias("left"), F.col("n").alias("_x")), "left", "left")
    rows = rows.join(starts.select(F.col("char").alias("right_char"), F.col("n").alias("_y")), "right_char", "left")
    rows = rows.withColumn("score", F.coalesce("_x", F.lit(0)) + F.coalesce("_y", F.lit(0)))
    out = rows.groupBy("wrong", "right").agg(
        F.countDistinct("file").alias("n_files"),
        F.count("*").alias("n_snippets"),
        F.avg("score").alias("avg_ctx"),
        F.max("score").alias("max_ctx"),
        (F.sum((F.col("score") > 50).cast("int")) / F.count("*")).alias("cross_rate"),
    )
    label = F.when(F.col("wrong").isin(*known_false), "FP").when(F.col("wrong").isin(*known_true), "TP")
    return seam_scores(out, affixes, longest=None).withColumn("label", label)


def top_neighbours(neighbours: DataFrame, k: int = 3) -> DataFrame:
    """wrong, right, side, rank, char, n: the k most frequent neighbours on each side, null counted as a value."""
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("char")), F.struct(F.lit("right").alias("side"), F.col("right_char").alias("char"))))
    counts = neighbours.select("wrong", "right", sides.alias("x")).groupBy("wrong", "right", "x.side", "x.char").agg(F.count("*").alias("n"))
    order = Window.partitionBy("wrong", "right", "side").orderBy(F.desc("n"), F.col("char").asc_nulls_last())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrate_threshold(metrics: DataFrame) -> DataFrame:
    """min_false, max_true, threshold (0.8 of min_false, null without one): one row."""
    least = F.min(F.when(F.col("label") == "FP", F.col("seam")))
    most = F.max(F.when(F.col("label") == "TP", F.col("seam")))
    return metrics.agg(least.alias("min_false"), most.alias("max_true"), F.floor(least * 0.8).alias("threshold"))


def rank_rules(metrics: DataFrame, top_n: int = 20) -> DataFrame:
    """The top_n rules by seam."""
    return metrics.orderBy(F.desc("seam"), "wrong", "right").limit(top_n)
