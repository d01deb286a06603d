"""Protected entities: frequent n-grams of a book that need no conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_class, long_windows, windows
from ..profile import ScriptProfile
from ..storage import sized, small_or_shuffled, stored

MIN_FREQ = 8
#: Stands for an entity in a run; no script has it.
_MARK = "\x01"


def script_runs(segments: DataFrame, profile: ScriptProfile, text: str = "text") -> DataFrame:
    """One row a maximal run of the script's characters: an n-gram wholly in the script lies in one of them."""
    return segments.withColumn("run", F.explode(F.regexp_extract_all(F.col(text), F.lit(profile.run_regex), F.lit(0))))


def counted_runs(segments: DataFrame, profile: ScriptProfile, text: str = "text") -> DataFrame:
    """book_id, run, times: the distinct runs of a book. What happens inside a run needs to be worked out once for all of its
    copies; words of an alphabet are runs that return all the time."""
    return script_runs(segments.select("book_id", text), profile, text).groupBy("book_id", "run").agg(F.count("*").alias("times"))


def _windows(run: Column, n: int) -> Column:
    """All windows of n characters; of long runs by way of pieces."""
    return F.when(F.length(run) <= 512, windows(run, n)).otherwise(long_windows(run, n))


def _pieces(runs: DataFrame, profile: ScriptProfile, convertible: str) -> DataFrame:
    """book_id, piece, times: runs cut at the characters that no entity holds."""
    out = profile.stop + convertible
    pieces = F.split("run", col_class(out) + "+") if out else F.array("run")
    return runs.select("book_id", "times", F.explode(pieces).alias("piece")).where(F.length("piece") >= profile.ngram_min)


def _counted(pieces: DataFrame, n: int) -> DataFrame:
    return pieces.where(F.length("piece") >= n).select("book_id", "times", F.explode(_windows(F.col("piece"), n)).alias("ngram"))


def _without(counts: DataFrame, headwords: DataFrame | None) -> DataFrame:
    return counts if headwords is None else counts.join(headwords.select(F.col("word").alias("ngram")), "ngram", "left_anti")


def count_ngrams(segments: DataFrame, profile: ScriptProfile, convertible: str = "", headwords: DataFrame | None = None) -> DataFrame:
    """book_id, ngram, n: n-grams of the profile's lengths without stop or convertible characters that are no headword.

    Runs are cut at the excluded characters before n-grams are made, so none is made in vain.
    """
    pieces = _pieces(counted_runs(segments, profile), profile, convertible)
    grams = pieces.select("book_id", "times", F.explode(F.flatten(F.array(*[_windows(F.col("piece"), n) for n in range(profile.ngram_min, profile.ngram_max + 1)]))).alias("ngram"))
    counts = grams.groupBy("book_id", "ngram").agg(F.sum("times").alias("n"))
    return _without(counts, headwords).select("book_id", "ngram", "n")


def frequent_ngrams(runs: DataFrame, floors: DataFrame, profile: ScriptProfile, convertible: str = "", headwords: DataFrame | None = None) -> DataFrame:
    """book_id, ngram, n, floor of what above_floor(count_ngrams()) gives, level by level: an n-gram is counted only where
    both of the n-grams in it that are one character shorter reach the book's floor, as it cannot be more frequent than
    they are. runs: counted_runs(), stored. Where the shorter ones are too many to be sent to every task, all are counted."""
    pieces, floors = _pieces(runs, profile, convertible), small_or_shuffled(stored(floors, "floors"))
    found, shorter = [], None
    for n in range(profile.ngram_min, profile.ngram_max + 1):
        grams = _counted(pieces, n)
        if shorter is not None:
            for part in (F.left("ngram", F.lit(n - 1)), F.right("ngram", F.lit(n - 1))):
                grams = grams.withColumn("part", part).join(shorter.withColumnRenamed("ngram", "part"), ["book_id", "part"], "left_semi")
        counts = grams.groupBy("book_id", "ngram").agg(F.sum("times").alias("n"))
        found.append(stored(above_floor(counts, floors), "frequent"))
        level, small = sized(found[-1].select("book_id", "ngram"))
        shorter = level if small else None
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return _without(out, headwords).select("book_id", "ngram", "n", "floor")


def frequency_floor(docs: DataFrame, least: int = MIN_FREQ) -> DataFrame:
    """book_id, floor: the number of the book's documents, or least if that is more."""
    return docs.groupBy("book_id").agg(F.greatest(F.lit(least), F.countDistinct("doc_id")).cast("long").alias("floor"))


def above_floor(counts: DataFrame, floors: DataFrame) -> DataFrame:
    return counts.join(floors, "book_id").where(F.col("n") >= F.col("floor"))


def cliff_threshold(counts: DataFrame) -> DataFrame:
    """book_id, threshold from counts (book_id, n, floor): the upper value of the last drop by half or more between
    neighbours in descending order; without one 15 % of the highest; never below the floor.

    Equal neighbours are no drop, so distinct counts are enough; how many candidates there are is carried along.
    """
    histogram = counts.groupBy("book_id", "floor", "n").agg(F.count("*").alias("c"))
    down = Window.partitionBy("book_id").orderBy(F.desc("n"))
    steps = histogram.withColumn("next", F.lead("n").over(down))
    ends = steps.groupBy("book_id", "floor").agg(
        F.min(F.when(F.col("n") / F.col("next") >= 2.0, F.col("n"))).alias("cliff"),
        F.max("n").alias("most"),
        F.sum("c").alias("candidates"),
    )
    cut = F.coalesce(F.col("cliff"), F.floor(F.col("most") * 0.15)).cast("long")
    return ends.select("book_id", F.when(F.col("candidates") <= 1, F.col("floor")).otherwise(F.greatest(cut, F.col("floor"))).alias("threshold"))


def above_threshold(counts: DataFrame) -> DataFrame:
    return counts.join(cliff_threshold(counts), "book_id").where(F.col("n") >= F.col("threshold")).select("book_id", "ngram", "n")


def occurrence_contexts(entities: DataFrame, runs: DataFrame, profile: ScriptProfile, convertible: str) -> DataFrame:
    """book_id, ngram, prev, n: occurrences (of one entity, not overlapping each other) by the convertible character before
    them, '' for any other. runs: counted_runs(). entities is a stored table; while it is small, runs are looked up in it
    where they are."""
    grams = F.flatten(F.array(*[_windows(F.col("run"), n) for n in range(profile.ngram_min, profile.ngram_max + 1)]))
    # an occurrence and the character before it lie in one run, as convertible characters belong to the script
    chosen = small_or_shuffled(entities.select("book_id", "ngram"))
    held = runs.select("book_id", "run", "times", F.explode(F.array_distinct(grams)).alias("ngram")).join(chosen, ["book_id", "ngram"])
    pieces = F.split(F.replace("run", F.col("ngram"), F.lit(_MARK)), _MARK, -1)  # each but the last ends where an occurrence begins
    last = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.right(x, F.lit(1)))
    prev = F.explode(F.transform(last, lambda c: F.when(c.rlike(col_class(convertible)), c).otherwise("")))
    return held.select("book_id", "ngram", "times", prev.alias("prev")).groupBy("book_id", "ngram", "prev").agg(F.sum("times").alias("n"))


def left_context_filter(entities: DataFrame, runs: DataFrame, profile: ScriptProfile, convertible: str, share: float = 0.80) -> DataFrame:
    """entities without those of which share or more occurrences follow one and the same convertible character: they are
    the tail of a longer name."""
    if not convertible:
        return entities
    seen = occurrence_contexts(entities, runs, profile, convertible)
    tails = seen.groupBy("book_id", "ngram").agg(F.max(F.when(F.col("prev") != "", F.col("n"))).alias("m"), F.sum("n").alias("t"))
    tails = tails.where(F.col("m") / F.col("t") >= share).select("book_id", "ngram")
    return entities.join(tails, ["book_id", "ngram"], "left_anti")


def protected_entities(segments: DataFrame, docs: DataFrame, profile: ScriptProfile, convertible: str = "", headwords: DataFrame | None = None, least: int = MIN_FREQ) -> DataFrame:
    """book_id, rank, ngram, n: by count, then shorter ones first, then by text."""
    runs = stored(counted_runs(segments, profile), "runs")
    counts = stored(frequent_ngrams(runs, frequency_floor(docs, least), profile, convertible, headwords), "counts")
    chosen = stored(above_threshold(counts), "entities")
    chosen = left_context_filter(chosen, runs, profile, convertible)
    order = Window.partitionBy("book_id").orderBy(F.desc("n"), F.length("ngram"), "ngram")
    return chosen.select("book_id", F.row_number().over(order).alias("rank"), "ngram", "n")
