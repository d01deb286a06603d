"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document draws an exponential key, -ln(u) / quality, from a hash of its id; ascending keys are a weighted sample
without replacement. A source's target is filled by complete epochs first, and then by the documents of the smallest
keys, whose sizes are prefix-summed up to what is left of the budget.

The prefix sum is two-level: keys are mapped monotonically to buckets, a window over a source's buckets (a fixed number
of rows) gives each bucket's offset, and a window inside (source, bucket) finishes it, so that a source that holds a third
of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

SYMBOLS = r"[#*$%&|<>]"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for clean text, falling with symbols per word; in (0, 1]."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("double")
    return 1.0 / (1.0 + 10.0 * symbols / F.greatest(size, F.lit(1)).cast("double"))


def uniform(doc_id: Column) -> Column:
    """In (0, 1), from 48 bits of a digest of the id."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 12), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 48)


def source_targets(totals: DataFrame, max_epochs: int = 3) -> DataFrame:
    """totals: source, source_size. Adds target: shares 1, 2, 3, 1, ... by code point order (null last) of all sizes, no
    target above max_epochs times its source; what is cut off is shared out again by weight.

    With sources in order of cap / weight, the level is the first one at which no later source is above its cap.
    One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = totals.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    rows = rows.withColumn("cap", F.col("source_size").cast("double") * float(max_epochs)).withColumn("r", F.col("cap") / F.col("w"))
    by_level = Window.orderBy("r", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n_all", F.sum("source_size").over(whole).cast("double")).withColumn("w_all", F.sum("w").over(whole))
    rows = rows.withColumn("level", (F.col("n_all") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.col("w_all") - F.coalesce(F.sum("w").over(below), F.lit(0.0))))
    # of the levels that fit, the first is the highest: each later one gives away the share of a source below its cap
    rows = rows.withColumn("fits", F.when(F.col("level") <= F.col("r"), F.col("level")))
    rows = rows.withColumn("level", F.coalesce(F.max("fits").over(whole), F.max("r").over(whole)))
    return rows.select("source", "source_size", F.least(F.col("w") * F.col("level"), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, max_epochs: int = 3, buckets: int = 1024, carried: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and the column carried, if one is given, for every row of docs (doc_id,
    text, source).

    taken is the number of words the mix takes, repeats counted; the document on the border of a budget is taken in part,
    so a source's taken words add up to floor(target). copies is how often a consumer of whole documents takes the row:
    the epochs, plus one if the fractional selection reaches it.

    Null text has size 0 and is never taken; a null source is a source of its own; a null id draws a key like any other
    id; rows of equal id draw equal keys and are taken one after the other; an empty table gives no rows; other columns
    are ignored.
    """
    size = word_count(F.col("text"))
    more = [carried] if carried else []
    sized = docs.select("doc_id", "source", *more, size.alias("size"), quality_weight(F.col("text"), size).alias("q"))
    sized = sized.withColumn("key", -F.log(uniform(F.col("doc_id"))) / F.col("q"))
    sized = stored(sized.withColumn("bucket", F.floor((1.0 - F.exp(-F.col("key"))) * float(buckets)).cast("int")).drop("q"), "mix")
    cells = sized.groupBy("source", "bucket").agg(F.sum("size").alias("cell"))
    totals = source_targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), max_epochs)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("offset", F.coalesce(F.sum("cell").over(before), F.lit(0)))
    cells = cells.alias("c").join(totals.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "c.bucket", "c.offset", "t.source_size", "t.target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", *more).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.bucket") == F.col("c.bucket"))
    rows = placed.alias("p").join(cells.alias("c"), same).select("p.doc_id", *[f"p.{c}" for c in more], "p.size", "c.source_size", "c.target", (F.col("p.inner") + F.col("c.offset")).alias("before"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", epochs).withColumn("left", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))
    copies = F.when(F.col("size") > 0, F.col("epochs") + (part > 0).cast("long")).otherwise(F.lit(0))
    return rows.select("doc_id", *more, "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), copies.cast("int").alias("copies"))
