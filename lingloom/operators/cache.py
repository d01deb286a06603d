"""The conversion cache: look up, convert each distinct text once, send the results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cache_key, is_blank

#: Price of a million characters in USD.
PRICE = 20.0


def with_key(segments: DataFrame, src_lang: str, tgt_lang: str, fmt: str = "text", text: str = "text") -> DataFrame:
    """segments with key; blank texts have none, so that they never meet in one task of a join."""
    return segments.withColumn("key", F.when(~is_blank(F.col(text)), cache_key(src_lang, tgt_lang, fmt, F.col(text))))


def cache_lookup(segments: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """segments (with key) with value: of a blank text itself, of a hit the cached one, of a miss null; and status."""
    found = segments.join(cache.select("key", F.col("value").alias("_hit")), "key", "left")
    blank = F.col("key").isNull()
    status = F.when(blank, "blank").when(F.col("_hit").isNotNull(), "hit").otherwise("miss")
    return found.withColumn("value", F.when(blank, F.col(text)).otherwise(F.col("_hit"))).withColumn("status", status).drop("_hit")


def distinct_misses(segments: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """key and text of every text that is neither blank nor cached, once over all books."""
    wanted = segments.where(F.col("key").isNotNull()).select("key", F.col(text).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    return wanted.join(cache.select("key"), "key", "left_anti")


def convert_segments(segments: DataFrame, cache: DataFrame, engine: Callable[[Column], Column] | DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """segments with value for every row, and the new cache entries. engine: a function of a column, or a table of
    translations (text, value); texts that a table lacks keep a null value."""
    misses = distinct_misses(segments, cache, text)
    if isinstance(engine, DataFrame):
        new = misses.join(engine.select("text", "value"), "text").select("key", "value")
    else:
        new = misses.select("key", engine(F.col("text")).alias("value"))
    known = cache.select("key", "value").unionByName(new)
    return cache_lookup(segments, known, text).drop("status"), new


def merge_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """key, value: all keys; the new value where both have one, and the largest of several new ones."""
    both = cache.select("key", "value", F.lit(0).alias("age")).unionByName(new.select("key", "value", F.lit(1).alias("age")))
    best = Window.partitionBy("key").orderBy(F.desc("age"), F.desc("value"))
    return both.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("key", "value")


def run_metrics(segments: DataFrame, batches: DataFrame) -> DataFrame:
    """book_id (null: all books), n_segments, n_chars, n_requests, segments_per_request, usd.

    segments: book_id, text; batches: book_id, batch_no of every segment sent.
    """
    sent = batches.groupBy("book_id").agg(F.countDistinct("batch_no").alias("r"))
    size = segments.groupBy("book_id").agg(F.count("*").alias("s"), F.sum(F.length("text")).alias("c"))
    by_book = size.join(sent, "book_id", "left")
    out = by_book.rollup("book_id").agg(F.sum("s").alias("n_segments"), F.sum("c").alias("n_chars"), F.coalesce(F.sum("r"), F.lit(0)).alias("n_requests"))
    return out.select(
        "book_id", "n_segments", "n_chars", "n_requests",
        F.when(F.col("n_requests") > 0, F.col("n_segments") / F.col("n_requests")).alias("segments_per_request"),
        (F.col("n_chars") * PRICE / 1e6).alias("usd"),
    )
