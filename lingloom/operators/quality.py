"""Checks of converted texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_class, is_blank, strip, strip_tags
from ..profile import ScriptProfile

# Closing quotes and sentence enders.
QUOTES = "」』\"'”’"
ENDERS = "。！？….!?"


def needs_fallback(src: Column, tgt: Column, html: bool | Column = False) -> Column:
    """Whether a conversion lost text: it is blank, shorter by more than 5 characters and 15 %, or its closing quote or
    sentence ender is gone. A blank source never does."""
    reason = fallback_reason(src, tgt, html)
    return reason.isNotNull()


def fallback_reason(src: Column, tgt: Column, html: bool | Column = False) -> Column:
    """blank, length, quote, ender, or null."""
    html = F.lit(html) if isinstance(html, bool) else html
    s, t = F.when(html, strip_tags(src)).otherwise(src), F.when(html, strip_tags(tgt)).otherwise(tgt)
    n, m = F.length(strip(s)), F.length(strip(t))
    s_end, t_end = F.right(F.regexp_replace(s, r"(?U)\s+$", ""), F.lit(1)), F.right(F.regexp_replace(t, r"(?U)\s+$", ""), F.lit(1))
    quote, ender = col_class(QUOTES), col_class(ENDERS)
    some = (s_end != "") & (t_end != "")
    return (
        F.when(is_blank(src), F.lit(None))
        .when(is_blank(tgt), "blank")
        .when((n - m) > F.greatest(F.lit(5.0), n * 0.15), "length")
        .when(some & s_end.rlike(quote) & ~t_end.rlike(quote), "quote")
        .when(some & s_end.rlike(ender) & ~t_end.rlike(ender) & ~t_end.rlike(quote), "ender")
    )


def is_silent_passthrough(src: Column, tgt: Column, convertible: str, profile: ScriptProfile) -> Column:
    """Whether more than half of the source's convertible characters are there after conversion; asked only of sources
    with 5 characters of the script and 3 convertible ones. The range is the first one of the profile."""
    if not convertible:
        return F.lit(False)
    count = lambda c, cls: F.length(F.regexp_replace(c, f"[^{cls}]", ""))
    chars = col_class(convertible)[1:-1]
    before = count(src, chars)
    return F.coalesce((count(src, profile.run) >= 5) & (before >= 3) & (count(tgt, chars) / before > 0.50), F.lit(False))


def fallback_report(pairs: DataFrame, convertible: str, profile: ScriptProfile) -> tuple[DataFrame, DataFrame]:
    """Failing pairs with their reason, and their number by book and reason. pairs: book_id, pair_pos, src, tgt."""
    passed = F.when(is_silent_passthrough(F.col("src"), F.col("tgt"), convertible, profile), "passthrough")
    failing = pairs.withColumn("reason", F.coalesce(fallback_reason(F.col("src"), F.col("tgt")), passed)).where(F.col("reason").isNotNull())
    return failing, failing.groupBy("book_id", "reason").agg(F.count("*").alias("n"))
