"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quotation marks and the private characters that stand in for them; marks after which a space goes.
BRACKETS = "「」『』"
GUARDS = "\ue010\ue011\ue012\ue013"
CLOSING = "」』"
PAUSES = "。？！，、；："


def col_class(chars) -> str:
    """A regular expression for one of the given characters; never matches if there are none."""
    return "[" + "".join(re.escape(c) for c in sorted(set(chars))) + "]" if chars else r"[^\s\S]"


def strip(col: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def is_blank(col: Column) -> Column:
    return ~F.coalesce(F.rlike(col, F.lit(r"(?U)\S")), F.lit(False))


def primary_forms(char_map: DataFrame) -> dict[str, str]:
    """Character: first listed form; of several lines for a character the last counts. A dictionary of a few thousand."""
    rows = char_map.select("simp", F.element_at("trads", 1).alias("trad"), "line_no").where(F.size("trads") > 0).collect()
    return {r["simp"]: r["trad"] for r in sorted(rows, key=lambda r: r["line_no"])}


def all_forms(char_map: DataFrame) -> dict[str, list[str]]:
    """Character: all listed forms; of several lines for a character the last counts."""
    return {r["simp"]: list(r["trads"]) for r in sorted(char_map.where(F.size("trads") > 0).collect(), key=lambda r: r["line_no"])}


def translate_map(col: Column, mapping: dict[str, str]) -> Column:
    """Every character replaced by its one-character image."""
    pairs = [(a, b) for a, b in sorted(mapping.items()) if len(a) == 1 and len(b) == 1]
    return F.translate(col, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)) if pairs else col


def convert_primary(col: Column, forms: dict[str, str]) -> Column:
    """Every character in its first listed form."""
    return translate_map(col, forms)


def normalize_variants(col: Column, variants: dict[str, str]) -> Column:
    """Every character in its regional standard form."""
    return translate_map(col, variants)


def normalize_ellipsis(col: Column) -> Column:
    """Any run of ellipsis characters as two of them."""
    return F.regexp_replace(col, "…+", "……")


def protect_brackets(col: Column) -> Column:
    return F.translate(col, BRACKETS, GUARDS)


def restore_brackets(col: Column) -> Column:
    """Quotation marks back in place; spaces before a closing one go, and spaces after a pause before anything else."""
    back = F.translate(col, GUARDS, BRACKETS)
    back = F.regexp_replace(back, f"(?U)\\s+([{CLOSING}])", "$1")
    return F.regexp_replace(back, f"(?U)([{PAUSES}])\\s+(?=\\S)", "$1")


def strip_tags(col: Column, empty_too: bool = True) -> Column:
    """Markup removed; with empty_too also a pair of angle brackets with nothing between."""
    return F.regexp_replace(col, "<[^>]*>" if empty_too else "<[^>]+>", "")


def output_stem(path: Column, forms: dict[str, str], suffix: str = "_zhTW") -> Column:
    """A file name without folder, ending and suffix, trimmed and converted."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.when(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1) == "", name).otherwise(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1))
    return convert_primary(strip(F.replace(stem, F.lit(suffix), F.lit(""))), forms)


def cache_key(src_lang: Column | str, tgt_lang: Column | str, fmt: Column | str, text: Column) -> Column:
    """md5 of the four parts joined by colons."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.md5(F.concat_ws(":", as_col(src_lang), as_col(tgt_lang), as_col(fmt), text))


def occurrences(text: Column, part: Column, overlapping: bool = True) -> Column:
    """1-based places of part in text, as an array. Non-overlapping ones are taken from the left."""
    if overlapping:
        pieces = F.split(text, F.concat(F.lit(r"(?=\Q"), part, F.lit(r"\E)")), -1)  # cut where an occurrence begins
        starts = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.array(F.lit(1)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
        return F.when(F.startswith(text, part), starts).otherwise(F.slice(starts, 2, F.size(starts)))
    pieces = F.split(text, F.concat(F.lit(r"\Q"), part, F.lit(r"\E")), -1)
    ends = F.aggregate(pieces, F.array(F.lit(1)).cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p) + F.length(part))))
    return F.transform(F.slice(ends, 2, F.size(pieces) - 1), lambda e: e - F.length(part))


def windows(text: Column, n: int | Column) -> Column:
    """All windows of n characters, as an array."""
    n = n if isinstance(n, Column) else F.lit(n)
    places = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.transform(places, lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def long_windows(text: Column, n: int | Column, piece: int = 256) -> Column:
    """All windows of n characters of a long text, by way of overlapping pieces: substring() counts from the beginning."""
    n = n if isinstance(n, Column) else F.lit(n)
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1), F.lit(piece))
    cut = F.transform(starts, lambda p: F.substring(text, p, F.lit(piece) + n - 1))
    return F.when(F.length(text) >= n, F.flatten(F.transform(cut, lambda s: windows(s, n)))).otherwise(F.array().cast("array<string>"))


def next_chars(text: Column, part: Column) -> Column:
    """The character after every occurrence of part, overlapping ones too; '' at the end."""
    return F.regexp_extract_all(text, F.concat(F.lit(r"(?s)(?=\Q"), part, F.lit(r"\E(.?))")), F.lit(1))


def windows_between(text: Column, least: int, most: int) -> Column:
    """All windows of least to most characters, as an array."""
    return F.flatten(F.array(*[windows(text, n) for n in range(least, most + 1)]))
