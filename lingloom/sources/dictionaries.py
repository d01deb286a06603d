"""Dictionaries as tables. A file is read whole, since the order of its lines counts; dictionaries are small."""

from __future__ import annotations

import json
import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import strip


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line, a, b: the parts of every line with a tab."""
    rows = _lines(spark, path).where(F.contains("line", F.lit("\t")))
    parts = F.split("line", "\t", 2)
    return rows.select("line_no", "line", strip(parts[0]).alias("a"), strip(parts[1]).alias("b"))


def read_char_map(spark: SparkSession, path: str) -> DataFrame:
    """simp, trads, line_no of lines `simp<TAB>form form ...`; forms keep their order."""
    rows = _pairs(spark, path).where(F.col("b") != "")
    return rows.select(F.col("a").alias("simp"), F.split("b", r"(?U)\s+").alias("trads"), "line_no")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """wrong, right of lines `wrong<TAB>right ...` that are no comment and change something; of several lines the last."""
    rows = _pairs(spark, path).where(~F.col("line").startswith("#") & (F.col("a") != "") & (F.col("b") != ""))
    rows = rows.withColumn("right", F.split("b", r"(?U)\s+")[0]).where(F.col("a") != F.col("right"))
    return rows.groupBy(F.col("a").alias("wrong")).agg(F.max_by("right", "line_no").alias("right"))


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """simp, trad of lines `simp<TAB>trad ...` that change something; of several lines the last."""
    rows = _pairs(spark, path).where((F.col("a") != "") & (F.col("b") != "")).withColumn("trad", F.split("b", r"(?U)\s+")[0])
    return rows.where(F.col("a") != F.col("trad")).groupBy(F.col("a").alias("simp")).agg(F.max_by("trad", "line_no").alias("trad"))


def read_corrections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """(wrong, right) of two characters or more, (wrong) of the blocklist, and the threshold of a JSON object. Without a
    `corrections` object the whole object holds corrections; its values that are no text are passed over."""
    raw = spark.read.text(path, wholetext=True)
    named = F.from_json("value", "corrections map<string,string>, layer2_blocklist array<string>, layer2_seam_threshold int")
    bare = F.from_json("value", "map<string,string>")
    rows = raw.select(named.alias("x"), bare.alias("y")).select(F.coalesce("x.corrections", F.map_filter("y", lambda k, v: ~k.isin("layer2_blocklist", "layer2_seam_threshold"))).alias("c"), "x.*")
    rules = rows.select(F.explode("c").alias("wrong", "right")).where(F.length("wrong") >= 2)
    blocked = rows.select(F.explode("layer2_blocklist").alias("wrong")).distinct()
    threshold = rows.agg(F.max("layer2_seam_threshold")).first()[0]
    return rules, blocked, int(threshold or 0)


def read_headwords(spark: SparkSession, path: str) -> DataFrame:
    """word: distinct titles of a JSON array of entries, which may be xz-compressed; no rows if there is no such file."""
    empty = spark.createDataFrame([], "word string")
    if path.endswith(".xz"):

        def titles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in parts:
                for content in df["content"]:
                    yield pd.DataFrame({"word": [e["title"] for e in json.loads(lzma.decompress(content)) if "title" in e]})

        try:
            return spark.read.format("binaryFile").load(path).select("content").mapInPandas(titles, "word string").distinct()
        except AnalysisException:
            return empty
    try:
        rows = spark.read.json(path, multiLine=True)
    except AnalysisException:
        return empty
    return rows.select(F.col("title").alias("word")).where(F.col("word").isNotNull()).distinct() if "title" in rows.columns else empty
