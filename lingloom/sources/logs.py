"""Rule logs of earlier runs, as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# The section of applied rules, the line that begins a rule, a snippet, and the reason after it.
APPLIED = "=== 後處理修正紀錄"
RULE = r"^\[\d+\]\s+(.+?)\s+→\s+(.+?)\s+\(\d+\+\s*次\)\s*$"
SNIPPET = r"^  …(.+)…\s*$"
REASON = r"\s+\[(?:ckip↑)?(?:lookbehind|lookahead)[^\]]*\]\s*$"


def parse_rule_logs(lines: DataFrame) -> DataFrame:
    """file, wrong, right, pos, snippet of lines (file, pos, line): snippets of applied rules, by the rule line before them."""
    in_file = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.regexp_replace("line", r"(?U)\s+$", "")
    rows = lines.withColumn("line", line)
    section = F.when(F.col("line").startswith("==="), F.contains("line", F.lit(APPLIED)))
    rows = rows.withColumn("applied", F.coalesce(F.last(section, ignorenulls=True).over(in_file), F.lit(False)))
    trimmed = strip(F.col("line"))
    head = F.when(F.col("line").startswith("==="), F.struct(F.lit("").alias("wrong"), F.lit("").alias("right"))).when(
        F.col("applied") & trimmed.rlike("(?U)" + RULE),
        F.struct(strip(F.regexp_extract(trimmed, "(?U)" + RULE, 1)).alias("wrong"), strip(F.regexp_extract(trimmed, "(?U)" + RULE, 2)).alias("right")),
    )
    rows = rows.withColumn("is_head", head.isNotNull()).withColumn("rule", F.last(head, ignorenulls=True).over(in_file))
    rows = rows.where(F.col("applied") & ~F.col("is_head") & (F.col("rule.wrong") != "") & F.col("line").rlike(SNIPPET))
    text = strip(F.regexp_replace(F.regexp_extract("line", SNIPPET, 1), "(?U)" + REASON, ""))
    return rows.select("file", "rule.wrong", "rule.right", "pos", text.alias("snippet"))


def read_rule_logs(spark: SparkSession, folder: str, pattern: str = "*_consistency.txt") -> DataFrame:
    """parse_rule_logs of all logs in a folder whose names fit the pattern."""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).withColumn("file", F.input_file_name())
    return parse_rule_logs(raw.select("file", F.posexplode(F.split("value", r"\r\n|[\n\r]")).alias("pos", "line")))
