"""Results as tables, one folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_tables(tables: dict[str, DataFrame], out: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Every table under its name, by book where it has one."""
    for name, df in tables.items():
        writer = df.write.mode(mode).format(fmt)
        (writer.partitionBy("book_id") if "book_id" in df.columns and len(df.columns) > 1 else writer).save(f"{out.rstrip('/')}/{name}")
