"""Corpus statistics, rule mining and text localisation as Spark DataFrame jobs."""
