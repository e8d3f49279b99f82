"""Quernstone: wide-column tables, record logs and CSV ingest as Spark DataFrames."""
