"""Skein: corpus building, auditing and count-based statistics on PySpark DataFrames."""
