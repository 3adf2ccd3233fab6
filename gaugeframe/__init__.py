"""Evaluation and data-audit operators for PySpark DataFrames."""
