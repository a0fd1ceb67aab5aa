"""Verification analytics on Spark DataFrames: paired-content checks, metrics, audits and splits."""
