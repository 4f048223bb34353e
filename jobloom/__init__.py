"""Collecting, cleaning, deduplicating, scoring and reconciling postings with Spark DataFrames."""
